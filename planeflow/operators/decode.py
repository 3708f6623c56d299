"""Decode and verify: packets to rows to frames to checksums."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bits import depack
from ..sources.bitstream import n_bands, parse_headers, read_palettes
from .delta import Malformed, parse
from .quantize import from_rgb444, oklab

ROW_SCHEMA = "stream_id string, n int, y int, index binary"
CELL_SCHEMA = "stream_id string, n int, op int, flags int, planes int, y0 int, y1 int, y int, columns array<int>, data binary, rle boolean, error string"


def row_writes(packets: DataFrame, headers: DataFrame) -> DataFrame:
    """Every packet's effect on every row; a packet without a write to a row has a row without columns."""
    info = headers.select("stream_id", "planes", "y0", "y1")

    def explode(frames):
        for frame in frames:
            rows = []
            for p in frame.itertuples(index=False):
                writes, error = {}, None
                if p.op in (K.DELTA, K.DELTA_RLE):
                    try:
                        found, used, _ = parse(p.op, bytes(p.video), p.planes)
                        if len(p.video) - used > 1:
                            error = "bytes follow the delta"
                        writes = {w.y: w for w in found}
                    except Malformed as e:
                        error = str(e)
                for y in range(K.HEIGHT):
                    w = writes.get(y)
                    rows.append((p.stream_id, p.n, p.op, p.flags, p.planes, p.y0, p.y1, y, w.columns if w else None, w.data if w else None, bool(w and w.rle), error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELL_SCHEMA.split(", ")])

    return packets.filter(F.size("errors") == 0).join(info, "stream_id").select("stream_id", "n", "op", "flags", "video", "planes", "y0", "y1").mapInPandas(explode, CELL_SCHEMA)


def fold_rows(writes: DataFrame) -> DataFrame:
    """The visible row after each packet, as 160 palette indices: one fold a stream and row.

    Two buffers start at zero. A delta writes into the hidden one, after copying the visible one where its
    flag says so, and then they change places; a repeat leaves both alone."""

    def fold(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        planes = int(frame["planes"].iloc[0])
        hidden, visible = np.zeros((planes, K.ROW_BYTES), np.uint8), np.zeros((planes, K.ROW_BYTES), np.uint8)
        out = []
        for p in frame.itertuples(index=False):
            if p.op != K.REPEAT:
                if p.flags & K.COPY and p.y0 <= p.y < p.y1:
                    hidden = visible.copy()
                if p.data is not None:
                    raw = np.frombuffer(p.data, np.uint8)
                    if p.rle:
                        hidden = raw.reshape(planes, K.ROW_BYTES).copy()
                    else:
                        hidden[:, list(p.columns)] = raw.reshape(-1, planes).T
                hidden, visible = visible, hidden
            out.append((p.stream_id, p.n, p.y, depack(visible).tobytes()))
        return pd.DataFrame(out, columns=["stream_id", "n", "y", "index"])

    return writes.groupBy("stream_id", "y").applyInPandas(fold, ROW_SCHEMA)


def palettes_at(packets: DataFrame, headers: DataFrame) -> DataFrame:
    """(stream_id, n, palette): the palettes of all bands in force at each packet, big-endian."""
    info = headers.select("stream_id", "colors", "y0", "y1", "band_rows", "band_colors")
    last = F.last("palette", ignorenulls=True).over(Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))

    @F.pandas_udf("binary")
    def whole(data: pd.Series, colors: pd.Series, y0: pd.Series, y1: pd.Series, rows: pd.Series, change: pd.Series) -> pd.Series:
        out = []
        for d, c, a, b, r, k in zip(data, colors, y0, y1, rows, change, strict=True):
            n = n_bands(a, b, r)
            found = read_palettes(bytes(d), c, n, k) if d is not None else [[0] * c] * n
            out.append(np.array(found, ">u2").tobytes())
        return pd.Series(out)

    return packets.withColumn("palette", last).join(info, "stream_id").select("stream_id", "n", whole("palette", "colors", "y0", "y1", "band_rows", "band_colors").alias("palette"))


def frame_crcs(rows: DataFrame, palettes: DataFrame) -> DataFrame:
    """(stream_id, n, got): CRC-32 of a frame's indices and palettes."""
    frames = rows.groupBy("stream_id", "n").agg(F.array_sort(F.collect_list(F.struct("y", "index"))).alias("rows"))

    joined = F.aggregate(F.col("rows"), F.lit(b""), lambda s, r: F.concat(s, r["index"]))
    return frames.join(palettes, ["stream_id", "n"]).select("stream_id", "n", F.crc32(F.concat(joined, "palette")).alias("got"))


def status(got: DataFrame, want: DataFrame) -> DataFrame:
    """OK, FAILED or, where the side-car has no entry, UNVERIFIED."""
    out = got.join(want.select("stream_id", "n", F.col("crc").alias("want")), ["stream_id", "n"], "left")
    return out.withColumn("status", F.when(F.col("want").isNull(), "UNVERIFIED").when(F.col("want") == F.col("got"), "OK").otherwise("FAILED"))


def verify(files: DataFrame, sidecars: DataFrame, packets: DataFrame) -> DataFrame:
    """One row per frame: stream_id, n, got, want, status."""
    headers = parse_headers(files)
    rows = fold_rows(row_writes(packets, headers))
    return status(frame_crcs(rows, palettes_at(packets, headers)), sidecars)


def verify_audio(sidecars: DataFrame, audio: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per stream with audio: stream_id, n, got, want, status; the side-car's entry behind the frames."""
    places = headers.filter("audio_format <> 0").select("stream_id", F.col("packets").cast("int").alias("n"))
    return status(places.join(audio.select("stream_id", F.col("crc").alias("got")), "stream_id"), sidecars)


def colour_counts(rows: DataFrame, palettes: DataFrame, headers: DataFrame) -> DataFrame:
    """(stream_id, n, colour, pixels): what is on the screen, by RGB444 colour."""

    def count(batches):
        for batch in batches:
            out = [[], [], [], []]
            for key, n, y, index, palette, colors, y0, band_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = np.frombuffer(palette, ">u2").reshape(-1, colors)
                band = min(max(0, (y - y0) // band_rows), len(table) - 1) if band_rows else 0
                colour, pixels = np.unique(table[band][np.frombuffer(index, np.uint8)], return_counts=True)
                for column, x in zip(out, ([key] * len(colour), [n] * len(colour), colour.tolist(), pixels.tolist()), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["stream_id", "n", "colour", "pixels"])

    known = rows.join(palettes, ["stream_id", "n"]).join(headers.select("stream_id", "colors", "y0", "band_rows"), "stream_id")
    each = known.select("stream_id", "n", "y", "index", "palette", "colors", "y0", "band_rows").mapInArrow(count, "stream_id string, n int, colour int, pixels long")
    return each.groupBy("stream_id", "n", "colour").agg(F.sum("pixels").alias("pixels"))


def ideal_rows(source: DataFrame, palettes: DataFrame, headers: DataFrame) -> DataFrame:
    """(stream_id, n, y, index): the nearest entries to the source's rows (stream_id, n, y, rgb) in the palettes in force."""

    def near(batches):
        for batch in batches:
            made = [nearest_row(*row) for row in zip(*(c.to_pylist() for c in batch.columns[3:]), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["stream_id", "n", "y", "index"])

    known = source.join(palettes, ["stream_id", "n"]).join(headers.select("stream_id", "colors", "y0", "band_rows"), "stream_id")
    return known.select("stream_id", "n", "y", "rgb", "palette", "colors", "y0", "band_rows").mapInArrow(near, ROW_SCHEMA)


def band_entries(palette: bytes, colors: int, y0: int, band_rows: int, y: int) -> np.ndarray:
    """The Oklab entries of a row's band."""
    table = np.frombuffer(palette, ">u2").reshape(-1, colors)
    band = min(max(0, (y - y0) // band_rows), len(table) - 1) if band_rows else 0
    return oklab(from_rgb444(table[band].astype(int)))


def nearest_row(rgb: bytes, palette: bytes, colors: int, y0: int, band_rows: int, y: int) -> bytes:
    here = oklab(np.frombuffer(rgb, np.uint8).reshape(-1, 3))
    entries = band_entries(palette, colors, y0, band_rows, y)
    return ((here[:, None] - entries) ** 2).sum(-1).argmin(1).astype(np.uint8).tobytes()


def attributed(decoded: DataFrame, source: DataFrame, packets: DataFrame, headers: DataFrame, limit: float = K.BAD_PIXEL) -> DataFrame:
    """(stream_id, n, pixels, error, colours, held, compression): each frame's distance to its source, and why pixels differ
    visibly from it, over active rows.

    decoded has (stream_id, n, y, index), source (stream_id, n, y, rgb). Colours: the nearest entry is visibly off too. Held: the
    pixel is the ideal one of the frame that was last drawn. Frames without a source row have none."""
    palettes = palettes_at(packets, headers)
    ideal = ideal_rows(source, palettes, headers)
    order = Window.partitionBy("stream_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    drawn = packets.select("stream_id", "n", F.last(F.when(F.col("op") != K.REPEAT, F.col("n")), ignorenulls=True).over(order).alias("_drawn"))
    held = ideal.select("stream_id", F.col("n").alias("_drawn"), "y", F.col("index").alias("_held"))
    info = headers.select("stream_id", "colors", "y0", "y1", "band_rows")
    rows = decoded.join(source, ["stream_id", "n", "y"]).join(info, "stream_id").filter("y >= y0 and y < y1")
    rows = rows.join(ideal.withColumnRenamed("index", "_ideal"), ["stream_id", "n", "y"]).join(drawn, ["stream_id", "n"])
    rows = rows.join(held, ["stream_id", "_drawn", "y"], "left").join(palettes, ["stream_id", "n"])

    def account(batches):
        for batch in batches:
            out = []
            for rgb, index, best, kept, palette, colors, y0, band_rows, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                here, entries = oklab(np.frombuffer(rgb, np.uint8).reshape(-1, 3)), band_entries(palette, colors, y0, band_rows, y)
                index, best = np.frombuffer(index, np.uint8), np.frombuffer(best, np.uint8)
                d, least = (np.sqrt(((here - entries[x]) ** 2).sum(-1)) for x in (index, best))
                same = index == np.frombuffer(kept, np.uint8) if kept is not None else np.zeros(len(index), bool)
                bad, poor = d > limit, least > limit
                out.append((len(index), float(d.sum()), int((bad & poor).sum()), int((bad & ~poor & same).sum()), int((bad & ~poor & ~same).sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["stream_id", "n", "pixels", "error", "colours", "held", "compression"])

    each = rows.select("stream_id", "n", "rgb", "index", "_ideal", "_held", "palette", "colors", "y0", "band_rows", "y")
    counts = each.mapInArrow(account, "stream_id string, n int, pixels long, error double, colours long, held long, compression long")
    return counts.groupBy("stream_id", "n").agg(*(F.sum(c).alias(c) for c in ("pixels", "error", "colours", "held", "compression")))


def decode_frame_model(content: bytes) -> list[int]:
    """Frame CRCs by plain sequential decoding of whole frames: the tests' second opinion."""
    from ..sources.bitstream import HEADER, walk

    head = struct.unpack(HEADER, content[: K.HEADER_BYTES])
    planes, colors, y0, y1, rows, change = head[5], head[6], head[8], head[9], head[13], head[14]
    buffers = [np.zeros((planes, K.HEIGHT, K.ROW_BYTES), np.uint8) for _ in range(2)]
    n, out = n_bands(y0, y1, rows), []
    palette = np.zeros((n, colors), ">u2").tobytes()
    for _, _, _, op, flags, _, pal, _, video, _ in walk(content):
        if pal:
            palette = np.array(read_palettes(pal, colors, n, change), ">u2").tobytes()
        if op != K.REPEAT:
            if flags & K.COPY:
                buffers[1][:, y0:y1] = buffers[0][:, y0:y1]
            for w in parse(op, video, planes)[0]:
                w.apply(buffers[1][:, w.y])
            buffers.reverse()
        out.append(zlib.crc32(depack(np.swapaxes(buffers[0], 0, 1)).tobytes() + palette))
    return out
