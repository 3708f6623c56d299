"""Reports and checks around a decoded stream: timings, audio drift, still frames, the display list."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bits import doubled, planarize
from ..sources.bitstream import n_bands, put_header, put_packet, put_palettes
from ..sources.disk import ppm
from . import delta
from .quantize import from_rgb444

VSYNC_HZ = 50.0
FIRST_LINE = 0x2C
#: Bytes of a delta's map of rows, and of a row's mask of columns.
ROW_MASK = K.HEIGHT // 8
COLUMN_MASK = 3
CCK_PER_VBL = K.LINES_PER_VBL * K.CCK_PER_LINE


def budget(player_bytes: Column, reserve_tail: int = 0) -> Column:
    """Bytes that a disk has left for data."""
    return (K.SECTORS - K.PLAYER_SECTOR - F.ceil(player_bytes / K.SECTOR) - reserve_tail) * K.SECTOR


def stamp(vbl: Column, line_cck: Column) -> Column:
    """Colour clocks of a stamp whose second long holds the line and the colour clock."""
    return (vbl * K.LINES_PER_VBL + F.shiftright(line_cck, 16)) * K.CCK_PER_LINE + line_cck.bitwiseAND(0xFFFF)


def play_report(play: DataFrame) -> DataFrame:
    """Load rate, audio interval and drift, fill and copy times of measurement rows (sources.disk.info "PLAY").

    Times are milliseconds; what was not measured is null."""
    ms = lambda cck: cck * 1000 / K.PAULA_HZ
    n, want = F.col("audio_irqs"), F.col("period") * K.AUDIO_BUFFER
    heard = (F.col("audio_format") != 0) & (n >= 2)
    span = stamp(F.col("last_vbl"), F.col("last_line_cck")) - stamp(F.col("first_vbl"), F.col("first_line_cck"))
    mean_fill = F.when(heard & (F.col("fill_sum") > 0), F.col("fill_sum") / n)
    return play.select(
        "disk_id", "packets", "late", "max_late", (F.col("vbl") - F.col("vbl_expected")).alias("extra_vbl"),
        F.when(F.col("load_vsync") > 0, F.col("bytes") / 1024 / (F.col("load_vsync") / VSYNC_HZ)).alias("load_kb_s"),
        F.when(heard, span / (n - 1)).alias("interval_cck"), F.when(heard, ms(span - (n - 1) * want)).alias("drift_ms"),
        ms(mean_fill).alias("fill_ms"), F.when(heard, ms(F.col("fill_max"))).alias("worst_fill_ms"), (mean_fill / want).alias("fill_cpu"),
        F.when(heard & (F.col("fill_max") > CCK_PER_VBL), True).otherwise(False).alias("broken_stamp"),
        F.when(F.col("copies") > 0, ms(F.col("copy_sum") / F.col("copies"))).alias("copy_ms"), F.when(F.col("copies") > 0, ms(F.col("copy_max"))).alias("worst_copy_ms"),
    )


def timing_summary(timing: DataFrame) -> DataFrame:
    """Mean and worst decode time of each disk, over packets that were measured."""
    used = F.when(F.col("cck") > 0, F.col("cck"))
    return timing.groupBy("disk_id").agg(F.count(used).alias("deltas"), (F.avg(used) * 1000 / K.PAULA_HZ).alias("mean_ms"), (F.max(used) * 1000 / K.PAULA_HZ).alias("worst_ms"), F.max_by("n", F.struct(used, -F.col("n"))).alias("worst_n"))


PARTS = "row_map column_masks literals rle padding".split()


def delta_parts(packets: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per stream: packets, deltas, rows, rle_rows, and the bytes of each part. headers, palettes, audio, row_map,
    column_masks, literals, rle and padding add up to the payload; malformed deltas count as padding."""
    names = ["deltas", "rows", "rle_rows", *PARTS]

    def split(batches):
        for batch in batches:
            out = []
            for op, size, palette, sound, video, planes in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                rest, found = size - 6 - len(palette or b"") - len(sound or b""), None
                if op in (K.DELTA, K.DELTA_RLE):
                    try:
                        found = delta.parse(op, video, planes)
                    except delta.Malformed:
                        pass
                if found is None:
                    out.append((0, 0, 0, 0, 0, 0, 0, rest))
                    continue
                _, used, stats = found
                masks = (stats.rows - stats.rle_rows) * COLUMN_MASK
                literals = stats.bytes - stats.rle_rows * K.ROW_BYTES * planes
                out.append((1, stats.rows, stats.rle_rows, ROW_MASK, masks, literals, used - ROW_MASK - masks - literals, rest - used))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["stream_id", *names])

    whole = packets.filter(F.size("errors") == 0)
    sent = whole.join(headers.select("stream_id", "planes"), "stream_id").select("stream_id", "op", "len", "palette", "audio", "video", "planes")
    parts = sent.mapInArrow(split, ", ".join(["stream_id string", *(f"{n} long" for n in names)])).groupBy("stream_id").agg(*(F.sum(n).alias(n) for n in names))
    size = lambda c: F.sum(F.coalesce(F.length(c), F.lit(0))).cast("long")
    plain = whole.groupBy("stream_id").agg(F.count("*").alias("packets"), (F.count("*") * 6).alias("headers"), size("palette").alias("palettes"), size("audio").alias("audio"))
    return plain.join(parts, "stream_id")


def mismatches(a: str, b: str) -> Column:
    """How many bytes of two binary columns differ, and the first place; bytes that only one has differ."""

    @F.pandas_udf("struct<differ: long, first: long>")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x or b"", np.uint8), np.frombuffer(y or b"", np.uint8)
            n = min(len(x), len(y))
            bad = np.flatnonzero(x[:n] != y[:n])
            count = len(bad) + abs(len(x) - len(y))
            out.append((count, int(bad[0]) if len(bad) else n if count else None))
        return pd.DataFrame(out, columns=["differ", "first"]).astype({"first": "Int64"})

    return compare(a, b)


def framebuffer(index: np.ndarray, planes: int) -> bytes:
    """A frame as the screen memory has it: plane by plane, every bit twice."""
    return doubled(np.swapaxes(planarize(index, planes), 0, 1).tobytes())


def framebuffer_crc(index: np.ndarray, planes: int) -> int:
    return zlib.crc32(framebuffer(index, planes))


def still(index: np.ndarray, palettes: list[list[int]], planes: int, y0: int = 0, y1: int = K.HEIGHT, band_rows: int = 0, band_colors: int = 0) -> dict[str, bytes]:
    """One frame as a stream of a single delta from black, its expected screen memory, and its picture."""
    black = np.zeros((planes, K.HEIGHT, K.ROW_BYTES), np.uint8)
    _, data, _ = delta.encode(black, np.swapaxes(planarize(index, planes), 0, 1))
    packet = put_packet(K.DELTA, data, put_palettes(palettes, band_colors))
    band = np.zeros(K.HEIGHT, int) if len(palettes) == 1 else np.clip((np.arange(K.HEIGHT) - y0) // band_rows, 0, len(palettes) - 1)
    colours = from_rgb444(np.array(palettes))[band[:, None], index]
    head = put_header(planes, y0, y1, 1, len(packet), band_rows=band_rows, band_colors=band_colors)
    return {"stream": head + packet, "framebuffer": framebuffer(index, planes), "picture": ppm(colours)}


def display_list(address: int, planes: int, y0: int, y1: int, palettes: list[list[int]], band_rows: int = 0, band_colors: int = 0) -> bytes:
    """The display co-processor's program that shows a frame buffer with its palettes by band.

    A MOVE is (register, value). Every screen line waits for its beam position, then sets the modulos that
    show a logical row twice; the first line of a band also writes the colours that change against the band
    above, and fills its slots with writes to the register that does nothing."""
    moves = [(0x8E, 0x2C81), (0x90, 0x2CC1), (0x92, 0x0038), (0x94, 0x00D0), (0x102, 0), (0x104, 0), (0x108, 0xFFD8), (0x10A, 0xFFD8)]
    for p in range(planes):
        place = address + p * K.HEIGHT * 2 * K.ROW_BYTES
        moves += [(0xE0 + 4 * p, place >> 16), (0xE2 + 4 * p, place & 0xFFFF)]
    moves += [(0x180 + 2 * i, c) for i, c in enumerate(palettes[0])]
    moves.append((0x100, planes << 12 | 0x200))
    starts = {FIRST_LINE + 2 * (y0 + band_rows * b): b for b in range(1, n_bands(y0, y1, band_rows))}
    for line in range(FIRST_LINE, FIRST_LINE + 2 * K.HEIGHT):
        if line == 256:
            moves.append((0xFFDF, 0xFFFE))
        moves.append(((line & 255) << 8 | 7, 0xFFFE))
        if line in starts:
            own, above = palettes[starts[line]], palettes[starts[line] - 1]
            change = [(0x180 + 2 * i, c) for i, c in enumerate(own) if i and c != above[i]][:band_colors]
            moves += change + [(0x1FE, 0)] * (band_colors - len(change))
        skip = 0 if line & 1 else 0xFFD8
        moves += [(0x108, skip), (0x10A, skip)]
    moves.append((0xFFFF, 0xFFFE))
    return b"".join(struct.pack(">HH", *m) for m in moves)
