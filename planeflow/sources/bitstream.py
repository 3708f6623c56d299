"""The bitstream: header, packets, side-car; reading, writing and validation."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bits import be

HEADER = ">4sHHHHBBHHHIIBBBB"
PACKET_SCHEMA = "stream_id string, n int, off long, len int, op int, flags int, alen int, palette binary, audio binary, video binary, errors array<string>"


def put_header(planes: int, y0: int, y1: int, packets: int, payload: int, version: int = 6, period: int = 0, audio: int = 0, band_rows: int = 0, band_colors: int = 0) -> bytes:
    return struct.pack(HEADER, K.MAGIC, version, int(audio != 0), K.WIDTH, K.HEIGHT, planes, 1 << planes, period, y0, y1, packets, payload, audio, band_rows, band_colors, 0)


def put_packet(op: int, video: bytes = b"", palette: bytes = b"", audio: bytes = b"", copy: bool = False) -> bytes:
    body = palette + audio + video
    size = 6 + len(body) + (len(body) & 1)
    if size > 0xFFFF:
        raise ValueError("a packet is longer than its length field allows")
    flags = (K.HAS_PALETTE if palette else 0) | (K.COPY if copy else 0)
    return struct.pack(">HBBH", size, op, flags, len(audio)) + body + b"\0" * (len(body) & 1)


def put_palettes(palettes: list[list[int]], band_colors: int) -> bytes:
    """The first band whole; each next one as (index, colour) pairs against the one above, padded by index 0."""
    out = struct.pack(f">{len(palettes[0])}H", *palettes[0])
    for above, own in zip(palettes[:-1], palettes[1:], strict=True):
        pairs = [(i, c) for i, (c, old) in enumerate(zip(own, above, strict=True)) if c != old]
        if len(pairs) > band_colors or own[0] != above[0]:
            raise ValueError("a band changes more colours than the format allows")
        for i, c in pairs + [(0, 0)] * (band_colors - len(pairs)):
            out += struct.pack(">HH", i, c)
    return out


def read_palettes(data: bytes, colors: int, n_bands: int, band_colors: int) -> list[list[int]]:
    out = [list(struct.unpack(f">{colors}H", data[: 2 * colors]))]
    pairs = struct.iter_unpack(">HH", data[2 * colors :])
    for _ in range(n_bands - 1):
        own = list(out[-1])
        for _ in range(band_colors):
            i, c = next(pairs)
            if i:
                own[i] = c
        out.append(own)
    return out


def n_bands(y0: int, y1: int, band_rows: int) -> int:
    return 1 if band_rows <= 0 or y1 <= y0 else -(-(y1 - y0) // band_rows)


def parse_headers(files: DataFrame) -> DataFrame:
    """(stream_id, content) to one row of header fields, with errors and the content."""
    b = F.col("content")
    names = {"version": (4, 2), "flags": (6, 2), "width": (8, 2), "height": (10, 2), "planes": (12, 1), "colors": (13, 1), "period": (14, 2), "y0": (16, 2), "y1": (18, 2), "packets": (20, 4), "payload": (24, 4), "audio_format": (28, 1), "band_rows": (29, 1), "band_colors": (30, 1)}
    out = files.withColumns({n: be(b, o, s).cast("long" if s == 4 else "int") for n, (o, s) in names.items()})
    bad = {
        "file is shorter than a header": F.length(b) < K.HEADER_BYTES,
        "no magic": F.substring(b, 1, 4) != F.lit(K.MAGIC),
        "unknown version": ~F.col("version").isin(*K.VERSIONS),
        "wrong size": (F.col("width") != K.WIDTH) | (F.col("height") != K.HEIGHT),
        "planes out of range": ~F.col("planes").between(1, 5),
        "colours do not match planes": F.col("colors") != F.expr("shiftleft(1, planes)"),
        "active rows out of range": (F.col("y0") > F.col("y1")) | (F.col("y1") > K.HEIGHT),
        "unknown audio format": ~F.col("audio_format").between(0, 3),
        "audio flag and format disagree": (F.col("flags").bitwiseAND(1) == 1) != (F.col("audio_format") != 0),
        "payload is cut off": F.length(b) < F.col("payload") + K.HEADER_BYTES,
    }
    errors = F.filter(F.array(*(F.when(test, F.lit(why)) for why, test in bad.items())), lambda x: x.isNotNull())
    return out.withColumn("errors", errors)


def walk(content: bytes) -> Iterator[tuple]:
    """The packets of one stream, in order; the walk ends at the first packet whose length can't be used."""
    fields = struct.unpack(HEADER, content[: K.HEADER_BYTES])
    planes, y0, y1, packets, payload, band_rows, band_colors = fields[5], fields[8], fields[9], fields[10], fields[11], fields[13], fields[14]
    palette_size = 2 * ((1 << planes) + (n_bands(y0, y1, band_rows) - 1) * band_colors * 2)
    at, end = K.HEADER_BYTES, min(len(content), K.HEADER_BYTES + payload)
    for n in range(packets):
        if at + 6 > end:
            yield n, at, 0, -1, 0, 0, None, None, None, ["packet is cut off"]
            return
        size, op, flags, alen = struct.unpack(">HBBH", content[at : at + 6])
        errors = []
        if size < 6 or size & 1 or at + size > end:
            yield n, at, size, op, flags, alen, None, None, None, ["packet length cannot be used"]
            return
        body, split = content[at + 6 : at + size], palette_size if flags & K.HAS_PALETTE else 0
        if split + alen > len(body):
            errors.append("palette and audio are longer than the packet")
        if op not in (K.DELTA, K.REPEAT, K.DELTA_RLE) or (op == K.DELTA_RLE and fields[1] < 7):
            errors.append("unknown operation")
        if op == K.REPEAT and flags & (K.HAS_PALETTE | K.COPY):
            errors.append("a repeat has a palette or a copy")
        if flags & ~(K.HAS_PALETTE | K.COPY):
            errors.append("unknown flags")
        yield n, at, size, op, flags, alen, body[:split] or None, body[split : split + alen], body[split + alen :], errors
        at += size


def packets(files: DataFrame) -> DataFrame:
    """One row per packet of every stream with a usable header: the chain of lengths is walked once a stream."""

    def split(batches):
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, *p) for p in walk(content)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
                kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 3, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in PACKET_SCHEMA.split(", ")])

    good = parse_headers(files).filter(F.size("errors") == 0).select("stream_id", "content")
    return good.mapInArrow(split, PACKET_SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, content) of every file under path; the path without a side-car.s .crc is the key, so a stream and its
    side-car share it."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"\.crc$", "").alias("stream_id"), "content")


def read_sidecar(files: DataFrame) -> DataFrame:
    """(stream_id, n, crc) of side-car files: a big-endian CRC-32 a frame, then one for the audio."""
    entries = F.floor(F.length("content") / 4).cast("int")
    each = F.transform(F.sequence(F.lit(0), entries - 1), lambda n: F.conv(F.hex(F.substring("content", n * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    return files.filter(entries > 0).select("stream_id", each.alias("all")).select("stream_id", F.posexplode("all").alias("n", "crc"))


def breakdown(parts: DataFrame) -> DataFrame:
    """Bytes by part of each stream."""
    size = lambda c: F.sum(F.coalesce(F.length(c), F.lit(0))).alias(c)
    return parts.groupBy("stream_id").agg(F.count("*").alias("packets"), (F.count("*") * 6).alias("headers"), size("palette"), size("audio"), size("video"), F.max("len").alias("largest"), F.max_by("n", F.struct("len", -F.col("n"))).alias("largest_n"))
