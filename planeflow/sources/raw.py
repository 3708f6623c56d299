"""Data sources "rawvideo" and "rawpcm" (rgb24 frames, s16le samples; a partition a file), and "binaryrows" to write files."""

from __future__ import annotations

import glob
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import constants as K


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.start, self.count = options["path"], int(options.get("start", 0)), int(options.get("count", 1 << 60))

    def partitions(self):
        """path names files on storage that every executor mounts."""
        return [_File(p) for p in sorted(glob.glob(self.path))]


class _Video(_Reader):
    def read(self, part):
        size = K.WIDTH * K.HEIGHT * 3
        with open(part.path, "rb") as f:
            f.seek(self.start * size)
            for n in range(self.start, self.start + self.count):
                data = f.read(size)
                if len(data) < size:
                    return
                for y in range(K.HEIGHT):
                    yield Path(part.path).stem, n, y, data[y * K.WIDTH * 3 : (y + 1) * K.WIDTH * 3]


class _Pcm(_Reader):
    def __init__(self, options):
        super().__init__(options)
        self.channels = int(options.get("channels", 1))

    def read(self, part):
        with open(part.path, "rb") as f:
            f.seek(2 * self.channels * self.start)
            at = self.start
            while at < self.start + self.count and len(data := f.read(2 * self.channels * min(65536, self.start + self.count - at))) >= 2 * self.channels:
                whole = np.frombuffer(data[: len(data) // (2 * self.channels) * 2 * self.channels], "<i2").reshape(-1, self.channels)
                for row in whole.tolist():
                    yield Path(part.path).stem, at, row
                    at += 1


class RawVideo(DataSource):
    @classmethod
    def name(cls):
        return "rawvideo"

    def schema(self):
        return "clip_id string, frame int, y int, rgb binary"

    def reader(self, schema):
        return _Video(self.options)


class RawPcm(DataSource):
    @classmethod
    def name(cls):
        return "rawpcm"

    def schema(self):
        return "clip_id string, s long, v array<int>"

    def reader(self, schema):
        return _Pcm(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _RowWriter(DataSourceWriter):
    """Every row (name, content) becomes a file; files appear under their names when the whole job is done."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def write(self, rows):
        self.folder.mkdir(parents=True, exist_ok=True)
        names = []
        for name, content in rows:
            temporary = self.folder / f".{name}.{uuid.uuid4().hex}"
            temporary.write_bytes(bytes(content))
            names.append((str(temporary), name))
        return _Written(names)

    def commit(self, messages):
        for message in messages:
            for temporary, name in message.names if message else ():
                os.replace(temporary, self.folder / name)

    def abort(self, messages):
        for message in messages:
            for temporary, _ in message.names if message else ():
                Path(temporary).unlink(missing_ok=True)


class BinaryRows(DataSource):
    """Writes rows (name, content) as files of a folder that all executors mount."""

    @classmethod
    def name(cls):
        return "binaryrows"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _RowWriter(self.options["path"])


def frames(files: DataFrame) -> DataFrame:
    """(clip_id, content) of rgb24 files, from any store that Spark reads, to (clip_id, frame, y, rgb)."""
    row, size = K.WIDTH * 3, K.WIDTH * K.HEIGHT * 3

    def split(batches):
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in range(len(content) // size):
                    part = [content[f * size + y * row : f * size + (y + 1) * row] for y in range(K.HEIGHT)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * K.HEIGHT), pa.array([f] * K.HEIGHT, pa.int32()), pa.array(range(K.HEIGHT), pa.int32()), pa.array(part, pa.binary())], ["clip_id", "frame", "y", "rgb"])

    return files.select("clip_id", "content").mapInArrow(split, "clip_id string, frame int, y int, rgb binary")


def register(spark) -> None:
    spark.dataSource.register(RawVideo)
    spark.dataSource.register(RawPcm)
    spark.dataSource.register(BinaryRows)


def probe(text: str) -> dict:
    """A source's description from key=value lines: the first number that isn't 0 wins, the last field order."""
    out = {"width": 0, "height": 0, "fps": 0.0, "rate": 0, "duration": 0.0, "progressive": True}
    names = {"width": "width", "height": "height", "r_frame_rate": "fps", "sample_rate": "rate", "duration": "duration"}
    for line in text.splitlines():
        key, _, value = line.strip().partition("=")
        if key == "field_order":
            out["progressive"] = value in ("progressive", "unknown")
        elif key in names and not out[names[key]]:
            out[names[key]] = ratio(value) if key == "r_frame_rate" else type(out[names[key]])(float(value)) if value.replace(".", "", 1).isdigit() else out[names[key]]
    return out


def ratio(text: str) -> float:
    """num/den, and 0 where den is."""
    num, _, den = text.partition("/")
    return float(num) / float(den or 1) if float(den or 1) else 0.0
