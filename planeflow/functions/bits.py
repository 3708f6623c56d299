"""Bytes, bit-planes and big-endian numbers: column expressions, and numpy for whole rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ROW_BYTES, WIDTH


def be(data: Column, offset: int, size: int) -> Column:
    """An unsigned big-endian number at a byte offset, as a long."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def put_be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def double_byte(v: Column) -> Column:
    """16 bits with every bit of a byte twice."""
    return sum((F.shiftleft(F.shiftright(v, i).bitwiseAND(1) * 3, 2 * i) for i in range(1, 8)), F.shiftright(v, 0).bitwiseAND(1) * 3)


def band_of(y: Column, y0: Column, y1: Column, band_rows: Column) -> Column:
    n = bands(y0, y1, band_rows)
    return F.when((n <= 1) | (y < y0), F.lit(0)).otherwise(F.least(F.floor((y - y0) / band_rows), n - 1)).cast("int")


def bands(y0: Column, y1: Column, band_rows: Column) -> Column:
    return F.when((band_rows <= 0) | (y1 <= y0), F.lit(1)).otherwise(F.ceil((y1 - y0) / band_rows)).cast("int")


def palette_words(colors: Column, n_bands: Column, band_colors: Column) -> Column:
    return colors + (n_bands - 1) * band_colors * 2


def planarize(index: np.ndarray, planes: int) -> np.ndarray:
    """(..., 160) palette indices to (..., planes, 20) bytes, bit 7 leftmost."""
    bits = (index[..., None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=-1)


def depack(rows: np.ndarray) -> np.ndarray:
    """(..., planes, 20) bytes to (..., 160) palette indices."""
    bits = np.unpackbits(rows, axis=-1)
    weight = (1 << np.arange(rows.shape[-2]))[:, None]
    return (bits * weight).sum(-2).astype(np.uint8)


def doubled(data: bytes) -> bytes:
    """Every bit twice, as the screen has it."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    return np.packbits(np.repeat(bits, 2)).tobytes()


assert ROW_BYTES * 8 == WIDTH
