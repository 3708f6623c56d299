"""Cost model, timeline and audio arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

#: A logical pixel's width by its height.
PIXEL_ASPECT = 16 / 15


def delta_cost(planes: Column, rows: Column, cols: Column, n_bytes: Column, full_rows: Column, rle_rows: Column | None = None, rle_cycles: Column | None = None) -> Column:
    """Cycles to decode a delta from its statistics; sparse, full and RLE rows have their own prices."""
    rle, extra = rle_rows if rle_rows is not None else F.lit(0), rle_cycles if rle_cycles is not None else F.lit(0)
    full = F.when(planes >= 3, full_rows).otherwise(0)
    row = F.when(planes >= 3, K.CYC_ROW).otherwise(K.CYC_ROW_FEW_PLANES)
    dense = full * K.ROW_BYTES * planes
    sparse = (rows - full - rle) * row + (cols - (full + rle) * K.ROW_BYTES) * K.CYC_COL
    literal = (n_bytes - dense - rle * K.ROW_BYTES * planes) * F.when(planes >= 5, K.CYC_BYTE_5).otherwise(K.CYC_BYTE)
    return sparse + literal + full * K.CYC_FULL_ROW + dense * F.when(planes >= 5, K.CYC_FULL_BYTE_5).otherwise(K.CYC_FULL_BYTE) + extra


def delta_cycles(planes: int, rows: int, cols: int, n_bytes: int, full_rows: int, rle_rows: int = 0, rle_cycles: int = 0) -> int:
    """delta_cost for plain numbers."""
    full = full_rows if planes >= 3 else 0
    row = K.CYC_ROW if planes >= 3 else K.CYC_ROW_FEW_PLANES
    byte, full_byte = (K.CYC_BYTE_5, K.CYC_FULL_BYTE_5) if planes >= 5 else (K.CYC_BYTE, K.CYC_FULL_BYTE)
    dense = full * K.ROW_BYTES * planes
    out = (rows - full - rle_rows) * row + (cols - (full + rle_rows) * K.ROW_BYTES) * K.CYC_COL
    return out + (n_bytes - dense - rle_rows * K.ROW_BYTES * planes) * byte + full * K.CYC_FULL_ROW + dense * full_byte + rle_cycles


def copy_cycles(planes: int, rows: int) -> int:
    return (K.CYC_COPY_5 if planes >= 5 else K.CYC_COPY) * planes * rows


def rle_row_cycles(planes: int, literals: int, repeats: int, tokens: int) -> int:
    return K.CYC_RLE_ROW + K.CYC_RLE_PLANE * planes + K.CYC_RLE_LITERAL * literals + K.CYC_RLE_REPEAT * repeats + K.CYC_RLE_TOKEN * tokens


def samples_through(n: Column, hz: float) -> Column:
    """Samples that the packets up to n carry: always even."""
    return (F.floor((n + 1) * (hz / K.FPS) / 2) * 2).cast("long")


def audio_bytes(form: Column, samples: Column) -> Column:
    return F.when(form.isin(K.FIB4, K.ADPCM), F.floor(samples / 2)).when(form == K.PCM8, samples).otherwise(0).cast("long")


def late_vbls(start: float, cost: float, due: float, fill_every: float = 0.0, fill_cost: float = 0.0) -> int:
    """VBLs by which work from `start` on misses `due`; all in cycles.

    An audio fill that is under way delays the start, and every fill that begins during the work makes it
    longer by its cost: q fills, the least q with (first + q) * every >= end + q * cost."""
    if fill_cost > 0:
        if start >= 0:
            start = max(start, math.floor(start / fill_every) * fill_every + fill_cost)
        first = max(0, math.ceil(start / fill_every))
        cost += fill_cost * max(0, math.ceil((start + cost - first * fill_every) / (fill_every - fill_cost)))
    return max(0, math.ceil((start + cost - due) / K.CYCLES_PER_VBL))


def stamp_cck(vbl: Column, line: Column, cck: Column) -> Column:
    return (vbl * K.LINES_PER_VBL + line) * K.CCK_PER_LINE + cck


def _even(x: Column) -> Column:
    """Rounded to a whole number, and that down to an even one."""
    return (F.floor(F.floor(x + 0.5) / 2) * 2).cast("int")


def picture(width: Column, height: Column, size: Column | None = None, aspect: Column | None = None) -> Column:
    """Where a source of width x height square pixels goes: cols, rows, x0, y0, and the scale of its area.

    aspect is letterbox (the whole picture), crop (the whole screen, so x0 or y0 may be negative) or stretch. size is
    the percentage that the picture takes up; a crop can't be smaller, so there the struct is null."""
    size, aspect = F.lit(100) if size is None else size, F.lit("letterbox") if aspect is None else aspect
    ratio = width / height
    across, down = _even(K.WIDTH * PIXEL_ASPECT / ratio), _even(K.HEIGHT * ratio / PIXEL_ASPECT)
    by_height = F.when(aspect == "letterbox", across > K.HEIGHT).when(aspect == "crop", across < K.HEIGHT)
    stretch = aspect == "stretch"
    cols = F.when(stretch, K.WIDTH).when(by_height, down).otherwise(K.WIDTH)
    rows = F.when(stretch, K.HEIGHT).when(by_height, K.HEIGHT).otherwise(across)
    small = size < 100
    cols, rows = (F.when(small, _even(x * size / 100.0)).otherwise(x) for x in (cols, rows))
    middle = lambda whole, x: ((whole - x) / 2).cast("int")
    scale = F.when((aspect != "crop") & (cols < K.WIDTH), K.WIDTH / cols).otherwise(1.0)
    box = F.struct(cols.alias("cols"), rows.alias("rows"), middle(K.WIDTH, cols).alias("x0"), middle(K.HEIGHT, rows).alias("y0"), scale.alias("scale"))
    return F.when(~((aspect == "crop") & small), box)
