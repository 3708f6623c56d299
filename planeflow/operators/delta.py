"""Delta and RLE rows: encode, parse, apply.

A row is planes x 20 bytes. Encoding compares two rows; nothing looks at another row, so decoding is one fold
for each (stream, row) instead of one for each stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .. import constants as K
from ..functions.cost import delta_cycles, rle_row_cycles


class Malformed(ValueError):
    """Bytes that the format doesn't allow."""


@dataclass
class Stats:
    rows: int = 0
    cols: int = 0
    bytes: int = 0
    full_rows: int = 0
    rle_rows: int = 0
    rle_cycles: int = 0

    def cycles(self, planes: int) -> int:
        return delta_cycles(planes, self.rows, self.cols, self.bytes, self.full_rows, self.rle_rows, self.rle_cycles)


def rle_tokens(row: bytes) -> tuple[bytes, int, int, int]:
    """(encoded, literals, repeats, tokens) of one plane's row: runs of three bytes or more are repeats."""
    out, literal, counts, i = bytearray(), bytearray(), [0, 0, 0], 0

    def flush():
        if literal:
            out.append(len(literal) - 1)
            out.extend(literal)
            counts[0] += len(literal)
            counts[2] += 1
            literal.clear()

    while i < len(row):
        j = i + 1
        while j < len(row) and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            flush()
            out += bytes((128 + j - i - 3, row[i]))
            counts[1] += j - i
            counts[2] += 1
        else:
            literal.extend(row[i:j])
        i = j
    flush()
    return bytes(out), *counts


def encode(hidden: np.ndarray, target: np.ndarray, rle: bool = False) -> tuple[int, bytes, Stats]:
    """(op, payload, statistics) that turn hidden into target; both are (planes, 128, 20) arrays.

    A changed row becomes RLE only if that saves bytes without costing cycles, and the packet stays RLE only
    if, with its count byte and entry cost, it is smaller and no slower than the plain delta."""
    planes = hidden.shape[0]
    differs = (hidden != target).any(0)
    plain: dict[int, bytes] = {}
    info: dict[int, tuple[int, bool]] = {}
    packed: dict[int, tuple[bytes, int]] = {}
    for y in np.flatnonzero(differs.any(1)).tolist():
        cols = np.flatnonzero(differs[y])
        mask = np.packbits(np.append(differs[y], np.zeros(4, bool))).tobytes()
        plain[y] = mask + target[:, y, cols].T.tobytes()
        info[y] = len(cols), len(cols) == K.ROW_BYTES
        if rle:
            parts = [rle_tokens(target[p, y].tobytes()) for p in range(planes)]
            body = bytes((y,)) + b"".join(p[0] for p in parts)
            cost = rle_row_cycles(planes, *(sum(p[i] for p in parts) for i in (1, 2, 3)))
            own = Stats(1, len(cols), len(cols) * planes, int(len(cols) == K.ROW_BYTES))
            if len(body) < len(plain[y]) and cost <= own.cycles(planes):
                packed[y] = body, cost

    def build(chosen: dict) -> tuple[bytes, Stats]:
        stats, bits, body = Stats(), np.zeros(K.HEIGHT, bool), b""
        for y, data in plain.items():
            stats.rows += 1
            if y in chosen:
                stats.cols += K.ROW_BYTES
                stats.bytes += K.ROW_BYTES * planes
                stats.rle_rows += 1
                stats.rle_cycles += chosen[y][1]
                continue
            n, full = info[y]
            stats.cols, stats.bytes, stats.full_rows = stats.cols + n, stats.bytes + n * planes, stats.full_rows + full
            bits[y] = True
            body += data
        out = np.packbits(bits).tobytes() + body
        if chosen:
            stats.rle_cycles += K.CYC_RLE_PACKET
            out += bytes((len(chosen),)) + b"".join(chosen[y][0] for y in sorted(chosen))
        return out, stats

    out, stats = build({})
    if packed:
        other, other_stats = build(packed)
        if len(other) < len(out) and other_stats.cycles(planes) <= stats.cycles(planes):
            return K.DELTA_RLE, other, other_stats
    return K.DELTA, out, stats


@dataclass
class RowWrite:
    """What a packet writes into one row: columns and their bytes (column-major), or the whole row."""

    y: int
    columns: list[int] = field(default_factory=list)
    data: bytes = b""
    rle: bool = False

    def apply(self, row: np.ndarray) -> None:
        if self.rle:
            row[:] = np.frombuffer(self.data, np.uint8).reshape(row.shape)
        else:
            row[:, self.columns] = np.frombuffer(self.data, np.uint8).reshape(len(self.columns), row.shape[0]).T


def parse(op: int, data: bytes, planes: int) -> tuple[list[RowWrite], int, Stats]:
    """(row writes, bytes used, statistics) of a delta; Malformed for anything the format forbids."""
    if len(data) < 16:
        raise Malformed("row map is cut off")
    at, out, stats = 16, [], Stats()
    for y in np.flatnonzero(np.unpackbits(np.frombuffer(data[:16], np.uint8))).tolist():
        if len(data) < at + 3:
            raise Malformed("column mask is cut off")
        if data[at + 2] & 15:
            raise Malformed("low bits of a column mask are set")
        cols = np.flatnonzero(np.unpackbits(np.frombuffer(data[at : at + 3], np.uint8))).tolist()
        size = len(cols) * planes
        body = data[at + 3 : at + 3 + size]
        if len(body) < size:
            raise Malformed("column bytes are cut off")
        out.append(RowWrite(y, cols, body))
        at += 3 + size
        stats.rows, stats.cols, stats.bytes, stats.full_rows = stats.rows + 1, stats.cols + len(cols), stats.bytes + size, stats.full_rows + (len(cols) == K.ROW_BYTES)
    if op == K.DELTA_RLE:
        if len(data) <= at:
            raise Malformed("RLE count is cut off")
        count, at, before = data[at], at + 1, -1
        if count > K.HEIGHT:
            raise Malformed("too many RLE rows")
        for _ in range(count):
            if len(data) <= at:
                raise Malformed("RLE row is cut off")
            y, at = data[at], at + 1
            if y >= K.HEIGHT or y <= before:
                raise Malformed("RLE rows are out of range or order")
            before, whole, counts = y, b"", [0, 0, 0]
            for _ in range(planes):
                row = b""
                while len(row) < K.ROW_BYTES:
                    if len(data) <= at:
                        raise Malformed("RLE token is cut off")
                    token = data[at]
                    if token < 128:
                        piece, at = data[at + 1 : at + 2 + token], at + 2 + token
                        if len(piece) <= token:
                            raise Malformed("RLE literal is cut off")
                        counts[0] += token + 1
                    else:
                        if len(data) <= at + 1:
                            raise Malformed("RLE run is cut off")
                        piece, at = data[at + 1 : at + 2] * ((token & 127) + 3), at + 2
                        counts[1] += len(piece)
                    counts[2] += 1
                    row += piece
                if len(row) > K.ROW_BYTES:
                    raise Malformed("RLE row is longer than a row")
                whole += row
            out.append(RowWrite(y, [], whole, True))
            stats.rows, stats.cols, stats.bytes = stats.rows + 1, stats.cols + K.ROW_BYTES, stats.bytes + K.ROW_BYTES * planes
            stats.rle_rows += 1
            stats.rle_cycles += rle_row_cycles(planes, *counts)
        stats.rle_cycles += K.CYC_RLE_PACKET if count else 0
    return out, at, stats


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins (with one more: the end)."""
    codes = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in column.to_pylist()]
    at = np.append(0, np.cumsum([len(c) for c in codes])).astype(np.int64)
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint32)).astype(np.int64), at


def row_runs(codes: np.ndarray, at: np.ndarray, width: int, least: int) -> tuple[np.ndarray, ...]:
    """(text, row, column, length) of runs of `least` equal symbols or more inside rows of `width` symbols."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(codes)) - at[text]
    new = place % width == 0
    new[1:] |= codes[1:] != codes[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(codes)))
    start, length = start[length >= least], length[length >= least]
    return text[start], place[start] // width, place[start] % width, length


def row_changes(codes: np.ndarray, at: np.ndarray, width: int, least_step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, changed columns, sum of steps of least_step or more) of each row of `width` symbols against the one above."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(codes)) - at[text]
    rows = -(-np.diff(at) // width)
    row = (np.cumsum(rows) - rows)[text] + place // width
    below = place >= width
    step = np.zeros(len(codes), np.int64)
    step[below] = np.abs(codes[below] - codes[np.flatnonzero(below) - width])
    changed = np.bincount(row[~below | (step > 0)], minlength=rows.sum())
    total = np.bincount(row, np.where(step >= least_step, step, 0), minlength=rows.sum()).astype(np.int64)
    return np.repeat(np.arange(len(rows)), rows), changed, total
