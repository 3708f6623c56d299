"""The whole-stream encoder: one fold a clip, and rate control around it."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from .. import constants as K
from ..functions.bits import planarize
from ..functions.cost import copy_cycles, late_vbls
from ..sources.bitstream import put_header, put_packet, put_palettes
from . import delta as D
from .quantize import from_rgb444, oklab

REPEAT_BOOST, CUT_EXTRA_LATE, ATTEMPTS = 1.5, 2, 6


@dataclass
class Settings:
    planes: int = 3
    y0: int = 0
    y1: int = K.HEIGHT
    threshold: float = 0.0
    min_hold: int = 1
    max_late: int = 2
    cycle_limit: int = 0
    rle: bool = False
    predict: str = "best"  # or hidden, visible
    audio_format: int = K.NO_AUDIO
    period: int = 0
    band_rows: int = 0
    band_colors: int = 0

    def __post_init__(self):
        good = {
            "planes": 1 <= self.planes <= 5, "active rows": 0 <= self.y0 < self.y1 <= K.HEIGHT, "threshold": self.threshold >= 0, "hold": self.min_hold >= 1, "lateness": self.max_late >= 0,
            "prediction": self.predict in ("best", "hidden", "visible"), "audio": self.audio_format in K.CYC_FILL and (not self.audio_format or self.period > 0),
            "bands": self.band_rows >= 0 and (not self.band_rows or 1 <= self.band_colors < 1 << self.planes),
        }
        if bad := [name for name, ok in good.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(bad)}")


@dataclass
class Encoded:
    content: bytes
    crcs: list[int]
    totals: dict

    def sidecar(self) -> bytes:
        return np.array(self.crcs, ">u4").tobytes()


class Encoder:
    """Palette-aware state of one clip: the two buffers, the palette in force and the player's clock."""

    def __init__(self, s: Settings):
        self.s = s
        self.visible = np.zeros((K.HEIGHT, K.WIDTH), np.uint8)
        self.hidden = self.visible.copy()
        self.free, self.last, self.palette = 0.0, 0, None
        self.fill_every = 2.0 * K.AUDIO_BUFFER * s.period if s.audio_format else 0.0
        self.fill_cost = float(K.CYC_FILL[s.audio_format])

    def row_colours(self, palettes: list[list[int]]) -> np.ndarray:
        """Each row's colours in Oklab, by its band."""
        y = np.arange(K.HEIGHT)
        band = np.zeros(K.HEIGHT, int) if len(palettes) == 1 else np.clip((y - self.s.y0) // self.s.band_rows, 0, len(palettes) - 1)
        return np.stack([oklab(from_rgb444(np.array(p))) for p in palettes])[band]

    def keep_old(self, ideal: np.ndarray, old: np.ndarray, lab: np.ndarray, threshold: float) -> np.ndarray:
        """The lossy filter: a pixel near enough stays; then a row whose errors add up to too little does."""
        out = ideal.copy()
        if threshold <= 0:
            return out
        a, b = self.s.y0, self.s.y1
        d = np.sqrt(((lab[a:b][np.arange(b - a)[:, None], ideal[a:b]] - lab[a:b][np.arange(b - a)[:, None], old[a:b]]) ** 2).sum(-1))
        out[a:b] = np.where(d < threshold, old[a:b], out[a:b])
        rest = np.where(out[a:b] != old[a:b], d, 0).sum(1)
        out[a:b] = np.where((rest < 4 * threshold)[:, None], old[a:b], out[a:b])
        return out

    def candidate(self, base, ideal, lab, start, due, limit, extra, copy):
        """(late, tries, size, copy, target, op, payload, cycles): the threshold doubles until it is in time."""
        s, threshold = self.s, self.s.threshold
        for tries in range(ATTEMPTS):
            target = self.keep_old(ideal, base, lab, threshold)
            op, payload, stats = D.encode(np.swapaxes(planarize(base, s.planes), 0, 1), np.swapaxes(planarize(target, s.planes), 0, 1), s.rle)
            cycles = stats.cycles(s.planes) + extra
            late = late_vbls(start, cycles, due, self.fill_every, self.fill_cost)
            small = not s.cycle_limit or cycles <= s.cycle_limit
            if small and (late <= limit or late_vbls(start, extra, due, self.fill_every, self.fill_cost) > limit):
                break
            threshold = threshold * 2 if threshold > 0 else 0.01
        else:
            tries = ATTEMPTS
        return late, tries, len(payload), copy, target, op, payload, cycles

    def step(self, n: int, ideal: np.ndarray, palettes: list[list[int]], new_scene: bool, audio: bytes, totals: dict) -> bytes:
        s = self.s
        lab = self.row_colours(palettes)
        due = 2.0 * n * K.CYCLES_PER_VBL
        if not new_scene and self.palette == palettes:
            held = s.min_hold > 1 and n - self.last < s.min_hold
            if held or (self.keep_old(ideal, self.visible, lab, s.threshold * REPEAT_BOOST) == self.visible).all():
                totals["repeats"] += 1
                return put_packet(K.REPEAT, audio=audio)
        start = -1e15 if n == 0 else self.free
        limit = s.max_late + (CUT_EXTRA_LATE if new_scene else 0)
        found = []
        if s.predict != "visible":
            found.append(self.candidate(self.hidden, ideal, lab, start, due, limit, 0, False))
        if s.predict != "hidden":
            base = self.hidden.copy()
            base[s.y0 : s.y1] = self.visible[s.y0 : s.y1]
            found.append(self.candidate(base, ideal, lab, start, due, limit, copy_cycles(s.planes, s.y1 - s.y0), True))
        late, tries, _, copy, target, op, payload, cycles = min(found, key=lambda c: c[:4])
        totals["deltas"] += 1
        totals["copies"] += copy
        totals["degraded"] += tries > 0
        totals["rle"] += op == K.DELTA_RLE
        totals["max_cycles"] = max(totals["max_cycles"], cycles)
        if new_scene and late > s.max_late:
            totals["late_cuts"] += 1
        elif late > 0:
            totals["late_frames"] += 1
            totals["worst_late"] = max(totals["worst_late"], late)
        self.free, self.last, self.palette = due + late * K.CYCLES_PER_VBL, n, palettes
        self.hidden, self.visible = self.visible, target
        return put_packet(op, payload, put_palettes(palettes, s.band_colors) if new_scene else b"", audio, copy)


def encode_stream(index: np.ndarray, scenes: dict[int, list[list[int]]], s: Settings, audio: list[bytes] | None = None) -> Encoded:
    """A stream of (frames, 128, 160) indices; scenes has each scene's first frame and palettes by band."""
    enc, body, crcs, palettes = Encoder(s), [], [], None
    totals = dict.fromkeys("repeats deltas copies degraded rle max_cycles late_cuts late_frames worst_late".split(), 0)
    totals["error"], totals["bad"] = 0.0, 0
    for n, ideal in enumerate(index):
        palettes = scenes.get(n, palettes)
        body.append(enc.step(n, ideal, palettes, n in scenes, audio[n] if audio else b"", totals))
        raw = np.array(palettes, ">u2").tobytes()
        crcs.append(zlib.crc32(enc.visible.tobytes() + raw))
        lab, rows = enc.row_colours(palettes)[s.y0 : s.y1], np.arange(s.y1 - s.y0)[:, None]
        d = np.sqrt(((lab[rows, enc.visible[s.y0 : s.y1]] - lab[rows, ideal[s.y0 : s.y1]]) ** 2).sum(-1))
        totals["error"] += float(d.mean()) if d.size else 0.0
        totals["bad"] += int((d > K.BAD_PIXEL).sum())
    payload = b"".join(body)
    head = put_header(s.planes, s.y0, s.y1, len(index), len(payload), 7 if totals["rle"] else 6, s.period, s.audio_format, s.band_rows, s.band_colors)
    totals["bytes"] = len(head) + len(payload)
    return Encoded(head + payload, crcs, totals)


def fit_to_budget(build, budget: int, doublings: int = 12, halvings: int = 10) -> tuple[float, Encoded]:
    """The threshold whose stream fits with the least error, of all that were tried: double, then bisect.

    Size isn't monotone in the threshold, so the best measured stream wins, not the least that fits; if none
    fits, the smallest."""
    tried = [(0.0, build(0.0))]
    if tried[0][1].totals["bytes"] > budget:
        low, high = 0.0, 0.01
        for _ in range(doublings):
            tried.append((high, build(high)))
            if tried[-1][1].totals["bytes"] <= budget:
                break
            low, high = high, high * 2
        for _ in range(halvings):
            middle = (low + high) / 2
            tried.append((middle, build(middle)))
            low, high = (low, middle) if tried[-1][1].totals["bytes"] <= budget else (middle, high)
    rank = lambda t: (0, t[1].totals["error"], t[0]) if t[1].totals["bytes"] <= budget else (1, t[1].totals["bytes"], t[0])
    return min(tried, key=rank)
