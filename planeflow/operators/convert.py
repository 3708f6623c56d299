"""From raw frames and samples to a stream with its side-car, and to a bootable disk image.

The unit is a clip: the encoder's clock and rate control couple all its rows and frames.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import constants as K
from ..sources import disk
from . import audio, prepare, quantize
from .encode import Encoded, Settings, encode_stream, fit_to_budget

CONVERTED = "clip_id string, content binary, sidecar binary, image binary, frames int, scenes int, threshold double, bytes long, error double, bad long"


@dataclass
class Recipe:
    """What a conversion may choose: stream settings, scenes, dither, audio and the disk's own parts."""

    settings: Settings = field(default_factory=Settings)
    scene_threshold: float = 0.12
    shortest_scene: int = 6
    columns: int = K.WIDTH  # that the picture takes up; the rest is border
    dither: int = 0  # the side of the threshold matrix: 0, 2 or 4
    strength: float = 0.05
    stability: float = 0.0
    drop_repeated: bool = False
    budget: int = K.DISK_BYTES
    boot: bytes = b"DOS\0"
    player: bytes = bytes(16)


def distances(frames: np.ndarray, y0: int = 0, y1: int = K.HEIGHT, columns: int = K.WIDTH) -> np.ndarray:
    """The mean Oklab distance of each frame's active rows to the frame before, over the picture without its side
    borders; infinite for the first."""
    out, before = np.full(len(frames), np.inf), None
    for n, frame in enumerate(frames):
        lab = quantize.oklab(frame[y0:y1])
        if before is not None and lab.size:
            out[n] = quantize.distance(lab, before).mean() * K.WIDTH / columns
        before = lab
    return out


def cut_places(delta: np.ndarray, threshold: float, shortest: int) -> list[int]:
    """Frames that begin a scene: at the threshold, and `shortest` or more after the last one."""
    out = [0]
    for n in range(1, len(delta)):
        if delta[n] >= threshold and n - out[-1] >= shortest:
            out.append(n)
    return out


def mapped(frame: np.ndarray, entries: np.ndarray, y0: int = 0, dither: int = 0, strength: float = 0.0) -> np.ndarray:
    """Indices of the nearest entries; with a dither, after lightness has moved by the ordered threshold."""
    lab = quantize.oklab(frame)
    if dither:
        ranks = np.array(K.BAYER_2 if dither == 2 else K.BAYER_4).reshape(dither, dither)
        y, x = np.mgrid[y0 : y0 + frame.shape[0], : frame.shape[1]]
        lab[..., 0] += ((ranks[y % dither, x % dither] + 0.5) / dither**2 - 0.5) * strength
    flat, colours = lab.reshape(-1, 3), quantize.oklab(quantize.from_rgb444(entries))
    kinds, own = np.unique(flat, axis=0, return_inverse=True)
    near = ((kinds[:, None] - colours) ** 2).sum(-1).argmin(1)
    return near[own.ravel()].reshape(frame.shape[:2]).astype(np.uint8)


def scene_palettes(frames: np.ndarray, s: Settings) -> list[list[int]]:
    """One palette, or one a band: each next one is the band above's with what lowers its own error most swapped in."""
    colors = 1 << s.planes

    def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rgb, count = np.unique(rows.reshape(-1, 3), axis=0, return_counts=True)
        return rgb.astype(int), count

    step = s.band_rows or s.y1 - s.y0
    out: list[np.ndarray] = []
    for y in range(s.y0, s.y1, step):
        rgb, count = counted(frames[:, y : min(y + step, s.y1)])
        own = quantize.kmeans(rgb, count, colors)
        own = np.append(own, np.zeros(colors - len(own), int))
        out.append(quantize.swap_colors(rgb, count, out[-1], own, s.band_colors) if out else own)
    return [p.tolist() for p in out] or [[0] * colors]


def indexed(frames: np.ndarray, cuts: list[int], recipe: Recipe) -> tuple[np.ndarray, dict[int, list[list[int]]]]:
    """All frames' indices, and each scene's palettes by its first frame; rows that aren't active are 0."""
    s, index, scenes = recipe.settings, np.zeros(frames.shape[:3], np.uint8), {}
    for first, end in zip(cuts, [*cuts[1:], len(frames)], strict=True):
        scenes[first] = scene_palettes(frames[first:end], s)
        step = s.band_rows or s.y1 - s.y0
        for b, y in enumerate(range(s.y0, s.y1, step)):
            rows, entries = slice(y, min(y + step, s.y1)), np.array(scenes[first][b])
            for n in range(first, end):
                index[n, rows] = mapped(frames[n, rows], entries, y, recipe.dither, recipe.strength)
            if recipe.stability > 0:
                part = index[first:end, rows]
                flat = quantize.hysteresis(part.reshape(len(part), -1), frames[first:end, rows].reshape(len(part), -1, 3), entries, recipe.stability)
                index[first:end, rows] = flat.reshape(part.shape)
    return index, scenes


def audio_parts(samples: np.ndarray, frames: int, s: Settings) -> tuple[list[bytes], int]:
    """Each packet's audio bytes, and the checksum of all samples that will sound.

    Samples are in -32768..32767; what is missing at the end is silence."""
    hz = K.PAULA_HZ / s.period
    places = audio.slices(1 << 40, frames, hz)
    whole = np.append(samples, np.zeros(max(0, places[-1][1] - len(samples))))[: places[-1][1]]
    data = audio.encode_samples(whole, s.audio_format)
    size = 1 if s.audio_format == K.PCM8 else 2  # samples a byte
    return [data[a // size : b // size] for a, b in places], zlib.crc32(audio.decode_bytes(data, s.audio_format).tobytes())


def convert(frames: np.ndarray, recipe: Recipe, samples: np.ndarray | None = None) -> tuple[float, Encoded, bytes, list[int]]:
    """(threshold, stream, disk image, scene starts) of (frames, 128, 160, 3) bytes.

    The side-car has a checksum a frame and, with audio, one more of all samples. The stream that is returned is
    measured, not estimated: the threshold's own encoding goes on the disk."""
    delta = distances(frames, recipe.settings.y0, recipe.settings.y1, recipe.columns)
    if recipe.drop_repeated:
        gone, _, _ = prepare.repeated_frames(delta)
        frames, delta = np.delete(frames, gone, 0), np.delete(delta, gone)
    cuts = cut_places(delta, recipe.scene_threshold, recipe.shortest_scene)
    index, scenes = indexed(frames, cuts, recipe)
    parts, checksum = audio_parts(samples, len(frames), recipe.settings) if recipe.settings.audio_format else (None, None)
    room = min(recipe.budget, disk.room(recipe.player))
    threshold, stream = fit_to_budget(lambda t: encode_stream(index, scenes, replace(recipe.settings, threshold=t), parts), room)
    if checksum is not None:
        stream.crcs.append(checksum)
    return threshold, stream, disk.assemble(recipe.boot, recipe.player, stream.content), cuts


def convert_clips(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per clip of (clip_id, frame, y, rgb) rows, as CONVERTED says; a clip without rows has none."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame", "y"])
        frames = np.frombuffer(b"".join(map(bytes, part["rgb"])), np.uint8).reshape(-1, K.HEIGHT, K.WIDTH, 3)
        threshold, out, image, cuts = convert(frames, recipe)
        t = out.totals
        return pd.DataFrame([(part["clip_id"].iloc[0], out.content, out.sidecar(), image, len(out.crcs), len(cuts), threshold, t["bytes"], t["error"], t["bad"])], columns=[c.split()[0] for c in CONVERTED.split(", ")])

    return rows.groupBy("clip_id").applyInPandas(run, CONVERTED)
