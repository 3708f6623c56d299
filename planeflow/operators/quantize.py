"""Histograms, palettes, nearest colours and errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.color import TO_LAB, TO_LMS


def histogram(pixels: DataFrame, *keys: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"))


def nearest(palette: Column, distance) -> Column:
    """The index of the palette entry (an array column) at the least distance; of equals, the first."""
    ranked = F.transform(palette, lambda c, i: F.struct(distance(c).alias("d2"), i.alias("i")))
    return F.array_min(ranked)


def lookup(pixels: DataFrame, assigned: DataFrame, on: list[str]) -> DataFrame:
    """Each pixel's index by its colour, and 0 for a colour that has none."""
    return pixels.join(assigned, on, "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


def oklab(rgb: np.ndarray) -> np.ndarray:
    x = rgb / 255.0
    lin = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    return np.cbrt(lin @ np.array(TO_LMS).T) @ np.array(TO_LAB).T


def to_rgb444(rgb: np.ndarray) -> np.ndarray:
    n = (rgb.astype(int) * 15 + 127) // 255
    return n[..., 0] << 8 | n[..., 1] << 4 | n[..., 2]


def from_rgb444(c: np.ndarray) -> np.ndarray:
    return np.stack([c >> 8 & 15, c >> 4 & 15, c & 15], -1) * 17


def kmeans(rgb: np.ndarray, count: np.ndarray, colors: int, reserve_black: bool = True, rounds: int = 64, seed: int = 1) -> np.ndarray:
    """Up to `colors` RGB444 entries by weighted k-means in Oklab, black first if reserved.

    Input is sorted by colour, so the result depends on the histogram alone. An empty cluster takes the
    colour that is represented worst; entries that round to the same colour are filled up in the same way."""
    order = np.lexsort(rgb.T[::-1])
    rgb, w = rgb[order], count[order].astype(float)
    lab, rng = oklab(rgb), np.random.default_rng(seed)
    k = min(colors - reserve_black, len(rgb))
    fixed = oklab(np.zeros((1, 3))) if reserve_black else np.zeros((0, 3))
    if k <= 0:
        return np.zeros(1, int)
    d2 = np.full(len(lab), np.inf) if not reserve_black else ((lab - fixed) ** 2).sum(1)
    centres = []
    for _ in range(k):
        weight = w * np.where(np.isinf(d2), 1.0, d2)
        centres.append(lab[rng.choice(len(lab), p=weight / weight.sum())] if weight.sum() > 0 else lab[0])
        d2 = np.minimum(d2, ((lab - centres[-1]) ** 2).sum(1))
    centres, last = np.array(centres), None
    for _ in range(rounds):
        full = np.concatenate([fixed, centres])
        dist = ((lab[:, None] - full) ** 2).sum(-1)
        own = dist.argmin(1)
        if last is not None and (own == last).all():
            break
        last, cost = own, dist.min(1) * w
        for j in range(k):
            mine = own == j + len(fixed)
            if mine.any():
                centres[j] = np.average(lab[mine], axis=0, weights=w[mine])
            else:
                worst = int(cost.argmax())
                centres[j], cost[worst] = lab[worst], 0
    pick = ((lab[None] - centres[:, None]) ** 2).sum(-1).argmin(1)
    entries = list(dict.fromkeys(([0] if reserve_black else []) + to_rgb444(rgb[pick]).tolist()))
    every = to_rgb444(rgb)
    while len(entries) < min(colors, len(set(every.tolist()) | set(entries))):
        dist = ((lab[:, None] - oklab(from_rgb444(np.array(entries)))) ** 2).sum(-1).min(1) * w
        dist[np.isin(every, entries)] = -1
        entries.append(int(every[dist.argmax()]))
    return np.array(entries)


def palette_error(rgb: np.ndarray, count: np.ndarray, entries: np.ndarray) -> float:
    """The weighted mean Oklab distance to the nearest entry."""
    d = np.sqrt(((oklab(rgb)[:, None] - oklab(from_rgb444(entries))) ** 2).sum(-1)).min(1)
    return float((d * count).sum() / max(1, count.sum()))


def swap_colors(rgb: np.ndarray, count: np.ndarray, palette: np.ndarray, candidate: np.ndarray, most: int) -> np.ndarray:
    """palette with up to `most` entries replaced by candidate's, one at a time by what lowers the error most.

    The error is the weighted sum of Oklab distances. Colours are pooled by the high nibbles of their channels, each
    pool at its mean colour. A candidate in place of entry j changes each colour's distance from its nearest entry
    to the lesser of the candidate's and that of the nearest other entry, so all replacements come from sums by
    nearest entry. Entry 0 of either palette takes no part."""
    key = (rgb >> 4) @ np.array([256, 16, 1])
    kinds, own = np.unique(key, return_inverse=True)
    w = np.bincount(own, count)
    mean = np.stack([np.bincount(own, rgb[:, c] * count) / w for c in range(3)], 1)
    lab, out = oklab(np.floor(mean + 0.5)), palette.copy()
    offer = distance(lab[:, None], oklab(from_rgb444(candidate[1:])))
    for _ in range(most if len(out) > 1 and len(candidate) > 1 else 0):
        d = distance(lab[:, None], oklab(from_rgb444(out)))
        near, rows = d.argmin(1), np.arange(len(lab))
        first = d[rows, near]
        d[rows, near] = np.inf
        second = d.min(1)
        with_any = np.minimum(offer, first[:, None])
        loss = (np.minimum(offer, second[:, None]) - with_any) * w[:, None]
        error = np.stack([loss[near == j].sum(0) for j in range(1, len(out))]) + w @ with_any  # entry x candidate
        j, c = np.unravel_index(error.T.argmin(), error.T.shape)[::-1]
        if error[j, c] >= w @ first - 1e-9:
            break
        out[j + 1] = candidate[c + 1]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Oklab distances of colours that broadcast."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def snap(own: np.ndarray, above: np.ndarray, within: float = 0.02) -> np.ndarray:
    """A band's palette with colours of the band above where they are near: each entry in turn, from 1 on, takes the
    nearest one that no earlier entry took. Entries stay in their places."""
    out, free = own.copy(), np.ones(len(above), bool)
    free[0] = False
    d = distance(oklab(from_rgb444(own))[:, None], oklab(from_rgb444(above)))
    for c in range(1, len(own)):
        near = np.where(free, d[c], np.inf)
        u = int(near.argmin())
        if near[u] < within:
            out[c], free[u] = above[u], False
    return out


def palettes(hist: DataFrame, keys: list[str], colors: int) -> DataFrame:
    """(keys, i, rgb444, error) of each group of a histogram with columns r, g, b, n."""
    kinds = dict(hist.dtypes)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        rgb, n = part[["r", "g", "b"]].to_numpy(int), part["n"].to_numpy()
        entries = kmeans(rgb, n, colors)
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "i": np.arange(len(entries)), "rgb444": entries, "error": palette_error(rgb, n, entries)})

    return hist.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i int, rgb444 int, error double")


def hysteresis(index: np.ndarray, rgb: np.ndarray, entries: np.ndarray, stability: float) -> np.ndarray:
    """(frames, pixels) indices that keep the one before where it is not worse by more than `stability`."""
    lab, out = oklab(from_rgb444(entries)), index.copy()
    for t in range(1, len(out)):
        here = oklab(rgb[t])
        old, new = (np.sqrt(((here - lab[x]) ** 2).sum(-1)) for x in (out[t - 1], out[t]))
        out[t] = np.where(old <= new + stability, out[t - 1], out[t])
    return out


def attribution(error: Column, ideal_error: Column, shown: Column, held: Column, limit: float = K.BAD_PIXEL) -> Column:
    """Why a pixel is wrong: colours, held (it shows the ideal of the frame it was drawn for), compression."""
    return F.when(error <= limit, "good").when(ideal_error > limit, "colours").when(shown == held, "held").otherwise("compression")
