"""Source preparation: differences, scenes, repeated frames, cadence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def frame_differences(rows: DataFrame, clip: str = "clip_id") -> DataFrame:
    """(clip, frame, delta): the mean absolute byte difference to the frame before; null for the first."""
    before = F.lag("rgb").over(Window.partitionBy(clip, "y").orderBy("frame"))

    @F.pandas_udf("struct<total: long, n: long>")
    def differs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        total = [0 if y is None else int(np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).sum()) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"total": total, "n": [0 if y is None else len(y) for y in b]})

    each = rows.withColumn("d", differs("rgb", before))
    return each.groupBy(clip, "frame").agg((F.sum("d.total") / F.nullif(F.sum("d.n"), F.lit(0))).alias("delta"))


def upper_median(frame: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): element n div 2 of each key's sorted values, from counts of distinct values."""
    counts = frame.groupBy(key, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy(value)
    upto = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return upto.filter("upto > n div 2").groupBy(key).agg(F.min(value).alias("median"))


def cuts(frame: DataFrame, key: str, order: str, delta: str, threshold: float, shortest: int) -> DataFrame:
    """Adds pos (0, 1, ...) and cut: delta reaches the threshold at least `shortest` after the last cut.

    The first row counts as a cut. The state is the last accepted cut, so this is a fold over each key."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order).reset_index(drop=True)
        last, out = 0, []
        for i, d in enumerate(part[delta]):
            hit = i == 0 or (d is not None and d >= threshold and i - last >= shortest)
            last = i if hit else last
            out.append(hit)
        return part.assign(pos=np.arange(len(part)), cut=out)

    kinds = ", ".join(f"{c} {t}" for c, t in frame.dtypes)
    return frame.groupBy(key).applyInPandas(fold, f"{kinds}, pos long, cut boolean")


def scene_of(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Adds scene: the number of the last cut at or before each row; as-of by a running count."""
    return frame.withColumn("scene", (F.count_if("cut").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))


def repeated_frames(delta: np.ndarray) -> tuple[list[int], float, float]:
    """(frames to drop, interval, regularity) of a clip's frame differences (the first is ignored).

    Frames far below the median difference are candidates. If their distances have an upper median of 4 or
    more and 70 % lie within 1 of it, the pattern is followed cycle by cycle: in each the least difference
    within 1 of the expected place goes if it is small; if none is, the pattern runs on."""
    n = len(delta)
    if n < 50:
        return [], 0.0, 0.0
    d = np.append(1e9, delta[1:])
    median = np.sort(d[1:])[(n - 1) // 2]
    limit = min(max(median * 0.1, 0.05), 0.3)
    found = np.flatnonzero(d < limit)
    gaps = np.diff(found)
    if len(gaps) < 4:
        return [], 0.0, 0.0
    interval = float(np.sort(gaps)[len(gaps) // 2])
    regular = float((np.abs(gaps - interval) <= 1).mean())
    if interval < 4 or regular < 0.7:
        return [], interval, regular
    step, at, loose = int(interval + 0.5), int(found[0]), max(median * 0.25, limit)
    out = [at]
    while at + step - 1 < n:
        window = d[at + step - 1 : at + step + 2]
        best = at + step - 1 + int(window.argmin())
        hit = d[best] < loose
        at = best if hit else at + step
        if hit:
            out.append(best)
    return out, interval, regular


def drop_repeated(rows: DataFrame, differences: DataFrame, clip: str = "clip_id") -> DataFrame:
    """rows without repeated frames, and frames renumbered."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        gone, _, _ = repeated_frames(part["delta"].fillna(0).to_numpy())
        keep = part["frame"].to_numpy()[np.setdiff1d(np.arange(len(part)), gone)]
        return pd.DataFrame({clip: part[clip].iloc[0], "frame": keep, "to": np.arange(len(keep))})

    kept = differences.groupBy(clip).applyInPandas(find, f"{clip} string, frame int, to int")
    return rows.join(kept, [clip, "frame"]).withColumn("frame", F.col("to")).drop("to")


def source_frame(slot: Column, fps: Column, frames: Column) -> Column:
    """The source frame of a slot of 1 / 24.96 s: the nearest, the last one at the end."""
    return F.least(F.floor(slot * fps / K.FPS + 0.5), frames - 1).cast("int")


def blocks(frame: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds off (the bytes before) and block: 0 while the bytes up to and with the row fit, else 1."""
    upto = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("off", upto - F.col(size)).withColumn("block", F.when(upto <= limit, 0).otherwise(1))
