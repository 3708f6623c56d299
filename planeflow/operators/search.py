"""Configuration search: the grid, and which of its results wins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANES, HOLDS, SIZES = (5, 4, 3), (2, 3, 4, 5, 6), (100, 95, 90, 85, 80)


def grid(spark: SparkSession, sizes=SIZES) -> DataFrame:
    """One row per configuration: cfg_id, planes, hold, size."""
    rows = [(i, p, h, s) for i, (s, p, h) in enumerate((s, p, h) for s in sizes for p in PLANES for h in HOLDS)]
    return spark.createDataFrame(rows, "cfg_id int, planes int, hold int, size int")


def usable(max_late: int, allow_raised: bool = False):
    return F.col("ok") & F.col("fits") & (F.col("worst_late") <= max_late) & (F.lit(allow_raised) | ~F.col("raised"))


def winner(results: DataFrame, key: str, max_late: int = 2, within: float = 2.0) -> DataFrame:
    """Each key's choice: of the usable ones within 2 points of the least error, most planes, then the largest
    size, then the least error. Results with a raised threshold only count where no others are usable."""
    good = results.filter(usable(max_late, True))
    plain = good.groupBy(key).agg(F.min("raised").alias("_raised"))
    good = good.join(plain, key).filter("raised = _raised")
    least = good.groupBy(key).agg(F.min("bad").alias("_bad"))
    near = good.join(least, key).filter(F.col("bad") <= F.col("_bad") + within)
    best = F.min(F.struct(-F.col("planes"), -F.col("size"), F.col("bad"), F.col("cfg_id")))
    return near.groupBy(key).agg(best.alias("b")).select(key, F.col("b.cfg_id").alias("cfg_id"), (-F.col("b.col1")).alias("planes"), (-F.col("b.col2")).alias("size"), F.col("b.bad").alias("bad"))


def finer(pick: DataFrame, sizes=SIZES, step: int = 2) -> DataFrame:
    """Configurations that may be larger than each pick (its columns, with planes, hold, size and raised): every `step`
    points up to the next size of the list. Picks with a raised threshold have none."""
    above = F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, sizes)), lambda s: s > F.col("size"))), F.lit(102))
    last = F.least(above - 1, F.lit(100))
    return pick.filter(~F.col("raised") & (F.col("size") + step <= last)).withColumn("size", F.explode(F.sequence(F.col("size") + step, last, F.lit(step))))


def finest(pick: DataFrame, results: DataFrame, key: str, max_late: int = 2) -> DataFrame:
    """Each pick at the largest of its own size and the sizes that were usable among the finer ones."""
    best = results.filter(usable(max_late)).groupBy(key).agg(F.max("size").alias("_size"))
    return pick.join(best, key, "left").withColumn("size", F.greatest("size", "_size")).drop("_size")


def evaluate(clips: DataFrame, configs: DataFrame, run: Callable[[pd.DataFrame, dict], dict], schema: str, key: str = "clip_id") -> DataFrame:
    """run(the clip's rows, configuration) for every clip and configuration: one task each, the clip read once."""
    names = configs.columns
    both = clips.join(F.broadcast(configs))  # the grid has a few dozen rows by construction

    def work(part: pd.DataFrame) -> pd.DataFrame:
        config = {n: part[n].iloc[0] for n in names}
        return pd.DataFrame([{key: part[key].iloc[0], **config, **run(part.drop(columns=names), config)}])

    return both.groupBy(key, "cfg_id").applyInPandas(work, schema)


def longest(probe: Callable[[list[int]], dict[int, bool]], low: int, high: int, ways: int = 4) -> int:
    """The longest duration that passes, by n-section: each round probes `ways` points at once."""
    while high - low > 1:
        points = sorted({low + (high - low) * i // (ways + 1) for i in range(1, ways + 1)} - {low, high}) or [low + 1]
        said = probe(points)
        passed = [p for p in points if said[p]]
        failed = [p for p in points if not said[p] and p > max(passed, default=low)]
        low, high = max(passed, default=low), min(failed, default=high)
    return low
