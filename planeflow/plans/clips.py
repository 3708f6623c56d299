"""Small clips out of the events table, encoded to streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.encode import Settings, encode_stream
from ..operators.quantize import from_rgb444

FRAMES = 12
FILES = "stream_id string, content binary, sidecar binary, deltas long, repeats long, bytes long, worst_late long, error double"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame, y, x, v): a clip an event type; at most FRAMES x 128 x 160 rows each, by aggregation."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = e.select(F.col("event_type").alias("stream_id"), F.pmod("event_id", F.lit(FRAMES)).cast("int").alias("frame"), F.pmod(F.floor("value"), F.lit(K.HEIGHT)).cast("int").alias("y"), F.pmod(F.col("user_id") * 7, F.lit(K.WIDTH)).cast("int").alias("x"), (F.pmod("user_id", F.lit(7)) + 1).cast("int").alias("v"))
    return at.groupBy("stream_id", "frame", "y", "x").agg(F.max("v").alias("v"))


def indices(part: pd.DataFrame) -> np.ndarray:
    """The clip's frames; each pixel brings a block of eight with it, and every fourth frame is a repeat."""
    out = np.zeros((FRAMES, K.HEIGHT, K.WIDTH), np.uint8)
    for f, y, x, v in part[["frame", "y", "x", "v"]].sort_values(["frame", "y", "x"]).itertuples(index=False):
        out[f, y, x // 8 * 8 : x // 8 * 8 + 8] = v
    for f in range(3, FRAMES, 4):
        out[f] = out[f - 1]
    return out


def scenes(planes: int) -> dict[int, list[list[int]]]:
    colors = 1 << planes
    return {0: [[c * 0x111 % 4096 for c in range(colors)]], 6: [[(c * 0x123 + 5) % 4096 if c else 0 for c in range(colors)]]}


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, content, sidecar, ...): every clip's stream and side-car."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = encode_stream(indices(part), scenes(3), Settings(rle=True))
        t = out.totals
        return pd.DataFrame([(part["stream_id"].iloc[0], out.content, out.sidecar(), t["deltas"], t["repeats"], t["bytes"], t["worst_late"], t["error"])], columns=[c.split()[0] for c in FILES.split(", ")])

    return pixels(spark, sf_dir).groupBy("stream_id").applyInPandas(run, FILES)


def trial(part: pd.DataFrame, config: dict) -> dict:
    """One configuration's result for a clip."""
    planes = int(config["planes"])
    index = np.minimum(indices(part), (1 << planes) - 1)
    out = encode_stream(index, scenes(planes), Settings(planes=planes, min_hold=int(config["hold"])))
    t = out.totals
    return {"ok": True, "fits": t["bytes"] < 60_000, "worst_late": int(t["worst_late"]), "raised": t["degraded"] > 0, "bad": float(round(100 * t["bad"] / index.size, 6))}


#: Colours of raw frames, by value.
COLOURS = (0x000, 0xF00, 0x0F0, 0x00F, 0xFF0, 0x0FF, 0xF0F, 0xFFF)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, frame, y, rgb): raw frames out of the events, in blocks of eight pixels; every fourth frame is
    the one before again."""
    at = pixels(spark, sf_dir).groupBy("stream_id", "frame", "y", F.expr("x div 8").alias("block")).agg(F.max("v").alias("v"))
    shown = at.filter("frame % 4 <> 3").withColumn("frame", F.explode(F.expr("if(frame % 4 = 2, array(frame, frame + 1), array(frame))")))
    grid = at.select("stream_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(K.HEIGHT - 1))))
    rows = shown.groupBy("stream_id", "frame", "y").agg(F.map_from_entries(F.collect_list(F.struct("block", "v"))).alias("blocks"))
    table = F.array(*(F.lit(bytes(from_rgb444(np.array(c)).astype(np.uint8)) * 8) for c in COLOURS))
    block = lambda b: F.get(table, F.coalesce(F.try_element_at("blocks", b), F.lit(0)))
    rgb = F.concat(*(block(F.lit(b).cast("long")) for b in range(K.WIDTH // 8)))
    return grid.join(rows, ["stream_id", "frame", "y"], "left").select(F.col("stream_id").alias("clip_id"), "frame", "y", rgb.alias("rgb"))
