"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, mixing, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeflow.llm._shared import join_rows, own_columns, written
from planeflow.llm.exact_dedup import exact_dedup
from planeflow.llm.mixing import mix_rates, quality_domains
from planeflow.llm.near_dedup import near_dedup
from planeflow.llm.packing import pack
from planeflow.llm.quality_rules import quality_filter

#: Token shares after mixing, and the tokens wanted against those that came in. Poor documents are the rules'
#: business, so here the domains are good and toxic: the toxic ones are thinned out, and good ones repeat to make up.
TARGETS = {"good": 0.995, "toxic": 0.005}
BUDGET = 1.0
#: Executors come to packing with their heaps full from the stages before, so its workers keep less than op10_packing's.
PACK_CHUNK = 1 << 20
PACK_CACHE = 16 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, in expectation; copies repeat the row. The fit holds rates of
    documents that are more likely good than not at 1 or more, so they stay.

    Without labelled documents in docs the posteriors are flat, and rates only follow the budget."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mix_rates(docs, quality_domains(labels), TARGETS, budget=BUDGET, keep="good")
    rates = rates.select("_id", "_h", "copies").dropDuplicates(["_id", "_h"])
    kept = join_rows(docs, rates.filter("copies > 0").withColumnRenamed("copies", "_pf_copies"), "inner")
    return own_columns(kept.withColumn("_pf_copy", F.explode(F.sequence(F.lit(1), F.col("_pf_copies").cast("int")))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, chunk=PACK_CHUNK, cache_bytes=PACK_CACHE).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: Order MinHash, the classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
