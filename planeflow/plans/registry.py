"""The library's queries, their SQL and the flagship query."""

from pyspark.sql import DataFrame, SparkSession

from . import queries as Q


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stream_verify(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, (f, _) in Q.ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.ALL.items() if sql}
