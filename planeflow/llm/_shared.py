"""What the operators share: tables cut from their lineage, row keys, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier in internal join keys.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset: one in the warehouse, which executors
    share, or for a single local process a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/planeflow-tables"
        if not hasattr(spark, "_planeflow_dir"):
            spark._planeflow_dir = f"file://{tempfile.mkdtemp(prefix='planeflow-')}"
        named = spark._planeflow_dir
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation.

    Results read such tables lazily, so nothing deletes them; the folder planeflow may go after a job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planeflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two non-null columns, _id and _h, that tell apart rows whose identifiers repeat or are null.

    Rows equal in both identifier and text share a key; they get the same result."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h")]


def join_rows(docs: DataFrame, found: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs joined with found on row_key's columns (_id and _h in found); docs' own columns may have any name."""
    key, text = row_key(id_col, text_col)
    keyed = docs.withColumns({"_pf_join_id": key, "_pf_join_h": text})
    return keyed.join(found.withColumnsRenamed({"_id": "_pf_join_id", "_h": "_pf_join_h"}), ["_pf_join_id", "_pf_join_h"], how)


def own_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def release() -> None:
    """Give what is free in this process back to the system: Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(f):
    """f for mapInArrow, with release() after its last batch: a worker process outlives its task by many others."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def spans(sizes, most: int):
    """(first, last) of neighbouring rows whose sizes add up to most at most; a larger row stands alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)
