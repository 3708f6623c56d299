"""Line dedup: suffixes of line sequences by distributed prefix doubling.

A suffix starts at each line with a word. Its rank after round k is the position of the first suffix that
shares its first 2^k lines: equal ranks are equal prefixes, so the suffixes of one rank are the interval of
the suffix array whose common prefix is 2^k lines or longer. Round k + 1 ranks the pairs (own rank, rank of
the suffix 2^k lines on). A suffix that is alone with its prefix leaves, so later rounds hold repeats only;
rounds go on until none is left. A suffix with a rank smaller than its own position starts a run of 2^k lines
that stood before. The runs of MIN_LINES lines cover every maximal repeated run, whatever its length, and
their lines are deleted in all places but the first; so is a single line that stood before, if it has MIN_WORDS words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import row_key, written

#: A run has so many lines at least (a power of two), or one line of so many words.
MIN_LINES = 2
MIN_WORDS = 10
#: Positions are document number << LINE_BITS | line.
LINE_BITS = 24


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, doc): the distinct rows of docs, numbered from 0 in order of identifier and text hash."""
    keys = docs.select(*row_key(id_col, text_col)).distinct().repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
    keys = written(keys.withColumn("at", F.monotonically_increasing_id()), "documents")
    keys = keys.select("_id", "_h", F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND(2**33 - 1).alias("nth"))
    before, starts = 0, []
    for task, n in sorted(keys.groupBy("task").count().collect()):  # one row a task
        starts.append((task, before))
        before += n
    starts = docs.sparkSession.createDataFrame(starts, "task long, start long")
    return keys.join(F.broadcast(starts), "task").select("_id", "_h", (F.col("start") + F.col("nth")).alias("doc"))


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(_id, _h, line, run, covers): a run of `run` lines (a power of two) starting there has stood before, and
    `covers` lines go by it."""
    spark = docs.sparkSession
    rows = docs.select(*row_key(id_col, text_col), lines_of(F.col(text_col)).alias("lines")).select("_id", "_h", F.posexplode("lines").alias("line", "text"))
    long = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words if min_words else F.lit(False)
    line = F.when(F.col("line") >= 2**LINE_BITS, F.raise_error(F.lit("a document is beyond line positions")).cast("int")).otherwise(F.col("line"))
    rows = rows.select("_id", "_h", line.alias("line"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), long.alias("long"))
    rows = rows.join(numbered(docs, id_col, text_col), ["_id", "_h"]).select("_id", "_h", (F.shiftleft("doc", LINE_BITS) + F.col("line")).alias("pos"), "a", "b", "long")
    pairs = written(rows, "lines")
    found, length = [], 1
    while True:
        same = pairs.groupBy("a", "b").agg(F.min("pos").alias("rank"), F.max("pos").alias("last")).filter("rank < last").select("a", "b", "rank")
        same = written(same, "ranks")
        live = pairs.join(same, ["a", "b"]).select("_id", "_h", "pos", "rank", "long")
        live = written(live.dropDuplicates(["pos", "_h"]) if length == 1 else live, "suffixes")
        if live.isEmpty():
            break
        covers = F.lit(min_lines) if length == min_lines else F.when(F.col("long"), 1).otherwise(0) if length == 1 else F.lit(0)
        later = live.filter("rank < pos").withColumn("covers", covers).filter(F.lit(length >= min_lines) | (F.col("covers") > 0))
        found.append(later.select("_id", "_h", F.expr(f"pos & {2**LINE_BITS - 1}").cast("int").alias("line"), F.lit(length).alias("run"), "covers"))
        ahead = live.select("_h", (F.col("pos") - length).alias("pos"), F.col("rank").alias("b"))
        pairs = written(live.withColumnRenamed("rank", "a").join(ahead, ["pos", "_h"]), "pairs")
        length *= 2
    out = spark.createDataFrame([], "_id long, _h long, line int, run int, covers int")
    for part in found:
        out = out.unionByName(part)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """One row per input row: id, text (the lines kept, joined by \\n), n_lines, n_deleted, longest_run.

    Lines without a word are no lines and are left out. Of a run that occurs again, the first copy in order of
    identifier and line stays. A run has min_lines lines at least (a power of two), or is one line of min_words
    words or more (None: there are none). longest_run is the longest power of two of lines, from the run's start on, that
    has stood before; 0 if none. A null text has no lines. Rows equal in identifier and text count as one
    document and get the same result; null identifiers come first, and
    rows that share an identifier come in order of a hash of their texts. Documents must have fewer than 2^24
    lines; others raise an error. No rows give no rows."""
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines is a power of two")
    runs = repeated_runs(docs, id_col, text_col, min_lines, min_words)
    first = F.when(F.col("covers") > 0, F.sequence(F.col("line"), F.col("line") + F.col("covers") - 1)).otherwise(F.array().cast("array<int>"))
    spots = runs.groupBy("_id", "_h").agg(F.array_distinct(F.flatten(F.collect_list(first))).alias("gone"), F.max("run").alias("longest_run"))
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("_t"))
    both = rows.join(spots, ["_id", "_h"], "left").withColumn("lines", lines_of(F.col("_t")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # hashed, in order
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return both.select("id", F.array_join(kept, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"), "longest_run")


OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (
  SELECT doc_id, i, k, array_to_string(list_slice(ls, i, i + k - 1), chr(10)) AS g, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS words
  FROM l, (SELECT 1::BIGINT << x AS k FROM range(0, 24) AS p(x)) AS s, unnest(range(1, len(ls) - k + 2)) AS r(i) WHERE len(ls) >= k),
later AS (
  SELECT doc_id, i, k FROM (SELECT *, row_number() OVER (PARTITION BY k, md5(g) ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1 AND (k >= {MIN_LINES} OR k = 1 AND words >= {MIN_WORDS})),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(0, {MIN_LINES}) AS s(j) WHERE j < k AND k <= {MIN_LINES}),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
kept AS (SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.i) AS t, count(*) AS n FROM lines ANTI JOIN gone ON lines.doc_id = gone.doc_id AND lines.i = gone.i GROUP BY lines.doc_id),
longest AS (SELECT doc_id, max(k) AS longest_run FROM later GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_deleted,
  sha256(coalesce(t, '')) AS kept_sha256, CAST(coalesce(longest_run, 0) AS INTEGER) AS longest_run
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id LEFT JOIN longest ON l.doc_id = longest.doc_id
"""
