"""Exact dedup by a tree of merges over sorted digest runs.

Every partition sorts its digests into one run per digest range. In binomial rounds the runs of FAN
neighbouring partitions meet, range by range, and one multiway merge turns them into one run: equal
digests become one entry, whose identifier is the one that stays and whose count is the sum. After
ceil(log_FAN(partitions)) rounds each range is one run that knows every distinct text once. No entry
is larger than a digest, an identifier and a count, so a group of copies of any size costs one entry a run.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import NULL_ID, own_columns, texts, written
from ._words import buffers

FAN = 8
#: Distinct texts in one range's last run, at most about this many.
RANGE_ROWS = 400_000
LEAST_RANGES = 256

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
RUN = "run long, range int, short long, digest binary, n_bytes long, id long, copies long"


def digest_batches(batches):
    """SHA-256 of each text after lower-casing A-Z, and its length in bytes."""
    lower = bytes.maketrans(_UPPER, _LOWER)
    for batch in batches:
        data, at = buffers(texts(batch.column(1)))
        raw = data.tobytes().translate(lower)
        digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(at))], ["id", "digest", "n_bytes"])


def _merge(entries, keep_largest: bool):
    """One sorted run out of entries in order of (short, digest): a tuple for each digest.

    Entries whose short digests agree are told apart by the whole digest, and verified by length."""
    last = None
    for short, digest, n_bytes, key, copies in entries:
        if last is not None and last[1] == digest:
            if last[2] != n_bytes:
                raise ValueError("two texts of different lengths share a SHA-256 digest")
            if key is not None and (last[3] is None or (key > last[3] if keep_largest else key < last[3])):
                last[3] = key
            last[4] += copies
            continue
        if last is not None:
            yield last
        last = [short, digest, n_bytes, key, copies]
    if last is not None:
        yield last


def _run_table(run: int, part: int, rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([run] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
        ["run", "range", "short", "digest", "n_bytes", "id", "copies"],
    )


def _first_runs(ranges: int, keep_largest: bool):
    """Each task's own run: sorted as arrays, so a row costs its digest and three numbers."""

    def runs(batches):
        from pyspark import TaskContext

        run, ids, null, words, size = TaskContext.get().partitionId(), [], [], [], []
        worst = np.iinfo(np.int64).min if keep_largest else np.iinfo(np.int64).max
        for batch in batches:
            words.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64))
            ids.append(batch.column(0).fill_null(worst).to_numpy())
            null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            size.append(batch.column(2).to_numpy())
        if not words or not sum(map(len, ids)):
            return
        word, key, none, n = np.concatenate(words), np.concatenate(ids), np.concatenate(null), np.concatenate(size)
        order = np.lexsort(word.T[::-1])
        word, key, none, n = word[order], key[order], none[order], n[order]
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]).any(1)))
        least, most = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
        if (least != most).any():
            raise ValueError("two texts of different lengths share a SHA-256 digest")
        best = (np.maximum if keep_largest else np.minimum).reduceat(key, first)
        unknown = np.logical_and.reduceat(none, first)
        copies = np.diff(np.append(first, len(key)))
        short = word[first, 0]
        part = np.array([int(x) * ranges >> 64 for x in short.tolist()], np.int32)
        digests = word[first].astype(">u8").tobytes()
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)]
        signed = (short ^ np.uint64(1 << 63)).view(np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = pa.array([digests[32 * i : 32 * i + 32] for i in range(a, b)], pa.binary())
            columns = [pa.array(np.full(b - a, run, np.int64)), pa.array(part[a:b]), pa.array(signed[a:b]), own, pa.array(least[a:b]), pa.array(best[a:b], mask=unknown[a:b]), pa.array(copies[a:b])]
            yield pa.RecordBatch.from_arrays(columns, ["run", "range", "short", "digest", "n_bytes", "id", "copies"])

    return runs


def _merged(keep_largest: bool):
    def merge(key, table):
        runs: dict[int, list] = {}
        for run, *row in zip(*(table.column(c).to_pylist() for c in ("run", "short", "digest", "n_bytes", "id", "copies")), strict=True):
            runs.setdefault(run, []).append(row)
        for own in runs.values():  # the shuffle may deliver a run's pieces in any order
            own.sort(key=lambda r: r[:2])
        rows = list(_merge(heapq.merge(*runs.values(), key=lambda r: r[:2]), keep_largest))
        return pa.Table.from_batches([_run_table(key[0].as_py(), key[1].as_py(), rows)])

    return merge


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts
    the row with the largest (or smallest) identifier stays; a null identifier stays only where all are
    null. Rows that repeat an identifier and a text are all marked alike. An empty table gives no rows."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = written(rows.mapInArrow(digest_batches, "id long, digest binary, n_bytes long"), "digests")
    partitions, count = max(1, digests.rdd.getNumPartitions()), digests.count()
    ranges = max(LEAST_RANGES, 1 << int(count // RANGE_ROWS).bit_length())
    runs = digests.mapInArrow(_first_runs(ranges, keep == "largest"), RUN)
    while partitions > 1:
        runs = runs.groupBy(F.expr(f"run div {FAN}").alias("to"), "range").applyInArrow(_merged(keep == "largest"), RUN)
        partitions = -(-partitions // FAN)
    groups = runs.select("digest", F.col("id").alias("keep_id"), F.col("copies").alias("group_size"))
    return digests.join(groups.hint("merge"), "digest").select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with docs' own columns; of rows that repeat an identifier and a text, one."""
    groups = exact_groups(docs, id_col, text_col, keep)
    stay = groups.filter("kept").select(F.coalesce("id", F.lit(NULL_ID)).alias("_pf_key"), F.col("digest").alias("_pf_digest")).distinct()
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER.decode(), _LOWER.decode())
    keyed = docs.withColumns({"_pf_key": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_pf_digest": F.unhex(F.sha2(lowered, 256))})
    joined = keyed.join(stay, ["_pf_key", "_pf_digest"], "left_semi")
    return own_columns(joined.dropDuplicates(["_pf_key", "_pf_digest"]), docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
