"""Substring dedup by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the least of its runs of SEED words, in an order by
hash in which seeds that are frequent in the corpus come last. Consecutive windows of a document that share
a minimiser travel as one packed string (their words, joined by spaces) to the minimiser's bucket. There
all windows of all strings are sorted and counted exactly: equal hashes are confirmed on the words.

Skew. Frequent seeds come last, so a common line or passage isn't a minimiser of the windows that only
touch it. Equal packed strings of a chunk become one, marked as repeated: the chunk itself answers all its
copies, so a passage that is everywhere costs a bucket one string a chunk, not one an occurrence. Buckets
are measured before anything travels; windows of one that is over-full go by a second minimiser, of another
order, too. Both depend on the window's words alone, so equal windows still meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import row_key, spans, texts
from ._words import U, Words, buffers, long_windows, mix, slide_min, windows

WINDOW = 35
SEED = 4
#: A seed is frequent above this share of a chunk's seeds; at most 1 / share of them can be.
FREQUENT = 1 / 5000
#: Bytes of text handled at once, and packed into one blob a bucket.
CHUNK = 2 << 20
FLUSH = 24 << 20
BUCKET_WORDS = 250_000
LEAST_BUCKETS = 512
#: A bucket of more packed words than this, or this share of the corpus' words if that is more, is over-full. A word is
#: packed WINDOW times at most (three times, mostly), so at most WINDOW / LEAST_SHARE buckets can be, whatever the input.
SPLIT_WORDS = 2_000_000
LEAST_SHARE = 4e-6

FLAGS = "id long, h long, start int, n int"
HOT = U(1 << 63)
SECOND = U(0x9FB21C651E98DF25)


def _seed_counts(batches):
    """(seed, its count, the chunk's words) for seeds that are frequent in a chunk; seed null: words only."""
    for batch in batches:
        col = texts(batch.column(0))
        for a, b in spans(np.diff(buffers(col)[1]), CHUNK):
            w = Words(*buffers(col.slice(a, b - a)))
            keys, counts = np.unique(windows(w.hashes(), SEED), return_counts=True)
            often = counts > max(8, FREQUENT * len(w))
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array([*keys[often].astype(np.int64).tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), 0], pa.int64()), pa.array([0] * n + [len(w)], pa.int64())], ["seed", "n", "words"])


def frequent_seeds(docs: DataFrame) -> tuple[list[int], int]:
    """Seeds of a share of FREQUENT or more, and the corpus' number of words.

    Counts below a chunk's threshold are not added, so a seed close to the share may be left out. The list
    has at most 1 / FREQUENT entries whatever the input. It only moves work between buckets: results don't
    depend on it."""
    counts = docs.mapInArrow(_seed_counts, "seed long, n long, words long").groupBy("seed").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    words = counts.filter("seed is null").agg(F.sum("words")).first()[0] or 0
    most = int(1 / FREQUENT)
    rows = counts.filter((F.col("seed").isNotNull()) & (F.col("n") > FREQUENT * words)).orderBy(F.desc("n"), "seed").limit(most).select("seed").collect()
    return sorted(r[0] for r in rows), int(words)


class _Minimisers:
    """Which windows of a chunk travel together, and to which bucket."""

    def __init__(self, hot: list[int], full: list[int], window: int, buckets: int):
        self.hot, self.full = np.sort(np.array(hot, np.int64).astype(U)), np.sort(np.array(full, np.int64))
        self.window, self.buckets = window, buckets

    def _least(self, seeds: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The least of each window's seeds by this order; frequent ones come last."""
        order = order >> U(1)
        if len(self.hot):
            order[_among(seeds, self.hot)] |= HOT
        return slide_min(order, self.window - SEED + 1)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (mix(key + U(1)) % U(self.buckets)).astype(np.int64)

    def runs(self, w: Words):
        """(own, start, count, key) of each run of windows with one key, start being its first word; None without windows."""
        n = len(w) - self.window + 1
        if n <= 0:
            return None
        own = w.text_of()
        valid = np.flatnonzero(own[:n] == own[self.window - 1 :])
        if not len(valid):
            return None
        seeds = windows(w.hashes(), SEED)
        key = self._least(seeds, mix(seeds))[valid]
        if len(self.full):
            over = _among(self.bucket(key), self.full)
            if over.any():
                second = self._least(seeds, mix(seeds ^ SECOND))[valid[over]]
                key[over] = mix(key[over] ^ mix(second))
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        start = valid[begin]
        return own[start], start, np.diff(np.append(begin, len(valid))), key[begin]


def _among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array that isn't empty."""
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def _bucket_words(hot: list[int], window: int, buckets: int):
    def count(batches):
        m = _Minimisers(hot, [], window, buckets)
        for batch in batches:
            col = texts(batch.column(0))
            for a, b in spans(np.diff(buffers(col)[1]), CHUNK):
                runs = m.runs(Words(*buffers(col.slice(a, b - a))))
                if runs is not None:
                    _, _, n, key = runs
                    own, at = np.unique(m.bucket(key), return_inverse=True)
                    words = np.bincount(at, n + window - 1, len(own)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words)], ["bucket", "words"])

    return count


def full_buckets(docs: DataFrame, hot: list[int], words: int, window: int, buckets: int) -> list[int]:
    """Buckets that would get more than SPLIT_WORDS packed words, or than LEAST_SHARE of the corpus' words if that is more.

    As the list of frequent seeds it only moves work: results don't depend on it."""
    counts = docs.mapInArrow(_bucket_words(hot, window, buckets), "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words"))
    return sorted(r[0] for r in counts.filter(F.col("words") > max(SPLIT_WORDS, int(words * LEAST_SHARE))).select("bucket").collect())


class _Packer:
    """Gathers super-k-mers; drain() gives a blob for each bucket and answers for strings that repeat here."""

    def __init__(self, minimisers: _Minimisers):
        self.minimisers, self.window, self.buckets = minimisers, minimisers.window, minimisers.buckets
        self.clear()

    def clear(self):
        self.strings: dict[bytes, int] = {}
        self.first: list[tuple] = []  # (key, id, h, start, windows) of each distinct string
        self.again: set[int] = set()
        self.flags: list[tuple] = []
        self.size = 0

    def add(self, ids, hs, column: pa.Array) -> None:
        w = Words(*buffers(column))
        runs = self.minimisers.runs(w)
        if runs is None:
            return
        row, start, count, key = runs
        data, at = w.joined()
        raw = data.tobytes()
        lo, hi = at[start].tolist(), (at[start + count + self.window - 1] - 1).tolist()
        for k, a, b, i, s, c in zip(key.tolist(), lo, hi, row.tolist(), (start - w.first[row]).tolist(), count.tolist(), strict=True):
            packed = raw[a:b]
            at_first = self.strings.setdefault(packed, len(self.first))
            if at_first == len(self.first):
                self.first.append((k, ids[i], hs[i], s, c))
                self.size += b - a + 120
            else:
                self.again.add(at_first)
                self.flags.append((ids[i], hs[i], s, c))

    def drain(self):
        if self.first:
            bucket = self.minimisers.bucket(np.fromiter((x[0] for x in self.first), U, len(self.first)))
            strings = list(self.strings)
            again = np.zeros(len(strings), bool)
            again[list(self.again)] = True
            info = np.array([x[1:] for x in self.first], np.int64)
            self.flags += [self.first[i][1:] for i in self.again]
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist() + [len(order)]
            out_bucket, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = order[a:b]
                body = b"\n".join(strings[i] for i in rows.tolist())
                part = info[rows].copy()
                part[again[rows], 3] = 0  # nobody waits for an answer: it is given here
                blobs.append(len(rows).to_bytes(4, "little") + part.T.tobytes() + body)
                out_bucket.append(int(bucket[rows[0]]))
            codec = pa.Codec("zstd", 3)
            packed = [len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in blobs]
            yield _rows(out_bucket, packed)
        if self.flags:
            yield from _flag_rows(np.array(self.flags, np.int64), self.buckets)
        self.clear()


def _rows(bucket: list[int], blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "blob"])


def _flag_rows(flags: np.ndarray, buckets: int):
    """Answers that are known already, as rows of their own: they only pass through, dealt out evenly."""
    for i in range(0, len(flags), 4096):
        part = flags[i : i + 4096]
        yield _rows([-1 - int((part[0, 0] * 31 + part[0, 2] + i) % buckets)], [part.T.tobytes()])


def _pack(hot: list[int], full: list[int], window: int, buckets: int):
    def pack(batches):
        p = _Packer(_Minimisers(hot, full, window, buckets))
        for batch in batches:
            ids, hs, col = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))
            for a, b in spans(np.diff(buffers(col)[1]), CHUNK):
                p.add(ids[a:b], hs[a:b], col.slice(a, b - a))
                if p.size > FLUSH:
                    yield from p.drain()
        yield from p.drain()

    return pack


def repeated_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, word) of each window that the strings hold twice or more, by sorting all windows."""
    at = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=at[1:])
    raw = b"".join(strings)
    w = Words(np.frombuffer(raw, np.uint8), at)
    own = w.text_of()
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.first
    valid = np.flatnonzero(own[:n] == own[window - 1 :])
    key = long_windows(w.hashes(), window)[valid]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    found = np.zeros(len(valid), bool)
    lo, hi = w.starts[valid].tolist(), w.ends[valid + window - 1].tolist()
    begin = np.flatnonzero(same & ~np.append(False, same[:-1]))
    stop = np.flatnonzero(same & ~np.append(same[1:], False)) + 2
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        rows = order[a:b].tolist()
        head = raw[lo[rows[0]] : hi[rows[0]]]
        if all(raw[lo[i] : hi[i]] == head for i in rows[1:]):
            found[rows] = True
        else:  # different windows with one hash: count their words
            seen: dict[bytes, list[int]] = {}
            for i in rows:
                seen.setdefault(raw[lo[i] : hi[i]], []).append(i)
            for same_text in seen.values():
                if len(same_text) > 1:
                    found[same_text] = True
    hit = valid[found]
    return own[hit], hit - w.first[own[hit]], w.first


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    size = int.from_bytes(blob[:4], "little")
    raw = pa.Codec("zstd").decompress(blob[4:], decompressed_size=size, asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    info = np.frombuffer(raw, np.int64, 4 * n, 4).reshape(4, n)
    return info, raw[4 + 32 * n :].split(b"\n")


def _flags(info: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(info[0]), pa.array(info[1]), pa.array(info[2].astype(np.int32)), pa.array(info[3].astype(np.int32))], ["id", "h", "start", "n"])


def _answer(blobs: list[bytes], window: int):
    infos, strings = [], []
    for blob in blobs:
        info, own = _unpack(blob)
        infos.append(info)
        strings += own
    info = np.concatenate(infos, axis=1)
    string, word, _ = repeated_windows(strings, window)
    asked = info[3][string] > 0
    string, word = string[asked], word[asked]
    if not len(string):
        return
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (word[1:] != word[:-1] + 1)
    begin = np.flatnonzero(new)
    own = string[begin]
    yield _flags(np.stack([info[0][own], info[1][own], info[2][own] + word[begin], np.diff(np.append(begin, len(string)))]))


def _count(window: int):
    def count(batches):
        bucket, held = None, []
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key < 0:
                    yield _flags(np.frombuffer(blob, np.int64).reshape(4, -1))
                    continue
                if key != bucket and held:
                    yield from _answer(held, window)
                    held = []
                bucket = key
                held.append(blob)
        if held:
            yield from _answer(held, window)

    return count


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, h, start, n): n windows from word start on, in the row with that key, occur elsewhere too.

    id and h are the row key of _shared.row_key."""
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("_t"))
    hot, words = frequent_seeds(rows.select("_t"))
    buckets = max(LEAST_BUCKETS, words // BUCKET_WORDS)
    full = full_buckets(rows.select("_t"), hot, words, window, buckets)
    packed = rows.mapInArrow(_pack(hot, full, window, buckets), "bucket long, blob binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), FLAGS)


def _cut(window: int, with_text: bool):
    def cut(batches):
        for batch in batches:
            col = texts(batch.column(1))
            for a, b in spans(np.diff(buffers(col)[1]), CHUNK):
                w = Words(*buffers(col.slice(a, b - a)))
                data, at = w.joined()
                raw = data.tobytes()
                removed, digests, kept = [], [], []
                for i, hits in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    if not hits:
                        text, gone = raw[at[lo] : max(at[lo], at[hi] - 1)], 0
                    else:
                        cover = np.zeros(hi - lo + 1, np.int64)
                        for hit in hits:
                            cover[hit["start"]] += 1
                            cover[hit["start"] + hit["n"] + window - 1] -= 1
                        bad = np.cumsum(cover[:-1]) > 0
                        gone = int(bad.sum())
                        text = b" ".join(raw[at[lo + j] : at[lo + j + 1] - 1] for j in np.flatnonzero(~bad).tolist())
                    removed.append(gone)
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if with_text else "")
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and the kept words joined by one space.

    Every word covered by a window that starts anywhere else too goes, the first copy included; windows are
    judged on the input. A null text has no words. A text shorter than a window is kept whole. Rows that
    repeat an identifier and a text hold the same windows twice, so both lose them. No rows give no rows."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("_t"))
    spots = repeated_spans(docs, id_col, text_col, window).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.join(spots.hint("merge"), ["_id", "_h"], "left").select("id", "_t", "hits")
    return found.mapInArrow(_cut(window, with_text), f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g
  FROM w, unnest(range(1, len(ws) - 33)) AS r(i) WHERE len(ws) >= 35),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(0, 35) AS s(k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
