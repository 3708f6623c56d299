"""Quality rules as a short-circuit cascade.

Each rule is a cheap column computation and a predicate. On a bounded sample every rule's cost (CPU
seconds a document) and selectivity (share rejected) are measured; rules then run in order of rejections
per cost, each only on documents that all earlier rules let pass. The verdict doesn't depend on the order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import spans, texts, tidy
from ._words import U, Words, buffers, mix, windows

SAMPLE_ROWS = 2000
CHUNK = 2 << 20
REPEAT_WORDS = 5
SYMBOLS = b"#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Texts:
    """Texts of one chunk; what rules share is computed once, on demand, for chosen texts."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.data, self.offsets = buffers(column)
        self._words: Words | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.data, self.offsets)
        return self._words

    def take(self, rows: np.ndarray) -> Texts:
        return self if len(rows) == len(self) else Texts(self.column.take(pa.array(rows)))

    def bytes_in(self, wanted: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(wanted)] = True
        return self.per_text(table[self.data])

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.words.first).astype(np.int64)


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words: bytes that neither continue a character nor separate words."""
    table = (np.arange(256) & 0xC0) != 0x80
    table[[32, 9, 10, 11, 12, 13]] = False
    return t.per_text(table[t.data])


def n_symbols(t: Texts) -> np.ndarray:
    return t.bytes_in(SYMBOLS)


def n_dup_lines(t: Texts) -> np.ndarray:
    out = np.zeros(len(t), np.int64)
    raw, at = t.data.tobytes(), t.offsets
    for i in range(len(t)):
        lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        out[i] = len(lines) - len(set(lines))
    return out


def n_repeat_words(t: Texts) -> np.ndarray:
    """Words in windows of five words that the text has twice or more.

    Windows are told apart by a 64-bit hash of word hashes and text."""
    w, out = t.words, np.zeros(len(t), np.int64)
    if len(w) < REPEAT_WORDS:
        return out
    own = w.text_of()
    n = len(w) - REPEAT_WORDS + 1
    inside = np.flatnonzero(own[:n] == own[REPEAT_WORDS - 1 :])
    if not len(inside):
        return out
    key = mix(windows(w.hashes(), REPEAT_WORDS)[inside] + own[inside].astype(U) * U(0xE7037ED1A0B428DB))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w) + 1, np.int32)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + REPEAT_WORDS, -1)
    np.add.at(out, own[np.cumsum(cover[:-1]) > 0], 1)
    return out


def n_lines(t: Texts) -> np.ndarray:
    return t.per_text(t.data == 10) + 1


def n_upper(t: Texts) -> np.ndarray:
    return t.bytes_in(bytes(range(65, 91)))


def n_letters(t: Texts) -> np.ndarray:
    return t.bytes_in(bytes(range(65, 91)) + bytes(range(97, 123)))


def n_marks(t: Texts) -> np.ndarray:
    return t.bytes_in(b"!")


@dataclass(frozen=True)
class Rule:
    """rejects(values) is true where a document goes; values are the columns named in needs."""

    name: str
    needs: tuple[Callable[[Texts], np.ndarray], ...]
    rejects: Callable[..., np.ndarray]


BASE = (
    Rule("too_few_words", (n_words,), lambda n: n < 10),
    Rule("repeated_words", (n_words, n_repeat_words), lambda n, r: 100 * r > 20 * n),
)
RULES = (
    Rule("symbols", (n_words, n_symbols), lambda n, s: 10 * s > n),
    Rule("word_length", (n_words, word_chars), lambda n, c: (c < 2 * n) | (c > 12 * n)),
    Rule("capitals", (n_upper, n_letters), lambda u, a: 10 * u > 3 * a),
    Rule("exclamations", (n_words, n_marks), lambda n, m: 10 * m > n),
    Rule("duplicate_lines", (n_lines, n_dup_lines), lambda n, d: 10 * d > 4 * n),
)


class Values:
    """Columns of the alive texts, each computed once."""

    def __init__(self, t: Texts):
        self.texts, self.alive, self.cols = t, np.arange(len(t)), {}

    def get(self, f) -> np.ndarray:
        if f not in self.cols:
            self.cols[f] = f(self.texts)
        return self.cols[f]

    def drop(self, gone: np.ndarray) -> None:
        stay = np.flatnonzero(~gone)
        self.alive, self.cols = self.alive[stay], {f: x[stay] for f, x in self.cols.items()}
        self.texts = self.texts.take(stay)


def cascade(t: Texts, rules) -> tuple[np.ndarray, np.ndarray]:
    """kept, and the index of the rule that rejected a text (-1: none)."""
    by = np.full(len(t), -1, np.int32)
    v = Values(t)
    for i, rule in enumerate(rules):
        if not len(v.alive):
            break
        gone = rule.rejects(*(v.get(f) for f in rule.needs))
        by[v.alive[gone]] = i
        if gone.any():
            v.drop(gone)
    return by < 0, by


def chunks(batches, column: int):
    for batch in batches:
        col = texts(batch.column(column))
        sizes = np.diff(buffers(col)[1])
        for a, b in spans(sizes, CHUNK):
            yield batch.slice(a, b - a), Texts(col.slice(a, b - a))


def _measure(rules):
    def measure(batches):
        cost, gone, n = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for _, t in chunks(batches, 0):
            n += len(t)
            for i, rule in enumerate(rules):
                fresh, began = Texts(t.column), time.thread_time()
                bad = rule.rejects(*(f(fresh) for f in rule.needs))
                cost[i] += time.thread_time() - began
                gone[i] += int(bad.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(gone), pa.array([n] * len(rules), pa.int64())], ["rule", "cost", "gone", "n"])

    return measure


def plan_order(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules in order of rejections per CPU second, measured on at most sample_rows documents."""
    share = min(1.0, 1.2 * sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(share, seed=7).limit(sample_rows)
    found = sample.mapInArrow(_measure(rules), "rule int, cost double, gone long, n long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("gone").alias("gone"), F.sum("n").alias("n")).collect()
    by = {r["rule"]: r for r in found}
    out = [{"rule": r, "cost": by[i]["cost"] if i in by else 0.0, "rejected": by[i]["gone"] if i in by else 0, "sampled": by[i]["n"] if i in by else 0} for i, r in enumerate(rules)]
    return sorted(out, key=lambda x: (-x["rejected"] / max(x["cost"], 1e-9), x["rule"].name))


MEASURES = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)


def _score(rules, names):
    def score(batches):
        for batch, t in chunks(batches, 1):
            v = Values(t)
            base = np.zeros(len(t), bool)
            for rule in BASE:
                base |= rule.rejects(*(v.get(f) for f in rule.needs))
            cols = [pa.array(v.get(f)) for f in MEASURES]
            by = np.full(len(t), -1, np.int32)
            rest = np.flatnonzero(~base)
            known = {f: x[rest] for f, x in v.cols.items()}
            part = Values(t.take(rest))
            part.cols = known
            for i, rule in enumerate(rules):
                if not len(part.alive):
                    break
                gone = rule.rejects(*(part.get(f) for f in rule.needs))
                by[rest[part.alive[gone]]] = i
                if gone.any():
                    part.drop(gone)
            why = [None if x < 0 else names[x] for x in by.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(base), pa.array(~base & (by < 0)), pa.array(why, pa.string())], ["id", *(f.__name__ for f in MEASURES), "base_failed", "kept", "rejected_by"])

    return score


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: id, the five measures, base_failed, kept, rejected_by.

    rejected_by names the first rule of the measured order that rejects; it is null for kept documents and
    for those that fail the base rules. A null text counts as empty: it has no words, so it fails the base
    rules. Rows with equal or null identifiers are judged one by one. An empty table gives no rows."""
    order = [x["rule"] for x in plan_order(docs, rules, text_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(order, [r.name for r in order]), f"id {kind}, " + ", ".join(f"{f.__name__} long" for f in MEASURES) + ", base_failed boolean, kept boolean, rejected_by string")


def _keep(rules):
    def keep(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in spans(np.diff(buffers(texts(column))[1]), CHUNK):
                ok, _ = cascade(Texts(texts(column).slice(a, b - a)), rules)
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a).filter(pa.array(ok)) for c in batch.columns[:-1]], batch.schema.names[:-1])

    return keep


def quality_filter(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass the base rules and the cascade, with docs' own columns."""
    order = [x["rule"] for x in plan_order(docs, (*BASE, *rules), text_col)]
    return docs.withColumn("_pf_text", F.col(text_col).cast("string")).mapInArrow(tidy(_keep(order)), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), *(f.__name__ for f in MEASURES), "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i) WHERE len(ws) >= 5),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 5) AS s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
    len(string_split(text, chr(10))) AS n_lines
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
       OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_upper > 3 * n_letters
       OR 10 * n_marks > n_words OR 10 * n_dup_lines > 4 * n_lines) AS kept
FROM m
"""
