"""Mixing sources to target weights with soft membership.

A naive Bayes classifier over hashed words, counted on a bounded sample of the labelled table, gives each
document a posterior over domains. Document rates r >= 0 then minimise

    sum over domains k of (sum_d r_d n_d p_dk / T - w_k)^2 + RIDGE * sum_d (n_d / T) (r_d - 1)^2

by projected gradient. At the minimum a document's rate is the projection on r >= its least rate of 1 - posterior .
pull, where pull is what the domains miss divided by RIDGE; and the rates of a pull that is not there yet give the
gradient of the dual, a vector of K numbers. So each round projects every document's rate anew, sums what the domains
have at these rates, and moves the pull along the gradient, scaled with the Gram matrix of the documents that are not
at their bound; a step that does not bring the gradient down is halved. No rates are stored between rounds, and the
driver sees K * (K + 1) sums a round, nothing of a document. Rounds that end without the tolerance raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import row_key, written

#: Labelled documents that the classifier counts, at most; chosen by a hash of their identifier.
TRAIN_ROWS = 20_000
#: Entries of the hashed word table, the bound on what is broadcast.
BUCKETS = 32_768
ROUNDS = 100
TOLERANCE = 1e-7
#: Weight of staying near rate 1. It bounds rates by 1 + 1 / RIDGE, and misses targets by RIDGE times a pull.
RIDGE = 1e-3
#: How much a text's evidence grows with its words: the log likelihood ratio is times n ** (POWER - 1).
POWER = 0.85

#: Target shares of tokens by domain.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")


def _bucket(word: Column) -> Column:
    """Words that end in a symbol count as that symbol, others by themselves, in lower case and without
    punctuation at the end."""
    end = F.substring(word, -1, 1)
    return F.pmod(F.xxhash64(F.when(end.isin(*"#*$%&|<>!~^{}[]"), end).otherwise(F.lower(F.rtrim(word, F.lit('.,;:?'))))), F.lit(BUCKETS)).cast("int")


def word_weights(docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """log P(bucket | domain) and log P(domain), smoothed; a domain without rows gets a uniform table."""
    chosen = domains.filter(F.col("domain").isin(names) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.min("domain").alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("_i"), "_i").limit(rows)
    words = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_i").select("domain", F.posexplode(_words(F.col("_t"))).alias("p", "w"))
    counts = words.groupBy("domain", _bucket(F.col("w")).alias("bucket")).agg(F.sum(F.when(F.col("w") != "", 1).otherwise(0)).alias("n"), F.sum(F.when(F.col("p") == 0, 1).otherwise(0)).alias("docs")).collect()
    table, prior = np.full((BUCKETS, len(names)), 0.5), np.ones(len(names))
    for r in counts:
        k = names.index(r["domain"])
        table[r["bucket"], k] += r["n"]
        prior[k] += r["docs"]
    return np.log(table / table.sum(0)), np.log(prior / prior.sum())


def posteriors(docs: DataFrame, weights: np.ndarray, prior: np.ndarray, id_col: str, text_col: str, power: float = POWER) -> DataFrame:
    """One row per input row: _id, _h, n_tokens, p_0 ... p_(K-1)."""
    spark, k = docs.sparkSession, len(prior)
    centred = weights - weights.mean(1, keepdims=True)
    model = spark.createDataFrame([(b, *map(float, centred[b])) for b in range(BUCKETS)], "bucket int, " + ", ".join(f"w_{i} double" for i in range(k)))
    rows = docs.select(*row_key(id_col, text_col), _words(F.col(text_col)).alias("ws"))  # keys once a row, not once a word
    words = rows.select("_id", "_h", F.posexplode("ws").alias("p", "w"))
    words = words.select("_id", "_h", "p", (F.col("w") != "").cast("int").alias("one"), _bucket(F.col("w")).alias("bucket")).join(F.broadcast(model), "bucket")
    sums = words.groupBy("_id", "_h").agg(F.sum("one").alias("n"), F.sum((F.col("p") == 0).cast("int")).alias("copies"), *(F.sum(F.col(f"w_{i}") * F.col("one")).alias(f"s_{i}") for i in range(k)))
    each = F.greatest(F.col("n"), F.lit(1))
    scale = F.pow((each / F.col("copies")).cast("double"), F.lit(power)) / each
    sums = sums.select("_id", "_h", "copies", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), *((F.col(f"s_{i}") * scale + F.lit(float(prior[i]))).alias(f"s_{i}") for i in range(k)))
    top = F.greatest(*(F.col(f"s_{i}") for i in range(k))) if k > 1 else F.col("s_0")
    sums = sums.select("_id", "_h", "copies", "n_tokens", *(F.exp(F.col(f"s_{i}") - top).alias(f"e_{i}") for i in range(k)))
    total = sum((F.col(f"e_{i}") for i in range(1, k)), F.col("e_0"))
    return sums.select("_id", "_h", "n_tokens", *((F.col(f"e_{i}") / total).alias(f"p_{i}") for i in range(k)), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def unbounded(pull: np.ndarray) -> Column:
    """1 - posterior . pull."""
    return sum((-F.col(f"p_{i}") * float(x) for i, x in enumerate(pull)), F.lit(1.0))


def rate_of(pull: np.ndarray) -> Column:
    """The projection on rates that are at least `least`."""
    return F.greatest(F.col("least"), unbounded(pull))


def fit_rates(known: DataFrame, targets: list[float], budget: float = 1.0, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """The pull of each domain on the rates, and the shares expected at them, out of n_tokens, p_0 ... and least."""
    k = len(targets)
    n, pairs = F.col("n_tokens").cast("double"), [(i, j) for i in range(k) for j in range(k)]

    def sums(pull: np.ndarray, free) -> tuple[float, np.ndarray, np.ndarray]:
        cells = [F.sum(F.when(free, n * F.col(f"p_{i}") * F.col(f"p_{j}")).otherwise(0.0)).alias(f"g_{i}_{j}") for i, j in pairs]
        got = known.agg(F.sum(n).alias("t"), *(F.sum(n * rate_of(pull) * F.col(f"p_{i}")).alias(f"a_{i}") for i in range(k)), *cells).first()
        total = got["t"] or 0.0
        if not total:
            return 0.0, np.zeros(k), np.zeros((k, k))
        return total, np.array([got[f"a_{i}"] for i in range(k)]) / total, np.array([got[f"g_{i}_{j}"] for i, j in pairs]).reshape(k, k) / total

    pull = np.zeros(k)
    total, have, gram = sums(pull, F.col("least") < 1)
    if not total:
        return pull, have
    want = np.array(targets) / sum(targets) * budget
    miss = have - want
    step, share = np.linalg.solve(gram + ridge * np.eye(k), miss), 1.0
    for _ in range(ROUNDS):
        if np.abs(miss).max() < TOLERANCE:
            return pull, have
        at = pull + share * step
        _, there, free = sums(at, unbounded(at) > F.col("least"))
        left = there - want - ridge * at
        if left @ left < miss @ miss:
            pull, have, miss, share = at, there, left, 1.0
            step = np.linalg.solve(free + ridge * np.eye(k), miss)
        else:
            share /= 2
    size = float(np.abs(miss).max())
    raise ArithmeticError(f"the rates have not converged in {ROUNDS} rounds: a domain's gradient is {size}")


def mix_rates(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
    budget: float = 1.0, keep: str | None = None,
) -> DataFrame:
    """One row per input row: id, n_tokens, posterior (a struct by domain), rate, copies.

    domains has the identifier and a column domain; rows whose domain has no target, or is null, are not
    learnt from, and of a repeated identifier the least domain counts. budget times the input's tokens are
    split by the targets. Documents that are more likely than not of the domain keep have a rate of 1 at least, all
    others of 0. copies is the rate, rounded up or down by a hash of the row so that its expectation
    is the rate. A null or empty text has no tokens, and the prior for a posterior. Rows that repeat an
    identifier and a text get equal results; no rows give no rows."""
    names = list(targets)
    weights, prior = word_weights(docs, domains, names, id_col, text_col)
    known = written(posteriors(docs, weights, prior, id_col, text_col), "posteriors")
    known = known.withColumn("least", F.when(F.col(f"p_{names.index(keep)}") >= 0.5, 1.0).otherwise(0.0) if keep else F.lit(0.0))
    pull, _ = fit_rates(known, list(targets.values()), budget)
    out = known.withColumn("rate", rate_of(pull))
    draw = F.pmod(F.xxhash64("_id", "_h", "copy"), F.lit(1 << 30)) / float(1 << 30)
    posterior = F.struct(*(F.col(f"p_{i}").alias(name) for i, name in enumerate(names)))
    plain = F.when(F.col("_id") != -(2**63), F.col("_id"))
    return out.select(plain.alias("id"), "n_tokens", posterior.alias("posterior"), "rate", F.floor(F.col("rate") + draw).cast("long").alias("copies"), "_id", "_h", "copy")


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else good or poor by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mix_rates(docs, quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "posterior.*", "rate", "copies")
