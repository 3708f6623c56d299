"""Near-duplicate detection by order MinHash, verified by banded alignment.

A document is the sequence of its shingles (five words), each labelled with its occurrence number. Each of
SKETCHES hash functions samples the TAKE shingles of least hash; their sequence in text order is one sketch.
So two documents share a sketch only if the same shingles stand in the same order: the chance follows edit
similarity, not just overlap. Documents that share a sketch are candidates, verified by aligning the plain
shingles (without labels) within a band: with M aligned of n and m, similarity is M / (n + m - M), and 0.8 or more is a link.

No bucket's pairs are all emitted. Copies with equal words are one node. Buckets are sorted by range, so a
large one spans tasks; first a node meets its bucket's first one in a few sketches, which joins a group of any
size with one pair a member. Then, for all sketches, buckets whose nodes are still in different classes link
each node to its neighbour in order of length and to the first one. Last, the nodes of buckets that still hold
several classes are joined exactly, by prefix filtering: with each node's labelled shingles in order from rare to
frequent, two documents of similarity s share one of the first (1 - s) n of the longer and of the first
(1 - 2 s / (1 + s)) n of the shorter, and it is not so late in either that too few shingles are left. A passage
that a family has in common comes last in that order, so strangers in the family don't meet; members of one class
don't either, as for each shingle only what is outside its largest class looks for partners. A class is cut into
blocks of MEMBERS nodes, and it is blocks that meet: a node that is close to a class of thousands is one row a block,
not one a member, and is compared with the block's members in place. So no two similar documents that share a
sketch are left uncompared, unless they are in one class already. Classes are connected components, found by
contracting the links in random order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import join_rows, own_columns, row_key, spans, texts, tidy, written
from ._words import U, Words, buffers, mix, windows

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
TAKE = 4
#: Sketches that the first round of links uses.
FIRST = 4
CHUNK = 2 << 20
#: Shingles that are sampled at once, for bounded memory on long texts.
BLOCK = 1 << 16

#: Matches a shingle of both texts, beyond which they are aligned by rows of bits.
MATCHES = 16
#: Nodes of a class that are one block.
MEMBERS = 64
#: Nodes that meet a block in one cell, about.
GUESTS = 256

LINK = "a long, b long"


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers hashed in, so that none repeats."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    index = np.arange(len(ranked))
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    nth = np.empty(len(ranked), U)
    nth[order] = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(U)
    return mix(shingles + nth * U(0x9FB21C651E98DF25))


def sketches(marks: np.ndarray, count: int = SKETCHES, take: int = TAKE) -> np.ndarray:
    """The order MinHash sketches of one document's labelled shingles (at least one)."""
    seeds = mix(np.arange(1, count + 1, dtype=U) * U(0xA24BAED4963EE407))[:, None]
    best, where = np.zeros((count, 0), U), np.zeros((count, 0), np.int64)
    for a in range(0, len(marks), BLOCK):
        x = (marks[None, a : a + BLOCK] ^ seeds) * U(0x9E3779B97F4A7C15)
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        n = x.shape[1]
        at = np.argpartition(x, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (count, 1))
        best = np.concatenate([best, np.take_along_axis(x, at, 1)], axis=1)
        where = np.concatenate([where, at + a], axis=1)
        if best.shape[1] > take:
            at = np.argpartition(best, take - 1, axis=1)[:, :take]
            best, where = np.take_along_axis(best, at, 1), np.take_along_axis(where, at, 1)
    where = np.sort(where, axis=1)
    out = np.arange(count, dtype=U) * U(0xD1342543DE82EF95)
    for j in range(where.shape[1]):
        out = mix(out ^ marks[where[:, j]])
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences, which may repeat shingles: the longest common subsequence in the band.

    More than (1 - similarity) / (1 + similarity) of all shingles cannot be off the diagonal at the wanted
    similarity, so matches outside that band don't count. The subsequence is the longest increasing chain of
    matches, a shingle's positions in falling order; where matches are very many, it is counted by rows of bits.
    Below the wanted similarity the result may be an upper bound that is also below."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    least = similarity * (n + m) / (1 + similarity)
    if min(n, m) < least - 1e-9:
        return 0.0
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    count = high - low
    whole = int(np.count_nonzero(count))
    if whole < least - 1e-9:
        return whole / (n + m - whole)
    if int(count.sum()) > MATCHES * (n + m):
        best = common_by_bits(a.tolist(), b.tolist())
        return best / (n + m - best)
    row = np.repeat(np.arange(n), count)
    to = order[high[row] - 1 - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))]
    chain = to[np.abs(to - row) <= n + m - 2 * least + 1]
    if len(chain) < least - 1e-9:
        return len(chain) / (n + m - len(chain))
    best = len(chain)
    if (chain[1:] <= chain[:-1]).any():
        tails: list[int] = []
        for x in chain.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        best = len(tails)
    return best / (n + m - best)


def common_by_bits(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, with a bit for each of b."""
    at: dict[int, list[int]] = {}
    for i, y in enumerate(b):
        at.setdefault(y, []).append(i)
    places, full = {}, (1 << len(b)) - 1
    for x in set(a) & at.keys():
        raw = bytearray(len(b) // 8 + 1)
        for i in at[x]:
            raw[i >> 3] |= 1 << (i & 7)
        places[x] = int.from_bytes(raw, "little")
    free = full
    for x in a:
        hit = free & places.get(x, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return len(b) - free.bit_count()


def _sketch(batches):
    for batch in batches:
        col = texts(batch.column(2))
        for a, b in spans(np.diff(buffers(col)[1]), CHUNK):
            w = Words(*buffers(col.slice(a, b - a)))
            data, at = w.joined()
            raw, grams = data.tobytes(), windows(w.hashes(), SHINGLE)
            high, low, count, found = [], [], [], []
            for i in range(b - a):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                digest = hashlib.blake2b(raw[at[lo] : at[hi]], digest_size=16).digest()
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                n = max(0, hi - lo - SHINGLE + 1)
                count.append(n)
                found.append(sketches(labelled(grams[lo : lo + n])).astype(np.int64).tolist() if n else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(count, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["_id", "_h", "high", "low", "n", "sketches"])


def _star(batches):
    """(a, b): the first node of a key's run in this task, and each other one; a = b marks the first."""
    last, head = None, None
    for batch in batches:
        pairs = []
        for key, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                last, head = key, node
                pairs.append((node, node, key))
            elif node != head:
                pairs.append((head, node, key))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(3)], ["a", "b", "key"])


def _star_and_chain(batches):
    """As _star, with each node's neighbour before it too; nodes of one class are not paired."""
    last, head, before = None, None, None
    for batch in batches:
        pairs = []
        for key, node, kin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if key != last:
                last, head = key, (node, kin)
                pairs.append((node, node, key))
            else:
                for other, their in {head, before}:
                    if their != kin:
                        pairs.append((other, node, key))
            before = (node, kin)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(3)], ["a", "b", "key"])


def _pairs(buckets: DataFrame, link) -> DataFrame:
    """Distinct candidate pairs of (key, node, n, ...): runs of a key that spans tasks meet by their first nodes."""
    found = written(buckets.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node").mapInArrow(link, LINK + ", key long"), "pairs")
    heads = found.filter("a = b").select("key", "a")
    first = heads.groupBy("key").agg(F.min("a").alias("head"), F.max("a").alias("most")).filter("head < most")
    across = heads.join(first, "key").filter("a > head").select(F.col("head").alias("a"), F.col("a").alias("b"))
    both = found.filter("a <> b").select("a", "b").unionByName(across)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(similarity: float):
    def verify(batches):
        for batch in batches:
            left, right = texts(batch.column(2)), texts(batch.column(3))
            sizes = np.diff(buffers(left)[1]) + np.diff(buffers(right)[1])
            for a, b in spans(sizes, CHUNK):
                sides = []
                for col in (left, right):
                    w = Words(*buffers(col.slice(a, b - a)))
                    sides.append((w, windows(w.hashes(), SHINGLE)))
                good = []
                for i in range(b - a):
                    x, y = (grams[w.first[i] : max(w.first[i], w.first[i + 1] - SHINGLE + 1)] for w, grams in sides)
                    good.append(aligned(x, y, similarity) >= similarity - 1e-12)
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(mask), batch.column(1).slice(a, b - a).filter(mask)], ["a", "b"])

    return verify


def _tokens(batches):
    """(node, n, token) for each labelled shingle of (node, text)."""
    for batch in batches:
        col = texts(batch.column(1))
        for a, b in spans(np.diff(buffers(col)[1]), CHUNK):
            w = Words(*buffers(col.slice(a, b - a)))
            grams = windows(w.hashes(), SHINGLE)
            nodes = batch.column(0).slice(a, b - a).to_numpy()
            marks = [labelled(grams[w.first[i] : max(w.first[i], w.first[i + 1] - SHINGLE + 1)]) for i in range(b - a)]
            sizes = np.array([len(m) for m in marks])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(marks).astype(np.int64))], ["node", "n", "token"])


def _blocks(kin: DataFrame) -> DataFrame:
    """(node, kin, block, total) of (node, kin); total is the size of the class."""
    sizes = kin.groupBy("kin").agg(F.count("*").alias("total"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / MEMBERS))
    return kin.join(sizes.hint("merge"), "kin").select("node", "kin", F.xxhash64("kin", part).alias("block"), "total")


def _meetings(words: DataFrame, blocks: DataFrame, similarity: float) -> DataFrame:
    """Distinct (guest, host): blocks of different classes with a pair of nodes that can be similar.

    place is a token's place in its node's order from rare to frequent; tokens of one node only come first, and
    are not listed. Of two blocks that of the larger class is the host."""
    s, slack = similarity, 1e-9
    tokens = written(words.mapInArrow(_tokens, "node long, n int, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    from_end = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), F.desc("token")))
    placed = tokens.join(often.hint("merge"), "token").withColumn("place", F.col("n") - from_end)
    placed = placed.filter(F.col("place") <= F.col("n") * (1 - s) + slack).drop("df").join(blocks.hint("merge"), "node")
    n, place, share = F.col("n"), F.col("place"), s / (1 + s)
    groups = placed.groupBy("token", "kin", "block", "total").agg(
        F.min("n").alias("low"), F.max("n").alias("high"),
        F.min(place - n * (1 - 2 * share)).alias("early"),  # at most 0: a node can meet longer ones by this token
        F.max(n - place - n * share).alias("room"), F.count("*").alias("members"),
    )
    groups = written(groups, "prefixes")
    classes = groups.groupBy("token", "kin").agg(F.sum("members").alias("members"))
    largest = classes.groupBy("token").agg(F.max(F.struct("members", "kin"))["kin"].alias("most"), F.count("*").alias("classes")).filter("classes > 1")
    groups = written(groups.join(largest.select("token", "most").hint("merge"), "token"), "mixed-prefixes")
    side = lambda of: [F.col(c).alias(f"{c}_{of}") for c in ("block", "kin", "total", "low", "high", "early", "room")]
    x, y = groups.filter("kin <> most").select("token", "most", *side("x")), groups.select("token", *side("y"))
    both = x.join(y.hint("merge"), "token").filter("kin_x <> kin_y and (kin_y = most or block_x < block_y)")
    both = both.filter((F.col("high_x") >= s * F.col("low_y") - slack) & (F.col("high_y") >= s * F.col("low_x") - slack))
    both = both.filter(((F.col("early_x") <= slack) & F.expr("low_x <= high_y")) | ((F.col("early_y") <= slack) & F.expr("low_y <= high_x")))
    both = both.filter((F.col("room_x") >= share * F.col("low_y") - slack) & (F.col("room_y") >= share * F.col("low_x") - slack))
    x_hosts = F.expr("total_x > total_y or (total_x = total_y and block_x > block_y)")
    return both.select(F.when(x_hosts, F.col("block_y")).otherwise(F.col("block_x")).alias("guest"), F.when(x_hosts, F.col("block_x")).otherwise(F.col("block_y")).alias("host")).distinct()


def _cells(meetings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(cell, node, kin, side): a host block's nodes on side 0, about GUESTS nodes that it meets on side 1."""
    meetings = written(meetings, "meetings")
    sizes = blocks.groupBy(F.col("block").alias("guest")).agg(F.count("*").alias("size"))
    parts = meetings.join(sizes.hint("merge"), "guest").groupBy("host").agg(F.ceil(F.sum("size") / GUESTS).alias("parts"))
    cells = meetings.join(parts.hint("merge"), "host").withColumn("cell", F.xxhash64("host", F.pmod(F.xxhash64("guest"), F.col("parts"))))
    hosts = cells.select("cell", F.col("host").alias("block"), F.lit(0).alias("side")).distinct()
    guests = cells.select("cell", F.col("guest").alias("block"), F.lit(1).alias("side"))
    return hosts.unionByName(guests).join(blocks.select("block", "node", "kin").hint("merge"), "block").select("cell", "node", "kin", "side")


def _compare(similarity: float):
    """Links between the hosts' and the guests' classes of (cell, node, kin, side, text), which come cell by cell."""

    def shingles(text: str) -> np.ndarray:
        return windows(Words(*buffers(pa.array([text or ""], pa.large_string()))).hashes(), SHINGLE)

    def links(rows: list[tuple]) -> list[tuple]:
        hosts, guests = ([r for r in rows if r[3] == side] for side in (0, 1))
        if not hosts or not guests:
            return []
        plain = [shingles(r[4]) for r in hosts]
        size, kin = np.array([len(x) for x in plain]), np.array([r[2] for r in hosts])
        marks, owner = np.concatenate([labelled(x) for x in plain]), np.repeat(np.arange(len(hosts)), size)
        order = np.argsort(marks, kind="stable")
        marks, owner = marks[order], owner[order]
        out, met = [], set()
        for _, node, own, _, text in guests:
            x = shingles(text)
            own_marks = labelled(x)
            low, high = np.searchsorted(marks, own_marks, "left"), np.searchsorted(marks, own_marks, "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            overlap = np.bincount(owner[at], minlength=len(hosts))
            for j in np.flatnonzero((overlap >= similarity / (1 + similarity) * (len(x) + size) - 1e-9) & (kin != own)).tolist():
                if (own, kin[j]) not in met and aligned(x, plain[j], similarity) >= similarity - 1e-12:
                    out.append((int(hosts[j][1]), int(node)))
                    met.add((own, kin[j]))
        return out

    def batch_of(made):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.int64()) for i in range(2)], ["a", "b"])

    def compare(batches):
        last, rows, made = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    made += links(rows)
                    last, rows = row[0], []
                rows.append(row)
            yield batch_of(made)
            made = []
        yield batch_of(links(rows))

    return compare


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after links between nodes, which join their classes."""
    for side in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(side), F.col("root").alias("top")), side, "left").withColumn(side, F.coalesce("top", side)).drop("top")
    more = components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    risen = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(risen.unionByName(more.join(roots.select("node"), "node", "left_anti")), "roots")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links; root is one node of its component.

    Each round every node hooks on to its least neighbour (or itself), two hooks up at once, and the classes
    become the nodes. Nodes are numbered in order of a digest, so the order is random: a star is one class
    after two rounds, and a chain shrinks by a constant factor a round."""
    edges = written(links.filter("a <> b").distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).withColumn("up", F.least("node", "up")), "hooks")
        jump = written(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), "jumps")
        roots = jump.withColumnRenamed("top", "root") if roots is None else roots.join(jump.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        up = lambda c: jump.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top"))  # noqa: B023, E731
        edges = edges.join(up("a"), "a").join(up("b"), "b").select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).filter("a <> b").distinct()
        edges = written(edges, "links")
    return written(roots, "roots") if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, class_id, n_shingles, kept (and the row key).

    class_id is the least identifier of the row's class: texts with equal words, and those linked to them
    directly or through others. Texts of fewer than five words are only linked to equal ones; null and empty
    texts are equal. Rows that repeat an identifier are judged one by one; null identifiers count as the
    least, so a class with one has a null class_id. kept is true for one
    row a class, the least by identifier and text hash, and of equal rows any one. No rows give no rows."""
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("_t"))
    made = written(rows.mapInArrow(tidy(_sketch), "_id long, _h long, high long, low long, n int, sketches array<long>"), "sketches")
    nodes = made.groupBy("high", "low").agg(F.min("_id").alias("rep"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = written(made.join(nodes.hint("merge"), ["high", "low"]).select("_id", "_h", "node", "rep", "n", F.when(F.col("_id") == F.col("rep"), F.col("sketches")).alias("sketches")), "members")
    own = member.filter("sketches is not null and n > 0").select("node", "_id", "_h", "n", "sketches").dropDuplicates(["node"])
    own = written(own, "own")
    keys = own.select("node", "n", F.posexplode("sketches").alias("f", "s")).withColumn("key", F.xxhash64("f", "s"))

    # a node that is alone in all its buckets has no partner; what follows reads the others' sketches and texts only
    shared = keys.groupBy("key").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("key")
    keys = written(keys.join(shared.hint("merge"), "key"), "keys")
    where = own.join(keys.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "_id", "_h")
    found = written(rows.join(where, ["_id", "_h"]).dropDuplicates(["node"]).select("node", "_t"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        full = pairs.join(found.select(F.col("node").alias("a"), F.col("_t").alias("x")).hint("merge"), "a")
        full = full.join(found.select(F.col("node").alias("b"), F.col("_t").alias("y")).hint("merge"), "b")
        return full.select("a", "b", "x", "y").mapInArrow(_verify(similarity), LINK)

    def mixed(roots: DataFrame) -> DataFrame:
        """The members of buckets that hold several classes."""
        kin = written(keys.join(roots, "node", "left").select("key", "node", "n", "f", F.coalesce("root", "node").alias("kin")), "kin")
        several = written(kin.groupBy("key").agg(F.min("kin").alias("low"), F.max("kin").alias("high")).filter("low < high").select("key"), "mixed")
        return kin.join(several.hint("merge"), "key")

    roots = components(verified(written(_pairs(keys.filter(f"f < {FIRST}").select("key", "node", "n"), _star), "pairs")))
    roots = _joined(roots, verified(written(_pairs(mixed(roots).select("key", "node", "n", "kin"), _star_and_chain), "pairs")))
    rest = written(_blocks(written(mixed(roots).select("node", "kin").distinct(), "rest")), "blocks")
    cells = written(_cells(_meetings(found.join(rest.select("node").hint("merge"), "node", "left_semi"), rest, similarity), rest), "cells")
    placed = cells.join(found.hint("merge"), "node").select("cell", "node", "kin", "side", "_t")
    roots = _joined(roots, written(placed.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_compare(similarity), LINK), "links"))
    known = member.join(roots, "node", "left").select("_id", "_h", "n", F.coalesce("root", "node").alias("root")).withColumn("at", F.monotonically_increasing_id())
    known = written(known, "known")
    least = known.groupBy("root").agg(F.min(F.struct("_id", "_h", "at")).alias("first")).select("root", F.col("first._id").alias("class_id"), F.col("first.at").alias("first"))
    out = known.join(written(least, "classes").hint("merge"), "root")
    plain = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return out.select(plain("_id").alias("id"), plain("class_id").alias("class_id"), F.col("n").cast("long").alias("n_shingles"), F.expr("at = first").alias("kept"), "_id", "_h")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: the least by identifier and text hash, and of equal rows any one."""
    found = written(near_classes(docs, id_col, text_col, similarity).select("_id", "_h", "kept"), "kept")
    gone = found.filter("not kept").select("_id", "_h").distinct()
    twice = found.filter("kept").select("_id", "_h").join(gone, ["_id", "_h"], "left_semi")  # kept once of equal rows
    some = join_rows(docs, twice, "left_semi", id_col, text_col).dropDuplicates(["_pf_join_id", "_pf_join_h"])
    return own_columns(join_rows(docs, gone, "left_anti", id_col, text_col), docs).unionByName(own_columns(some, docs))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_shingles", "kept")
