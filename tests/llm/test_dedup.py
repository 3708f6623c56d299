import collections
import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa

from planeflow.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from planeflow.llm._words import Words, buffers, long_windows, mix, slide_min, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def test_words_equal_the_pattern(corpus):
    column = pa.array([t or "" for _, t in corpus])
    w = Words(*buffers(column))
    raw = w.data.tobytes()
    for i, (_, t) in enumerate(corpus):
        got = [raw[a:b].decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == split(t)
    data, at = w.joined()
    assert data.tobytes().decode().split(" ")[:-1] == [x for _, t in corpus for x in split(t)]
    h = w.hashes()
    by = {}
    for word, code in zip((x for _, t in corpus for x in split(t)), h.tolist(), strict=True):
        assert by.setdefault(word, code) == code
    assert len(set(by.values())) == len(by)


def test_window_hashes_and_minima():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, 200).astype(np.uint64)
    for f in (windows, long_windows):
        got = f(h, 5)
        for i in range(0, 190):
            for j in range(i, 190):
                assert (got[i] == got[j]) == (h[i : i + 5].tolist() == h[j : j + 5].tolist())
    x = rng.integers(0, 1000, 300).astype(np.uint64)
    for k in (1, 2, 3, 7, 32):
        assert slide_min(x, k).tolist() == [int(x[i : i + k].min()) for i in range(len(x) - k + 1)]


def brute_substrings(rows, window):
    seen = collections.Counter(tuple(w[i : i + window]) for w in map(split, rows) for i in range(len(w) - window + 1))
    out = []
    for text in rows:
        w = split(text)
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    for window in (35, 8):
        got = substring_dedup.substring_dedup(docs, window=window).collect()
        want = sorted(zip([r[0] for r in rows], brute_substrings([r[1] for r in rows], window), strict=True), key=repr)
        assert sorted(((r["id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got), key=repr) == want
        assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_frequent_seeds_only_move_work(docs, monkeypatch):
    want = sorted(map(repr, substring_dedup.substring_dedup(docs).collect()))
    monkeypatch.setattr(substring_dedup, "frequent_seeds", lambda d: ([], 10**5))
    monkeypatch.setattr(substring_dedup, "FLUSH", 1)
    assert sorted(map(repr, substring_dedup.substring_dedup(docs).collect())) == want
    monkeypatch.setattr(substring_dedup, "SPLIT_WORDS", 0)  # every bucket is over-full
    assert sorted(map(repr, substring_dedup.substring_dedup(docs).collect())) == want


def test_substrings_split_over_full_buckets(spark, monkeypatch):
    """A seed that many different windows hold: its bucket is found, split, and the rest stays where it is."""
    rng = random.Random(11)

    def order(seed):
        data = " ".join(seed).encode()
        return int(mix(windows(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes(), 4))[0])

    seed = min(([f"s{rng.randrange(10**6)}" for _ in range(4)] for _ in range(4000)), key=order)  # a minimiser nearly always
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(31)] + seed + [f"w{rng.randrange(10**6)}" for _ in range(31)]) for _ in range(400)]
    texts += texts[:20]
    data = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(t) for t in data])
    words = substring_dedup.Words(np.frombuffer(b"".join(data), np.uint8), at)
    monkeypatch.setattr(substring_dedup, "SPLIT_WORDS", 1500)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    full = substring_dedup.full_buckets(df.select("text"), [], len(words), 35, 512)

    def sizes(full):
        m = substring_dedup._Minimisers([], full, 35, 512)
        _, _, n, key = m.runs(words)
        return np.bincount(m.bucket(key), n + 34, 512)

    before, after = sizes([]), sizes(full)
    assert full == np.flatnonzero(before > 1500).tolist() and len(full) >= 1
    assert after.max() < before.max() / 2
    got = {r.id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {i: 66 if i < 20 or i >= 400 else 0 for i in range(420)}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    for keep, best in (("largest", max), ("smallest", min)):
        groups = collections.defaultdict(list)
        for r in rows:
            groups[lower(r["text"])].append(r["doc_id"])
        want = []
        for r in rows:
            own = groups[lower(r["text"])]
            known = [i for i in own if i is not None]
            top = best(known) if known else None
            want.append((r["doc_id"], top, len(own), r["doc_id"] == top, hashlib.sha256(lower(r["text"]).encode()).hexdigest()))
        got = exact_dedup.exact_groups(docs, keep=keep).collect()
        assert sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in got), key=repr) == sorted(want, key=repr)


def test_exact_runs_merge_in_rounds(docs):
    whole = exact_dedup.exact_groups(docs.coalesce(1)).collect()
    spread = exact_dedup.exact_groups(docs.repartition(23)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, spread))


def test_exact_dedup_keeps_one_of_each(docs):
    out = exact_dedup.exact_dedup(docs)
    texts = [lower(r["text"]) for r in out.collect()]
    assert out.columns == docs.columns
    assert len(texts) == len(set(texts)) == len({lower(r["text"]) for r in docs.collect()})


def marks(text):
    w, seen, out = split(text), collections.Counter(), []
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def ordered_similarity(a, b):
    at, tails = {z: k for k, z in enumerate(b)}, []
    for z in a:
        if z in at:
            k = bisect_left(tails, at[z])
            tails[k : k + 1] = [at[z]]
    return len(tails) / (len(a) + len(b) - len(tails)) if a and b else 0.0


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    m = [marks(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if split(rows[i][1]) == split(rows[j][1]) or ordered_similarity(m[i], m[j]) >= 0.8:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        k = -(2**63) if key is None else key
        least[find(i)] = min(least.get(find(i), k), k)
    return [(key, None if least[find(i)] == -(2**63) else least[find(i)]) for i, (key, _) in enumerate(rows)]


def test_near_classes_equal_brute_force(docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_classes(docs).collect()
    assert sorted(((r["id"], r["class_id"]) for r in got), key=repr) == sorted(brute_classes(rows), key=repr)


def test_near_group_of_many_is_one_class(spark):
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(200):
        w = list(base)
        w[5 + i % 100] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"o{i}_{j}" for j in range(60)] + base[:40])) for i in range(100)]  # a passage in common
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["class_id"] for r in got if r["id"] < 1000} == {0}
    assert all(r["class_id"] == r["id"] for r in got if r["id"] >= 1000)
    assert near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 101


def test_near_pairs_in_a_family_of_strangers(spark):
    """500 words, 435 of them in common: strangers are below 0.8 but share sketches; each pair has 25 more in common."""
    base = [f"v{i}" for i in range(435)]
    rows = []
    for i in range(200):
        pair = [f"p{i // 2}_{j}" for j in range(25)]
        rows.append((i, " ".join(base + pair + [f"o{i}_{j}" for j in range(40)])))
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert ordered_similarity(marks(rows[0][1]), marks(rows[1][1])) > 0.8 > ordered_similarity(marks(rows[0][1]), marks(rows[2][1]))
    assert {r["id"]: r["class_id"] for r in found} == {i: i // 2 * 2 for i in range(200)}


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.permutation(60).astype(np.uint64)
        b = np.delete(a, rng.integers(0, 60, 4))
        b[3], b[9] = b[9], b[3]
        assert abs(near_dedup.aligned(a, b) - ordered_similarity(a.tolist(), b.tolist())) < 1e-12


def test_near_copies_that_share_an_identifier_leave_one(spark):
    base = [f"v{i}" for i in range(120)]
    texts = [" ".join(base[:50] + [f"own{i % 5}"] + base[50:]) for i in range(8)]
    rows = [(None, t) for t in texts] + [(7, t.replace("v", "u")) for t in texts] + [(9, "u0 alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"] for r in near_dedup.near_dedup(docs).collect()), key=repr) == [7, 9, None]
    assert near_dedup.near_classes(docs).filter("kept").count() == 3


def common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(best[j] + 1 if x == y else max(best[j + 1], new[j]))
        best = new
    return best[-1]


def test_alignment_of_repeated_shingles(monkeypatch):
    p, q, r = ([f"{name}{i}" for i in range(n)] for name, n in (("p", 50), ("q", 50), ("r", 350)))
    rows = pa.record_batch({"a": [1], "b": [2], "x": [" ".join(p + q + p + r)], "y": [" ".join(q + p + r)]})
    assert [b.num_rows for b in near_dedup._verify(0.8)(iter([rows]))] == [1]
    rng = np.random.default_rng(7)
    pairs = []
    for size in (2, 5, 40):
        for _ in range(30):
            a = rng.integers(0, size, 90).astype(np.uint64)
            b = np.insert(np.delete(a, rng.integers(0, 90, 6)), rng.integers(0, 80, 4), rng.integers(0, size, 4).astype(np.uint64))
            pairs.append((a, b))
    for limit in (10**6, 0):
        monkeypatch.setattr(near_dedup, "MATCHES", limit)
        for a, b in pairs:
            m = common(a.tolist(), b.tolist())
            want, got = m / (len(a) + len(b) - m), near_dedup.aligned(a, b)
            assert abs(got - want) < 1e-12 if want >= 0.8 else got < 0.8


def test_sketches_do_not_depend_on_blocks(monkeypatch):
    x = near_dedup.labelled(np.random.default_rng(3).integers(0, 500, 3000).astype(np.uint64))
    assert len(set(x.tolist())) == len(x)
    want = near_dedup.sketches(x).tolist()
    monkeypatch.setattr(near_dedup, "BLOCK", 97)
    assert near_dedup.sketches(x).tolist() == want


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    names = rng.permutation(4000)
    edges = [(names[i], names[i + 1]) for i in range(300)] + [(names[500], names[600 + i]) for i in range(300)] + [(names[1000], names[1000])]
    got = near_dedup.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()
    by = {r["node"]: r["root"] for r in got}
    assert len({by[n] for n in names[:301].tolist()}) == 1 and len({by[n] for n in [names[500], *names[600:900]]}) == 1
    assert len(set(by.values())) == 2 and len(by) == len(got) == 602


def brute_lines(rows, least, min_words=None):
    """{(id, text): (kept text, longest power of two of lines that stood before)}."""
    rows = sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0]))
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t in rows]
    seen, before, gone, longest = set(), set(), [set() for _ in rows], [0] * len(rows)
    for k, own in enumerate(lines):
        for i in range(len(own)):
            for n in {least, 1} if min_words else {least}:
                g = tuple(own[i : i + n])
                if len(g) < n or n < least and len(split(g[0])) < min_words:
                    continue
                if g in seen:
                    gone[k] |= set(range(i, i + n))
                seen.add(g)
            for n in (2**e for e in range(7)):
                g = tuple(own[i : i + n])
                if len(g) == n and (n >= least or n == 1 and min_words and len(split(g[0])) >= min_words):
                    if g in before:
                        longest[k] = max(longest[k], n)
                    before.add(g)
    return {(key, t): ("\n".join(x for j, x in enumerate(own) if j not in bad), n) for (key, t), own, bad, n in zip(rows, lines, gone, longest, strict=True)}


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "\n".join(f"line {x}" if x % 2 else f"a line of many words that is long enough alone {x}" for x in rng.integers(0, 30, 40))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n \n"), (43, "a\na\na\na\na"), (70, None), (50, "a\na\nb\n\nline 3\n"), (-5, "a\na\nq"), (60, rows[3][1]), (61, rows[3][1] + "\nend"), (62, "new\n" + rows[3][1][:200])]
    for least, words in ((2, None), (2, 10), (1, None), (4, 10)):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = brute_lines(rows, least, words)
        got = {(r["id"], r["text"], r["longest_run"]) for r in line_dedup.line_dedup(frame, min_lines=least, min_words=words).collect()}
        assert got == {(key, text, n) for (key, _), (text, n) in want.items()}


def test_lines_of_rows_that_share_an_identifier(spark):
    for keys in ((None, None, None), (7, 7, 7), (None, None, 2**62)):
        rows = [(keys[0], "h1\nh2\nx"), (keys[1], "h1\nh2\ny"), (keys[2], "q\nh1\nh2")]
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(r["n_deleted"] for r in got) == [0, 2, 2]


def test_a_long_run_is_revealed(spark):
    own = [f"x{i}" for i in range(100)]
    frame = spark.createDataFrame([(1, "\n".join(own)), (2, "\n".join(["new", *own[10:90]]))], "doc_id long, text string")
    got = {r["id"]: r for r in line_dedup.line_dedup(frame).collect()}
    assert (got[2]["text"], got[2]["n_deleted"], got[2]["longest_run"]) == ("new", 80, 64)
    assert (got[1]["n_deleted"], got[1]["longest_run"]) == (0, 0)


def test_empty_tables_and_odd_columns(empty, clashing):
    for f in (substring_dedup.substring_dedup, exact_dedup.exact_groups, exact_dedup.exact_dedup, near_dedup.near_classes, near_dedup.near_dedup, line_dedup.line_dedup):
        assert f(empty).count() == 0
        assert f(clashing).count() == 1


def test_near_recall_against_brute_force(spark):
    """Every document at scale 0.01 as a query against all others; measured recall: 1.0 of its links."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    m = {i: marks(t) for i, t in rows}
    own = {i: set(x) for i, x in m.items()}
    close = [(i, j) for i in m for j in m if i < j and m[i] and min(len(m[i]), len(m[j])) >= 0.8 * max(len(m[i]), len(m[j])) and len(own[i] & own[j]) >= 0.8 * max(len(m[i]), len(m[j]))]
    links = [(i, j) for i, j in close if ordered_similarity(m[i], m[j]) >= 0.8]
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) >= 50 and found == len(links), (found, len(links))


def test_prefixes_lose_no_pair(spark, monkeypatch):
    """All pairs of a family of random overlap, each document a class of its own or two classes of many."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(80):
        own = list(base[: 100 - int(rng.integers(0, 12))])
        for at in rng.integers(0, len(own), int(rng.integers(0, 4))):
            own[at] = f"o{i}_{at}"
        rows.append((i, " ".join([*own, *(f"t{i}_{j}" for j in range(int(rng.integers(0, 10))))])))
    m = [marks(t) for _, t in rows]
    words = spark.createDataFrame(rows, "node long, _t string")
    for classes, members in ((80, 64), (2, 64), (3, 7)):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        monkeypatch.setattr(near_dedup, "GUESTS", 10)
        blocks = near_dedup._blocks(spark.createDataFrame([(i, i % classes) for i, _ in rows], "node long, kin long"))
        cells = collections.defaultdict(lambda: (set(), set()))
        found = near_dedup._cells(near_dedup._meetings(words, blocks, 0.8), blocks)
        for r in found.collect():
            cells[r["cell"]][r["side"]].add(r["node"])
        got = {(min(a, b), max(a, b)) for hosts, guests in cells.values() for a in hosts for b in guests}
        want = {(i, j) for i in range(80) for j in range(i + 1, 80) if i % classes != j % classes and ordered_similarity(m[i], m[j]) >= 0.8}
        assert want <= got and len(want) > 100 and all(len(hosts) <= members * 2 for hosts, _ in cells.values())
        made = found.join(words, "node").select("cell", "node", "kin", "side", "_t").repartition("cell").sortWithinPartitions("cell", "side")
        linked = {tuple(sorted((a % classes, b % classes))) for a, b in made.mapInArrow(near_dedup._compare(0.8), near_dedup.LINK).collect()}
        assert linked == {tuple(sorted((a % classes, b % classes))) for a, b in want}
