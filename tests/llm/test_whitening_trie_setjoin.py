"""Whitening, the prefix trie and the set join against plain versions, and on odd input."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import prefixtrie, setjoin, whitening

VECTORS = "vec_id long, embedding array<float>, n long, dims string, whitened int"


def plain_whitening(x: np.ndarray):
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    return e[::-1], c @ u[:, ::-1] / np.sqrt(e[::-1])


def test_whitening_query(spark, sf_dir):
    got = whitening.op11_whitening(spark, sf_dir).toPandas()
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in row] for row in v["embedding"]]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert len(got) == 8 * n and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 9))
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in zip(v["vec_id"], x, strict=True)}
    assert all(exact[i] == d for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    e, w = plain_whitening(np.array(x, float))
    for k in range(8):
        own = got[got["component"] == k + 1].sort_values("vec_id")
        assert min(np.abs(own["whitened"] - w[:, k]).max(), np.abs(own["whitened"] + w[:, k]).max()) < 1e-9
        assert np.allclose(own["explained"], e[k] / e.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_polarisation_is_exact():
    """Sums of squares of any size, against sums of products of Python's integers."""
    rng = np.random.default_rng(1)
    for scale in (10, 1 << 20, 1 << 40):
        y = rng.integers(-scale, scale, (50, 4))
        got = whitening.squares(y)
        rows = y.tolist()
        pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
        assert got.tolist() == [sum(r[i] ** 2 for r in rows) for i in range(4)] + [sum((r[i] + r[j]) ** 2 for r in rows) for i, j in pairs]
        sums = [sum(r[i] for r in rows) for i in range(4)]
        both = [[(50 * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j]) / 2500 for j in range(4)] for i in range(4)]
        assert np.array_equal(whitening.covariance(50, np.array(sums, object), got), both)


def test_whitening_odd_rows(spark):
    """Bad vectors go; lengths are apart; constant dimensions and repeated rows; far values; ids may be null."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 5.0]), (6, [1.0, 5.0]), (None, [3.0, 5.0]), (7, [-2.0, 5.0]), (8, [1.0, 2.0, 3.0]), (9, [1e12, 0.5]), (9, [-1e12, 0.25])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "x", 2) for r in rows[:10]], VECTORS)).collect()
    by = {(r.vec_id, r.dims): r for r in got}
    assert sorted((r.vec_id or 0, r.dims, r.n) for r in got) == [(0, 2, 4), (6, 2, 4), (6, 2, 4), (7, 2, 4), (8, 3, 1)]
    x = np.array([1, 1, 3, -2]) * 1024.0
    w = (x - x.mean()) / x.std()
    assert abs(abs(by[7, 2].whitened[0]) - abs(w[3])) < 1e-12 and by[7, 2].whitened[1] is None
    assert by[7, 2].explained == [1.0, 0.0] and by[7, 2].identity_error < 1e-12 and by[7, 2].deviation == int((4 * x - x.sum())[3] ** 2)
    assert by[8, 3].whitened == [None] * 3 and by[8, 3].identity_error is None and by[8, 3].deviation == 0
    far = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(*r, 1, "x", 2) for r in rows[9:]], VECTORS)).collect()}
    big = [[int(np.floor(np.float64(np.float32(c)) * 1024)) for c in r[1]] for r in rows[10:]]
    assert int(far[9].deviation) == sum((2 * a - a - b) ** 2 for a, b in zip(*big, strict=True))
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="can be whitened"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 1, "x", 2)], VECTORS)).count()


def plain_trie(sequences: dict[int, list[tuple]]):
    """Nodes of sequences of (turn, words)."""
    members, below = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    kids = {k: sum(len(o) == len(k) + 1 for o in below[k]) for k in members}
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k))))
        saved = sum((len(members[o]) - 1) * (o[-1][1] if o else 0) for o in below[k])
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[o] for o in below[k]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_over_many_shards(spark, seed, monkeypatch):
    """A hot sequence over many shards, sequences within others, and some of many turns."""
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", 60)
    rng = random.Random(seed)
    hot = [(1, 2), (0, 3), (1, 2)]
    sequences: dict[int, list] = {}
    for c in range(-5, 195):
        s = [(rng.randrange(3), 0) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))]
        sequences[c] = hot[: rng.randrange(4)] if rng.random() < 0.4 else [(t, t + 1) for t, _ in s]
    rows = [(c, [bytearray(hashlib.md5(repr(t).encode()).digest()) for t in s], [t[1] for t in s]) for c, s in sequences.items()]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, "conv_id long, ids array<binary>, words array<long>"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(sequences)


def test_trie_odd_rows(spark):
    """Null turns first, null roles and texts as empty, repeated rows as turns, no id as no conversation."""
    schema = "conv_id long, turn long, role string, text string, depth int, ids string"
    rows = [(1, 2, "a", "x y"), (1, None, "u", "q"), (2, 1, "u", "q"), (2, 5, "a", "x y"), (3, 0, None, None), (3, 0, None, None), (4, 0, "", ""), (None, 0, "u", "q"), (5, 0, "", " "), (6, 0, "au", "q"), (7, 0, "a", "uq")]
    long = " ".join(["w"] * 50_000)
    rows += [(8, 0, "u", long), (9, 0, "u", long)]
    got = prefixtrie.conversation_trie(spark.createDataFrame([(*r, 1, "z") for r in rows], schema)).collect()
    q, x = (("u", "q"), 1), (("a", "x y"), 2)
    nothing = (("", ""), 0)
    plain = {1: [q, x], 2: [q, x], 3: [nothing, nothing], 4: [nothing], 5: [(("", " "), 0)], 6: [(("au", "q"), 1)], 7: [(("a", "uq"), 1)], 8: [(("u", long), 50_000)], 9: [(("u", long), 50_000)]}
    assert sorted(map(tuple, got), key=repr) == plain_trie(plain)
    assert prefixtrie.conversation_trie(spark.createDataFrame([], schema)).count() == 0


def test_trie_rebuilds(spark):
    """A base that is absent, shorter than what is taken, or the conversation itself; more taken than there is."""
    word = lambda c, k: (k, bytearray(bytes([c, k]) + bytes(14)), 1)
    rows = [(20, [word(20, 0)]), (21, [word(21, k) for k in range(4)]), (41, [word(41, k) for k in range(2)]), (22, [word(22, 0)])]
    turns = spark.createDataFrame(rows, "conv_id long, turns array<struct<turn:long, id:binary, words:long>>")
    got = prefixtrie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 20, F.lit(2)).collect()
    assert {r.conv_id: [tuple(i[:2]) for i in r.ids] for r in got} == {20: [(20, 0)], 21: [(20, 0), (21, 2), (21, 3)], 41: [], 22: [(20, 0)]}


def plain_components(sets: dict[int, set], percent: int):
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("percent", [80, 90])
def test_buckets_lose_no_link(percent):
    """Sets exactly at the threshold, of many sizes, always share a bucket; one element less and they needn't link."""
    rng = np.random.default_rng(4)
    classes = setjoin.size_classes(1 << 20, percent)
    for n in [*range(1, 60), 100, 333, 1000, 2500]:
        for extra in {0, n // 30, max(0, 100 * n // percent - n)}:
            most = setjoin.differing(n, n + extra, percent)
            only = (most - extra) // 2
            if only < 0:
                continue
            pool = np.unique(rng.integers(0, 2**63, 2 * n + extra + 9, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[only:n], pool[n : n + only + extra]]))
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            keys = [set(setjoin.bucket_keys(x, percent, classes).tolist()) for x in (a, b)]
            assert np.array_equal(a, b) or keys[0] & keys[1], (n, extra)


def test_trees_keep_every_link():
    """All that the traversal leaves out is too different, whatever the labels; so components are those of all pairs."""
    rng = np.random.default_rng(5)
    for trial in range(6):
        base = [np.unique(rng.integers(0, 1 << 40, k)) for k in (40, 200, 210)]
        sets = []
        for _ in range(90):
            s = base[rng.integers(3)]
            s = s[rng.random(len(s)) > rng.choice([0, 0.01, 0.04, 0.06])]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 40, rng.integers(0, 6))])))
        labels = np.arange(90) if trial < 3 else rng.integers(0, 60, 90)
        left = np.arange(45)
        right = None if trial % 2 else np.arange(45, 90)
        found = setjoin.links_of([s.astype(np.uint64) for s in sets], labels, np.arange(90) if right is None else left, right, 90)
        pairs = [(i, j) for i in range(90) for j in range(i + 1, 90) if right is None or (i < 45) != (j < 45)]
        true = {(i, j) for i, j in pairs if labels[i] != labels[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
        assert {tuple(sorted(f)) for f in found} <= true

        def parts(links):
            label = {k: k for k in set(labels.tolist())}
            for _ in label:
                for i, j in links:
                    low = min(label[labels[i]], label[labels[j]])
                    label[labels[i]] = label[labels[j]] = low
            return label

        assert parts(found) == parts(true)


@pytest.mark.parametrize("most", [0, 8])
def test_set_join_against_all_pairs(spark, monkeypatch, most):
    """Chains of edits, sizes around a class's ends, odd texts; blocks and hot buckets are small, so all ways are taken."""
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "HOT", 1)
    monkeypatch.setattr(setjoin, "MAX_PAIRS", most)
    monkeypatch.setattr(setjoin, "SAMPLED", 2)
    rng = random.Random(6)
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "one two", 4: "One  TWO", 5: "one", 6: "one two three", 7: "w" * 4000}
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 14, 60, 150]))]
        for _ in range(25):
            texts[len(texts)] = " ".join(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    schema = "doc_id long, text string, n string, keys int, label double"
    docs = spark.createDataFrame([(d, t, "x", 1, 0.5) for d, t in texts.items()] + [(3, "one two", None, None, None)], schema)

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets = {d: grams(t) for d, t in texts.items()}
    want = plain_components(sets, 90)
    got = setjoin.join_similar_sets(docs, 3, 90).collect()
    assert len(got) == len(texts) + 1
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(sets[d]), want[d]) for d in sets}
    assert setjoin.join_similar_sets(docs.limit(0), 3, 90).count() == 0
    null = setjoin.join_similar_sets(spark.createDataFrame([(None, "a b c", "", 1, 0.1), (None, "d", "", 1, 0.1), (9, "d", "", 1, 0.1)], schema), 3, 90)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in null.collect()) == [(0, 0), (0, 9), (9, 9)]
