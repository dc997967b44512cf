"""Comparison on whole representations: mers of several points and types, hot cells, many elements, spatial motif joins."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import turned, xyz

from helixframe.jobs import comparison_queries as CQ
from helixframe.jobs.queries import QUERIES
from helixframe.operators import descriptors as D

POINT = "struct<x:double,y:double,z:double>"


def point(x):
    return tuple(map(float, x))


def test_shapes_bound_the_rmsd(spark):
    """Sets of the same size, alike and unlike, turned and moved: shapes never differ by more than the rmsd."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 12):
        base = rng.normal(size=(n, 3)) * 5
        sets = [base + rng.normal(size=(n, 3)) * s for s in (0, 0.1, 1, 3)] + [rng.normal(size=(n, 3)) * 4 for _ in range(12)]
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        sets.append(sets[1] @ (q * np.sign(np.linalg.det(q))).T + 7)
        rows = spark.createDataFrame([(k, [point(p) for p in x]) for k, x in enumerate(sets)], f"k int, points array<{POINT}>")
        f = {r.k: np.array(r.f) for r in rows.select("k", D.shape(F.col("points")).alias("f")).collect()}
        assert all(np.linalg.norm(f[i] - f[j]) <= turned(sets[i], sets[j])[0] + 1e-6 for i, j in combinations(range(len(sets)), 2))
        assert np.allclose(f[1], f[len(sets) - 1], atol=1e-5)


@pytest.fixture(scope="module")
def mixed(spark):
    """Four structures of residues (two points) and nucleotides (three), a third of the elements the same helix."""
    rng = np.random.default_rng(7)
    turn = np.stack([2.3 * np.cos(np.arange(40) * 1.745), 2.3 * np.sin(np.arange(40) * 1.745), 1.5 * np.arange(40)], 1)
    mers, elements, descs = [], [], []
    for s in range(4):
        path = np.concatenate([turn[:14], turn[13] + np.cumsum(rng.normal(size=(26, 3)) * 2.2, 0)])
        for i, p in enumerate(path):
            kind = "Nucleotide" if i >= 30 else "Residue"
            mers.append((f"s{s}", i, kind, [point(p + d) for d in rng.normal(size=(3 if kind == "Nucleotide" else 2, 3)) * (0.05 if i < 14 else 0.5)]))
        for c in range(1, 39):
            elements.append((f"s{s}", c, [c - 1, c, c + 1]))
            partners = sorted(set(rng.choice(np.arange(1, 39), 6).tolist()) - {c})
            descs.append((f"s{s}", c, [(k, 1) for k in partners], sorted({m for e in (c, *partners) for m in (e - 1, e, e + 1)})))
    mers = spark.createDataFrame(mers, f"structure_id string, ind int, type string, whole array<{POINT}>")
    elements = spark.createDataFrame(elements, "structure_id string, centre int, inds array<int>")
    return D.element_points(elements, mers, "whole"), spark.createDataFrame(descs, "structure_id string, centre int, partners array<struct<ind:int,value:int>>, mers array<int>")


def test_all_points_and_types_count(spark, mixed, monkeypatch):
    """Candidates, like elements, contacts and alignments of mixed mers against plain versions; cells are split."""
    monkeypatch.setattr(D, "CELL_ROWS", 5)
    monkeypatch.setattr(D, "PART_ELEMENTS", 3)
    e, desc = mixed
    el = {(r.structure_id, r.centre): (tuple(r.types), xyz(r.points)) for r in e.collect()}
    ds = {(r.structure_id, r.centre): ([p.ind for p in r.partners], r.mers) for r in desc.collect()}
    assert {len(p) for _, p in el.values()} == {6, 7, 8, 9}
    fit = lambda a, b: turned(el[a][1], el[b][1])[0] if el[a][0] == el[b][0] else np.inf
    found = D.descriptor_candidates(desc.where("structure_id = 's0'"), desc.where("structure_id <> 's0'"), e, 2.0).checkpoint()
    want = {(*a, *b) for a in ds for b in ds if a[0] == "s0" != b[0] and 2 * min(len(ds[a][0]), len(ds[b][0])) >= max(len(ds[a][0]), len(ds[b][0])) and fit(a, b) <= 2.0}
    got = [(r.s1, r.c1, r.s2, r.c2) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 100 and {el[k[:2]][0] for k in got} >= {("Residue",) * 3, ("Nucleotide",) * 3}
    few = found.where("c1 % 6 = 1").checkpoint()
    like = D.element_similarity(few, desc, e, 2.5).checkpoint()
    near = lambda c, x: abs(c - x) < 3
    want = set()
    for s1, c1, s2, c2 in ((r.s1, r.c1, r.s2, r.c2) for r in few.collect()):
        for e1 in ds[s1, c1][0]:
            for e2 in ds[s2, c2][0]:
                if (not (near(c1, e1) or near(c2, e2)) or e1 - c1 == e2 - c2) and fit((s1, e1), (s2, e2)) <= 2.5:
                    want.add((s1, c1, e1, s2, c2, e2))
    assert {(r.s1, r.c1, r.e1, r.s2, r.c2, r.e2) for r in like.collect()} == want and want
    both = lambda k: turned(*[np.concatenate([el[k[0 + 3 * x], k[1 + 3 * x]][1], el[k[0 + 3 * x], k[2 + 3 * x]][1]]) for x in (0, 1)])[0]
    pairs = D.contact_similarity(like, 4.0).checkpoint()
    want = {k for k in want if both(k) <= 4.0}
    assert {(r.s1, r.c1, r.e1, r.s2, r.c2, r.e2) for r in pairs.collect()} == want
    alignments = D.compare_descriptors(pairs, desc, 3.0, 0.3).collect()
    by = {}
    for k in sorted(want):
        by.setdefault((k[0], k[1], k[3], k[4]), []).append((k[2], k[5]))
    expected = set()
    for (s1, c1, s2, c2), own in by.items():
        n, m = (max(len(ds[s1, c1][x]), len(ds[s2, c2][x])) for x in (0, 1))
        rms = lambda kept, s1=s1, c1=c1, s2=s2, c2=c2: turned(np.concatenate([el[s1, x][1] for x in (c1, *[a for a, _ in kept])]), np.concatenate([el[s2, x][1] for x in (c2, *[b for _, b in kept])]))[0]
        fine: dict[frozenset, bool] = {}
        for kept in D.free_sets(own, 3):
            kept = [own[k] for k in kept]
            now, dropped = rms(kept), 0
            while now > 3.0 and len(kept) > 1 and dropped < 5:
                kept = min(([k for k in kept if k != o] for o in kept), key=rms)
                now, dropped = rms(kept), dropped + 1
            if now <= 3.0 and len(kept) >= 0.3 * n and len({e + d for e in [c1, *[a for a, _ in kept]] for d in (-1, 0, 1)}) >= 0.33 * m:
                fine[frozenset(kept)] = True
        expected |= {(s1, c1, s2, c2, k) for k in fine if not any(k < o for o in fine)}
    assert {(r.s1, r.c1, r.s2, r.c2, frozenset(tuple(map(int, p.split(":"))) for p in r.pairs)) for r in alignments} == expected and len(expected) > 20


def test_elements_with_a_missing_point_or_mer_are_left_out(spark):
    mers = spark.createDataFrame([("s", 0, [point((0, 0, 0))]), ("s", 1, [None]), ("s", 2, None), ("s", 3, [point((1, 0, 0)), point((2, 0, 0))])], f"structure_id string, ind int, whole array<{POINT}>")
    elements = spark.createDataFrame([("s", 0, [0]), ("s", 1, [0, 1]), ("s", 2, [2]), ("s", 3, [3, 0])], "structure_id string, centre int, inds array<int>")
    got = D.element_points(elements, mers, "whole").collect()
    assert {r.centre: [p.x for p in r.points] for r in got} == {0: [0.0], 3: [1.0, 2.0, 0.0]} and all(r.types == [] for r in got)


def test_maximal_sets_of_random_graphs():
    rng = np.random.default_rng(9)
    for n in (1, 6, 11):
        for share in (0.2, 0.6, 0.95):
            able = np.triu(rng.random((n, n)) < share, 1)
            able |= able.T
            fits = [sum(1 << j for j in range(n) if able[i, j]) for i in range(n)]
            free = {m for m in range(1, 1 << n) if all(m & ~(1 << i) & ~fits[i] == 0 for i in D.bits(m))}
            want = sorted(m for m in free if not any(m | 1 << i in free for i in range(n) if not m >> i & 1))
            assert sorted(D.maximal_sets(fits, range(n))) == want
            assert sorted([*D.maximal_sets(fits, range(0, n, 2)), *D.maximal_sets(fits, range(1, n, 2))]) == want


def test_many_elements_that_cannot_fit(spark):
    """Twelve elements with three wrong partners each have 4^12 maximal sets; few are looked at, as most can't be kept."""
    rng = np.random.default_rng(10)
    a = {e: rng.normal(size=(3, 3)) * 8 for e in range(0, 120, 10)}
    rows = [("a", 1000, e, "b", 1000, e + k * 1000, 3, [point(p) for p in a[e]], [point(p + (0 if k == 0 else 60 * k)) for p in a[e]], [point(p) for p in np.eye(3)], [point(p) for p in np.eye(3)]) for e in a for k in range(4)]
    like = spark.createDataFrame(rows, f"s1 string, c1 int, e1 int, s2 string, c2 int, e2 int, len int, p1 array<{POINT}>, p2 array<{POINT}>, o1 array<{POINT}>, o2 array<{POINT}>")
    desc = spark.createDataFrame([(s, 1000, [(k, 1) for k in range(12)], list(range(39))) for s in "ab"], "structure_id string, centre int, partners array<struct<ind:int,value:int>>, mers array<int>")
    monkey = D.MAX_DROPPED
    try:
        D.MAX_DROPPED = 1
        got = D.compare_descriptors(like, desc, 1.0, 0.95).collect()
    finally:
        D.MAX_DROPPED = monkey
    assert len(got) == 1 and set(got[0].pairs) == {f"{e}:{e}" for e in a} and got[0].rmsd < 1e-6


def test_motifs_of_several_points_a_mer(spark):
    """A structure's own segments are found in it, moved and turned; another type in the way isn't taken."""
    rng = np.random.default_rng(12)
    rows = []
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    base = np.cumsum(rng.normal(size=(200, 3)) * 4, 0)
    for s, moved in (("a", base), ("b", base @ (q * np.sign(np.linalg.det(q))).T + 30), ("c", base)):
        for i, p in enumerate(moved):
            side = (base[i] - base[i - 1]) if s != "b" else (moved[i] - moved[i - 1])
            rows.append((s, i // 50, i, "Nucleotide" if s == "c" and i == 21 else "Residue", [point(p), point(p + side / 3)]))
    mers = spark.createDataFrame(rows, f"structure_id string, seg int, ind int, type string, whole array<{POINT}>")
    own = mers.where("structure_id = 'a'")
    motif = D.runs_of(own, [3, 5], "whole").where("(len = 5 AND start = 20) OR (len = 3 AND start IN (70, 120))").withColumn("seg", F.col("start"))
    got = {(r.structure_id, tuple(r.starts)): r.rmsd for r in D.find_motif(motif, mers, 0.3, "whole").collect()}
    assert set(got) >= {("a", (20, 70, 120)), ("b", (20, 70, 120))} and all(s != "c" or 21 not in range(k[0], k[0] + 5) for s, k in got)
    assert max(v for k, v in got.items() if k[1] == (20, 70, 120)) < 1e-5
    assert D.find_motif(motif.limit(0), mers, 0.3, "whole").count() == 0


def test_c8_all_alignments_are_vertices(spark, sf_dir):
    """Edges of the query against contradictions looked for mer by mer."""
    assert "c8_compare_by_all_alignments" in QUERIES
    alignments = CQ.compared(spark, sf_dir, CQ.CLOSE_CORE, CQ.CLOSE_LIKE).checkpoint()
    cells = D.aligned_mers(D.central_alignments(alignments), 3).collect()
    edges = {(r.v1, r.v2) for r in CQ.graph(spark, sf_dir, alignments).collect()}
    of = {}
    for r in cells:
        of.setdefault(r.v, (r.s1, r.s2, set()))[2].add((r.i1, r.i2))
    agree = lambda x, y: not any((a == c) != (b == d) for a, b in x for c, d in y)
    vertices = {v for e in edges for v in e}
    want = {(v, w) for v, w in combinations(sorted(vertices), 2) if of[v][:2] == of[w][:2] and agree(of[v][2], of[w][2])}
    assert edges == want and edges
