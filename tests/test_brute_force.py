"""Queries that SQL can't express, against plain versions of what they should give."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.jobs import comparison_queries as CQ
from helixframe.jobs import views as W
from helixframe.jobs.queries import QUERIES
from helixframe.operators import alignments as L
from helixframe.operators import descriptors as D
from helixframe.operators import mers as M


def turned(a, b):
    """rmsd of b on a, and b after the best turn, by the largest eigenvalue of a quaternion matrix."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    ma, mb = a.mean(0), b.mean(0)
    p, q = b - mb, a - ma
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = p.T @ q
    k = np.array([
        [xx + yy + zz, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ])
    values, vectors = np.linalg.eigh(k)
    w, x, y, z = vectors[:, -1]
    turn = np.array([
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ])
    rmsd = np.sqrt(max((p**2).sum() + (q**2).sum() - 2 * values[-1], 0) / len(a))
    return rmsd, p @ turn.T + ma


def xyz(points):
    return np.array([[p["x"], p["y"], p["z"]] for p in points], float)


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    out = {}
    for r in W.frames(spark, sf_dir).collect():
        out.setdefault((r.structure_id, r.frame), {})[r.ind] = (r.p.x, r.p.y, r.p.z)
    return out


def test_a10_superpose(spark, sf_dir, frames):
    rows = QUERIES["a10_superpose"](spark, sf_dir).collect()
    assert {(r.structure_id, r.frame) for r in rows} == set(frames)
    for r in rows:
        first, own = frames[r.structure_id, 0], frames[r.structure_id, r.frame]
        inds = sorted(set(first) & set(own))
        assert r.n == len(inds) and r.rmsd == pytest.approx(turned([first[i] for i in inds], [own[i] for i in inds])[0], abs=2e-4)


def test_a11_superpose_by_alignment(spark, sf_dir):
    points = {}
    for r in W.mers(spark, sf_dir).collect():
        points.setdefault(r.structure_id, {})[r.ind] = xyz([r.atoms["CA"], r.atoms["CB"]])
    rows = QUERIES["a11_superpose_by_alignment"](spark, sf_dir).collect()
    assert {r.structure_id for r in rows} == set(points) - {"0"}
    for r in rows:
        inds = sorted(set(points["0"]) & set(points[r.structure_id]))
        a, b = (np.concatenate([points[s][i] for i in inds]) for s in ("0", r.structure_id))
        assert r.n == len(a) and r.rmsd == pytest.approx(turned(a, b)[0], abs=2e-4)


def test_a12_multifit(spark, sf_dir, frames):
    rows = {(r.alignment_id, r.structure_id): r.rmsd for r in QUERIES["a12_multifit"](spark, sf_dir).collect()}
    for s in sorted({s for s, _ in frames}):
        own = {str(f): p for (t, f), p in frames.items() if t == s}
        inds = sorted(set.intersection(*(set(p) for p in own.values())))
        names = sorted(own)
        sets = [np.array([own[f][i] for i in inds]) for f in names]
        mean, old = sets[0], np.inf
        for _ in range(100):
            fits, sets = zip(*[turned(mean, x) for x in sets], strict=True)
            worst = max(f * f * len(inds) for f in fits)
            if old - worst <= 0.1:
                break
            mean, old = np.mean(sets, axis=0), worst
        for f, fit in zip(names, fits, strict=True):
            assert rows[s, f] == pytest.approx(fit, abs=2e-3)


def test_a12_transforms_from_the_mean(spark, sf_dir, frames):
    """Each frame on the mean of all as they stand, round by round; the transforms move them where the rounds do."""
    rows = {(r.alignment_id, r.structure_id): r for r in QUERIES["a12_multifit_transforms"](spark, sf_dir).collect()}
    assert len(rows) == len(frames)
    for s in sorted({s for s, _ in frames}):
        own = {str(f): p for (t, f), p in frames.items() if t == s}
        inds, names = sorted(set.intersection(*(set(p) for p in own.values()))), sorted(own)
        given = sets = [np.array([own[f][i] for i in inds]) for f in names]
        old = np.inf
        while True:
            mean = np.mean(sets, axis=0)
            fits, sets = zip(*[turned(mean, x) for x in sets], strict=True)
            worst = max(f * f * len(inds) for f in fits)
            if old - worst <= 0.1:
                break
            old = worst
        for f, fit, before, after in zip(names, fits, given, sets, strict=True):
            r = rows[s, f]
            assert r.n == len(inds) and r.rmsd == pytest.approx(fit, abs=1e-4)
            assert before @ np.array(r.rot).reshape(3, 3).T + np.array(list(r.post.asDict().values())) == pytest.approx(after, abs=1e-5)


@pytest.fixture(scope="module")
def described(spark, sf_dir):
    """Elements' points, and descriptors' partners and mers, of the view."""
    _, e, desc = CQ.parts(spark, sf_dir)
    points = {(r.structure_id, r.centre): xyz(r.points) for r in e.collect()}
    return points, {(r.structure_id, r.centre): ([p.ind for p in r.partners], r.mers) for r in desc.collect()}


def plain_candidates(points, descs):
    out = {}
    for a in (x for x in descs if x[0] == "0"):
        for b in (x for x in descs if x[0] != "0"):
            n, m = len(descs[a][0]), len(descs[b][0])
            if min(n, m) >= 0.5 * max(n, m) and (fit := turned(points[a], points[b])[0]) <= CQ.CORE:
                out[*a, *b] = fit
    return out


def test_c2_descriptor_candidates(spark, sf_dir, described):
    want = plain_candidates(*described)
    got = {(r.s1, r.c1, r.s2, r.c2): r.rmsd for r in QUERIES["c2_descriptor_candidates"](spark, sf_dir).collect()}
    edge = {k for k, v in want.items() if abs(v - CQ.CORE) < 1e-3}
    assert set(got) - edge == set(want) - edge and len(got) > 20
    assert all(got[k] == pytest.approx(want[k], abs=2e-4) for k in got if k in want)


def plain_like(points, descs, pairs):
    for s1, c1, s2, c2 in pairs:
        for e1 in descs[s1, c1][0]:
            for e2 in descs[s2, c2][0]:
                near = abs(e1 - c1) < 3 or abs(e2 - c2) < 3
                if not near or e1 - c1 == e2 - c2:
                    yield (s1, c1, e1, s2, c2, e2), turned(points[s1, e1], points[s2, e2])[0], turned(np.concatenate([points[s1, c1], points[s1, e1]]), np.concatenate([points[s2, c2], points[s2, e2]]))[0]


def test_c3_and_test_c4_like_elements_and_contacts(spark, sf_dir, described):
    points, descs = described
    every = list(plain_like(points, descs, sorted(plain_candidates(points, descs))[:150]))
    asked = {k[:2] + k[3:5] for k, *_ in every}
    rows = lambda name: {(r.s1, r.c1, r.e1, r.s2, r.c2, r.e2): r.rmsd for r in QUERIES[name](spark, sf_dir).collect() if (r.s1, r.c1, r.s2, r.c2) in asked}
    for name, want in (("c3_element_similarity", {k: a for k, a, _ in every if a <= CQ.LIKE}), ("c4_contact_similarity", {k: b for k, a, b in every if a <= CQ.LIKE and b <= CQ.LIKE})):
        got = rows(name)
        edge = {k for k in {*got, *want} if abs(got.get(k, want.get(k)) - CQ.LIKE) < 1e-3}
        assert set(got) - edge == set(want) - edge and got
        assert all(got[k] == pytest.approx(want[k], abs=2e-4) for k in got if k in want)


def plain_comparison(points, key, pairs, counts, mers, threshold, coverage, mer_coverage):
    """Every subset is tried for being a maximal set without contradiction, then loses its worst elements one by one."""
    s1, c1, s2, c2 = key
    clash = lambda a, b: (b[0] - a[0] != b[1] - a[1]) and (abs(b[0] - a[0]) < 3 or abs(b[1] - a[1]) < 3)
    free = [m for m in range(1 << len(pairs)) if not any(clash(pairs[i], pairs[j]) for i in range(len(pairs)) for j in range(i) if m >> i & 1 and m >> j & 1)]
    maximal = [m for m in free if not any(m | 1 << i in set(free) for i in range(len(pairs)) if not m >> i & 1)]
    fit = lambda kept: turned(*[np.concatenate([points[s, c], *[points[s, pairs[k][side]] for k in kept]]) for side, (s, c) in enumerate(((s1, c1), (s2, c2)))])[0]
    found = {}
    for m in maximal:
        kept = [i for i in range(len(pairs)) if m >> i & 1]
        now = fit(kept)
        for _ in range(5):
            if now <= threshold or len(kept) < 2:
                break
            kept = min(([k for k in kept if k != out] for out in kept), key=fit)
            now = fit(kept)
        n = len({e + d for e in [c1, *[pairs[k][0] for k in kept]] for d in (-1, 0, 1)})
        if now <= threshold and len(kept) >= coverage * max(counts) and n >= mer_coverage * max(mers):
            found[frozenset(kept)] = n, now
    return {frozenset(pairs[k] for k in kept): v for kept, v in found.items() if not any(kept < o for o in found)}


@pytest.mark.parametrize("threshold", [8.0, 4.0])
def test_c5_c6_comparison_against_all_subsets(spark, sf_dir, described, threshold):
    points, descs = described
    found, desc, e = CQ.candidates(spark, sf_dir)
    like = D.contact_similarity(D.element_similarity(found, desc, e, CQ.LIKE), CQ.LIKE)
    few = like.groupBy("s1", "c1", "s2", "c2").agg(F.count("*").alias("n")).where("n BETWEEN 5 AND 9").orderBy("s1", "c1", "s2", "c2").limit(25).drop("n")
    like = like.join(few, ["s1", "c1", "s2", "c2"]).checkpoint()
    rows = {}
    for r in like.select("s1", "c1", "s2", "c2", "e1", "e2").collect():
        rows.setdefault((r.s1, r.c1, r.s2, r.c2), []).append((r.e1, r.e2))
    got = {}
    for r in D.compare_descriptors(like, desc, threshold, 0.3).collect():
        pairs = frozenset(tuple(map(int, p.split(":"))) for p in r.pairs)
        got.setdefault((r.s1, r.c1, r.s2, r.c2), {})[pairs] = r["size"], r.rmsd
    assert rows
    for key, pairs in rows.items():
        one, two = descs[key[:2]], descs[key[2:]]
        want = plain_comparison(points, key, sorted(pairs), (len(one[0]), len(two[0])), (len(one[1]), len(two[1])), threshold, 0.3, 0.33)
        own = got.get(key, {})
        assert set(own) == set(want), key
        assert all(own[k][0] == want[k][0] and own[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in own)


def test_c7_motif_against_all_placements(spark):
    """Two and three segments, one of a single mer, on runs with and without the right types."""
    rng = np.random.default_rng(11)
    rows = []
    for s in range(3):
        p = rng.normal(size=(22, 3)) * 3
        rows += [(f"s{s}", 0 if i < 12 else 1, i, "Residue" if (i + s) % 11 else "Nucleotide", tuple(map(float, x))) for i, x in enumerate(p)]
    mers = spark.createDataFrame(rows, "structure_id string, seg int, ind int, type string, ca struct<x:double,y:double,z:double>")
    limit = 3.2
    wanted = [("Residue",) * 3, ("Residue",) * 2, ("Residue",)]
    shape = [rng.normal(size=(len(t), 3)) * 3 for t in wanted]
    point = lambda x: tuple(map(float, x))
    motif = spark.createDataFrame([(k, len(t), [point(x) for x in p], list(t)) for k, (t, p) in enumerate(zip(wanted, shape, strict=True))], "seg int, len int, points array<struct<x:double,y:double,z:double>>, types array<string>")
    got = {(r.structure_id, tuple(r.starts)): r.rmsd for r in D.find_motif(motif, mers, limit).collect()}
    want = {}
    for s in range(3):
        own = [r for r in rows if r[0] == f"s{s}"]
        runs = [[i for i in range(22 - len(t) + 1) if len({own[i + d][1] for d in range(len(t))}) == 1 and tuple(own[i + d][3] for d in range(len(t))) == t] for t in wanted]
        for starts in product(*runs):
            used = [i + d for i, t in zip(starts, wanted, strict=True) for d in range(len(t))]
            if len(set(used)) < len(used):
                continue
            fits, before = True, 0
            for k, t in enumerate(wanted):
                here = [own[i + d][4] for i, u in zip(starts[: k + 1], wanted, strict=False) for d in range(len(u))]
                target = np.concatenate(shape[: k + 1])
                fit, moved = turned(target, here)
                alone = turned(shape[k], [own[starts[k] + d][4] for d in range(len(t))])[0] if len(t) > 1 else 0.0
                fits &= alone <= limit and fit <= limit * np.sqrt(6 / (before + len(t))) and (len(t) > 1 or np.linalg.norm(moved[-1] - target[-1]) <= limit)
                before += len(t)
            if fits:
                want[f"s{s}", starts] = fit
    assert set(got) == set(want) and len(want) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_c7_query_ranks_placements_within_the_limit(spark, sf_dir):
    rows = QUERIES["c7_find_motif"](spark, sf_dir).collect()
    assert rows and all(r.rmsd <= 7.0 * np.sqrt(7 / 7) + 1e-4 for r in rows)
    for s in {r.structure_id for r in rows}:
        own = sorted((r["rank"], r.rmsd) for r in rows if r.structure_id == s)
        assert [k for k, _ in own] == list(range(1, len(own) + 1)) and len(own) <= 5 and [f for _, f in own] == sorted(f for _, f in own)


def test_motifs_have_a_bounded_number_of_segments(spark):
    with pytest.raises(ValueError, match="at most"):
        motif = spark.range(D.MAX_SEGMENTS + 1).select(F.col("id").alias("seg"), F.lit(1).alias("len"), F.array(F.struct(*[F.lit(0.0).alias(i) for i in "xyz"])).alias("points"))
        D.find_motif(motif, spark.createDataFrame([("s", 0, 0, (0.0, 0.0, 0.0))], "structure_id string, seg int, ind int, ca struct<x:double,y:double,z:double>"), 1.0)


def test_c8_bent_vertices_and_their_graph(spark):
    """Two structures of long and short bonded runs; alignments with short parts go, and those that disagree have no edge."""
    runs = {"a": [(0, 40), (50, 60)], "b": [(0, 40), (60, 64)]}
    mers = [(s, i, True, i + 1 if i < e - 1 else None, 4.0 if i < e - 1 else None) for s, own in runs.items() for b, e in own for i in range(b, e)]
    mers = spark.createDataFrame(mers, "structure_id string, ind int, chainable boolean, next_ind int, adjusted_length double")
    descs = [("a", 5, list(range(0, 20))), ("a", 6, list(range(50, 53))), ("b", 5, list(range(0, 20))), ("b", 6, list(range(60, 64)))]
    descs = spark.createDataFrame(descs, "structure_id string, centre int, mers array<int>")
    side = lambda v, c1, c2, i, j, n: [(v, "a", c1, "b", c2, i + k, j + k) for k in range(n)]
    rows = side("same", 5, 5, 0, 0, 15) + side("shift", 5, 5, 0, 3, 15) + side("later", 5, 5, 15, 15, 15) + side("short", 5, 5, 0, 0, 6) + side("small", 6, 5, 0, 0, 15) + side("tiny", 5, 6, 0, 0, 15)
    cells = spark.createDataFrame(rows, "v string, s1 string, c1 int, s2 string, c2 int, i1 int, i2 int")

    def number(s, inds):
        total, inds = 0, sorted(inds)
        for b, e in runs[s]:
            own = [i for i in inds if b <= i < e]
            for run in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1) if own else []:
                total += max(1, int(np.ceil(sum(4.0 for _ in run[2:-2]) / 18.0)))
        return total

    want = {v for v in {r[0] for r in rows} if all(number(s, {r[k] for r in rows if r[0] == v}) >= 2 for s, k in (("a", 5), ("b", 6)))} - {"small", "tiny"}
    bent = L.bent_enough(cells, descs, mers)
    assert {r.v for r in bent.select("v").distinct().collect()} == want == {"same", "shift", "later"}
    assert {tuple(r) for r in L.consistency_graph(bent).collect()} == {("later", "same")}
    assert {tuple(sorted(r)) for r in L.contradictions(bent).collect()} == {("same", "shift"), ("later", "shift")}


def plain_adi(v):
    r1, r2 = abs(np.exp(1j * v).sum()), abs(np.exp(2j * v).sum())
    return len(v) * (len(v) - r2) / (2 * r1**2)


def plain_blocks(v, start, size, most):
    out = []
    while len(out) < max(1, most) and (not out or start + size * (len(out) + 1) <= len(v)):
        out.append(plain_adi(v[start + size * len(out) : start + size * (len(out) + 1)]))
    return out


def plain_atip(v):
    old = 0.0
    for p in range(2, int(len(v) / min(20, len(v) * 0.25))):
        size = len(v) // p
        values = plain_blocks(v, 0, size, p) + plain_blocks(v, size // 2, size, p)
        if max(values) - min(values) < old:
            break
        old = max(values) - min(values)
    return old


def plain_atin(v):
    size = int(min(20, len(v) * 0.25))
    least = min(min(plain_blocks(v, s, size, len(v) // size)) for s in (0, size // 2))
    pairs = len(v) // 2
    spread = 0.0
    for s in (2, 1):
        x = np.array(plain_blocks(v, s, 2, pairs))
        spread = max(spread, np.sqrt(max((x * x).sum() / pairs - (x.sum() / pairs) ** 2, 0.0)))
    return (spread - least) / 0.0014


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    out = {}
    for r in W.angles(spark, sf_dir).orderBy("ind", "frame").collect():
        out.setdefault(r.ind, []).append(r.angle)
    return {k: np.array(v) for k, v in out.items()}


def test_m5_m6_block_indices(spark, sf_dir, series):
    rows = QUERIES["m5_m6_block_indices"](spark, sf_dir).collect()
    assert {r.ind for r in rows} == set(series)
    for r in rows:
        assert r.atip == pytest.approx(plain_atip(series[r.ind]), rel=1e-6, abs=1e-9)
        assert r.atin == pytest.approx(plain_atin(series[r.ind]), rel=1e-6, abs=1e-6, nan_ok=True)


def test_m9_motion_indices(spark, sf_dir, series):
    degrees = lambda x: np.degrees(np.arccos((1 - x) / (1 + x)))
    for r in QUERIES["m9_motion_indices"](spark, sf_dir).collect():
        v = series[r.ind]
        adi, atip = plain_adi(v), plain_atip(v)
        cumulative = plain_adi(np.angle(np.cumsum(np.exp(1j * v))))
        padcum, pai = degrees(cumulative), np.degrees(np.arctan2(atip, adi))
        want = degrees(adi), padcum, degrees(np.hypot(adi, atip)), pai, plain_atin(v)
        assert (r.pad, r.padcum, r.tai, r.pai, r.atin) == pytest.approx(want, rel=1e-5, abs=1e-5, nan_ok=True)
        assert r.tag == ("F" if padcum < 10 or pai < 30 else "t" if pai > 60 else "T")


def test_spread_bounds_the_rmsd(spark):
    rng = np.random.default_rng(2)
    sets = rng.normal(size=(40, 3, 3)) * rng.uniform(1, 8, (40, 1, 1))
    rows = spark.createDataFrame([([tuple(map(float, p)) for p in x],) for x in sets], "points array<struct<x:double,y:double,z:double>>")
    got = np.array([r.g for r in rows.select(D.spread(F.col("points")).alias("g")).collect()])
    assert sorted(got) == pytest.approx(sorted(np.sqrt(((x - x.mean(0)) ** 2).sum() / 3) for x in sets))
    g = [np.sqrt(((x - x.mean(0)) ** 2).sum() / 3) for x in sets]
    assert all(turned(sets[i], sets[j])[0] >= abs(g[i] - g[j]) - 1e-9 for i in range(40) for j in range(i))


def test_elements_of_windows(spark):
    with pytest.raises(ValueError, match="odd"):
        M.elements(spark.range(1), None, 4)
