"""Blocks of mers give arrays of pairs; descriptors come from blocks of centres."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_comparison import mixed  # noqa: F401  a fixture

from helixframe.jobs.queries import QUERIES
from helixframe.operators import alignments as L
from helixframe.operators import contacts as K
from helixframe.operators import descriptors as D
from helixframe.operators.superpose import rmsd


@pytest.mark.parametrize("name", ["j3_protein_criterion", "j3_preset_gc", "j3_preset_rc", "j3_preset_cbx", "j3_preset_ca", "j6_xor", "j7_not"])
def test_maps_leave_tasks_as_arrays(spark, sf_dir, name):
    """Tasks gave a row a pair, which was made again in both directions."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "explode(pairs" in plan and "inline(" not in plan


@pytest.mark.parametrize("strip", [1, 5, 64])
def test_maps_of_several_blocks(spark, monkeypatch, strip):
    monkeypatch.setattr(K, "STRIP", strip)
    rng = np.random.default_rng(3)
    at = {(s, 3 * i): rng.normal(size=3) * 5 for s in "ab" for i in range(40)}
    mers = spark.createDataFrame([(s, i, tuple(map(float, p))) for (s, i), p in at.items()], "structure_id string, ind int, p struct<x:double,y:double,z:double>")
    d = {(*a, b[1]): np.linalg.norm(at[a] - at[b]) for a in at for b in at if a[0] == b[0] and a != b}
    want = sorted((*k, 2 if v <= 7.5 else 1) for k, v in d.items() if v <= 8.5)
    rows = K._summed(mers, K.by_distance("p", 8.0, 0.5), None, None, 17, 1)
    assert sorted((r.structure_id, r.ind1, r.ind2, r.total) for r in rows.collect()) == want and len(want) > 200


@pytest.mark.parametrize("pairs", [1, 90, 1 << 18])
def test_descriptors_by_blocks_of_centres(spark, monkeypatch, pairs):
    """Against joins of listed contacts: elements of several sizes, mers without any, several blocks of centres."""
    monkeypatch.setattr(D, "BLOCK_CENTRES", 11)
    monkeypatch.setattr(D, "BLOCK_PAIRS", pairs)
    rng = np.random.default_rng(4)
    rows = [(s, i, tuple(map(float, rng.normal(size=3) * 4)) if i % 9 else None) for s in "ab" for i in range(50)]
    mers = spark.createDataFrame(rows, "structure_id string, ind int, p struct<x:double,y:double,z:double>")
    elements = mers.where("ind % 4 <> 1 AND structure_id = 'a' OR ind BETWEEN 3 AND 9").selectExpr("structure_id", "ind AS centre", "sequence(ind - 1, ind + 1 + ind % 3) AS inds")
    criterion = K.by_distance("p", 5.0, 0.5)
    shown = lambda df: sorted((r.structure_id, r.centre, [tuple(p) for p in r.partners], r.mers) for r in df.collect())
    got = D.described(mers, criterion, elements)
    assert got._jdf.queryExecution().executedPlan().toString().count("GroupsInArrow") == 1
    want = D.descriptors(K.contact_map(mers, criterion), elements)
    assert shown(got) == shown(want) and want.count() > 30 and got.dtypes == want.dtypes


def test_contacts_of_descriptors_are_not_shuffled(spark, sf_dir):
    """Contacts were rows that met both elements, and then were grouped."""
    plan = QUERIES["c1_descriptors"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ind1" not in plan and "ind2" not in plan


@pytest.mark.parametrize("rows", [3, 2048])
def test_candidates_by_parts_of_cells(spark, mixed, monkeypatch, rows):  # noqa: F811
    """Against all pairs; like centres met as rows with their points, and only a library's cells were cut."""
    monkeypatch.setattr(D, "CELL_ROWS", rows)
    e, desc = mixed
    p = desc.join(e.select("structure_id", "centre", "points", F.array_join("types", ",").alias("types")), ["structure_id", "centre"]).select("structure_id", "centre", F.size("partners").alias("n"), "points", "types")
    side = lambda k: p.toDF(f"s{k}", f"c{k}", f"n{k}", f"p{k}", f"t{k}")
    both = side(1).where("s1 = 's0'").join(side(2), F.expr("t1 = t2 AND size(p1) = size(p2) AND (s1 <> s2 OR c1 <> c2) AND least(n1, n2) >= 0.5 * greatest(n1, n2)"))
    want = both.withColumn("rmsd", rmsd(F.col("p1"), F.col("p2"))).where("rmsd <= 3")
    few = desc.select("structure_id", "centre", F.size("partners").alias("n"))
    shown = lambda df: sorted((r.s1, r.c1, r.s2, r.c2, round(r.rmsd, 5)) for r in df.collect())
    got = D.descriptor_candidates(few.where("structure_id = 's0'"), few, e, 3.0)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert shown(got) == shown(want) and len(shown(want)) > 20
    assert shown(D.descriptor_candidates(desc.where("structure_id = 's0'"), desc, e, 3.0)) == shown(want)


@pytest.mark.parametrize("rows", [2, 1024])
def test_motif_by_parts_of_cells(spark, monkeypatch, rows):
    """Against all choices of runs, with a motif of three segments; and a query's best are found without numbering all."""
    monkeypatch.setattr(D, "MOTIF_ROWS", rows)
    rng = np.random.default_rng(6)
    at = {s: rng.normal(size=(26, 3)) * 6 for s in "ab"}
    point = lambda p: tuple(map(float, p))
    mers = spark.createDataFrame([(s, i, i // 13, point(p)) for s, ps in at.items() for i, p in enumerate(ps)], "structure_id string, ind int, seg int, ca struct<x:double,y:double,z:double>")
    segments = [at["a"][2:5], at["a"][15:17], at["a"][8:9]]
    motif = spark.createDataFrame([(k, len(p), [point(x) for x in p]) for k, p in enumerate(segments)], "seg int, len int, points array<struct<x:double,y:double,z:double>>")
    limit, want = 6.0, {}
    runs = lambda n: [i for i in range(26 - n + 1) if i // 13 == (i + n - 1) // 13]
    for s, ps in at.items():
        for found in ((i, j, k) for i in runs(3) for j in runs(2) for k in runs(1)):
            spans = [set(range(x, x + n)) for x, n in zip(found, (3, 2, 1), strict=True)]
            if len(set().union(*spans)) < 6:
                continue
            sets, used = [ps[x : x + n] for x, n in zip(found, (3, 2, 1), strict=True)], (3, 5, 6)
            fits = [D.placed_rmsd(np.concatenate(segments[:m]), np.concatenate(sets[:m])[None]) for m in (1, 2, 3)]
            alone = all(D.placed_rmsd(segments[m], sets[m][None])[0][0] <= limit for m in (0, 1))
            if alone and all(f[0][0] <= limit * (6 / n) ** 0.5 for f, n in zip(fits, used, strict=True)) and fits[2][1][0] <= limit:
                want[s, found] = round(float(fits[2][0][0]), 6)
    got = D.find_motif(motif, mers, limit)
    assert {(r.structure_id, tuple(r.starts)): round(r.rmsd, 6) for r in got.collect()} == want and len(want) > 20
    best = L.rank_matches(D.find_motif(motif, mers, limit, numbered=False), 3, "structure_id")
    shown = lambda df: sorted((r.structure_id, r["rank"], tuple(r.starts)) for r in df.collect())
    assert shown(best) == shown(L.rank_matches(got, 3, "structure_id"))


def test_best_motifs_number_no_others(spark, sf_dir):
    """All placements of a structure were sorted in one task before the best were taken."""
    plan = QUERIES["c7_find_motif"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "match" not in plan
