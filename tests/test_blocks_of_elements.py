"""Element pairs of descriptor pairs by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_comparison import mixed  # noqa: F401  a fixture

from helixframe.jobs.queries import QUERIES
from helixframe.operators import descriptors as D
from helixframe.operators.superpose import rmsd, solve


def test_fits_from_sums():
    """Newton's steps against the decomposition: random, near, equal, mirrored, flat, straight and single points."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 6):
        p = rng.normal(size=(400, n, 3)) * 20
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        for other in (rng.normal(size=p.shape) * 20, p + rng.normal(size=p.shape) * 0.01, p @ q.T + 5, -p, p * 0, p * [1, 1, 0], p[:, :, :1] * [1.0, 2.0, 3.0]):
            a, b, many = p.sum(1), other.sum(1), np.full(len(p), float(n))
            aa, bb, ab = (p * p).sum((1, 2)), (other * other).sum((1, 2)), np.einsum("kni,knj->kij", p, other)
            got = D.fit_sums(many, a.T, aa, many, b.T, bb, ab.reshape(-1, 9).T)
            assert np.abs(got - solve(many, a, b, aa, bb, ab)[0]).max() < 1e-5


@pytest.mark.parametrize("sizes", [(64, 4096, 1 << 18, 1 << 14), (3, 20, 40, 5)])
def test_blocks_give_what_pairs_give(spark, mixed, monkeypatch, sizes):  # noqa: F811
    """Elements of several kinds; small blocks, fits and batches."""
    for name, value in zip(("BLOCK_DESCRIBED", "BLOCK_PARTNERS", "BLOCK_FITS", "LISTED"), sizes, strict=True):
        monkeypatch.setattr(D, name, value)
    e, desc = mixed
    own = desc.select("structure_id", "centre", F.explode("partners.ind").alias("e"))
    p = e.select("structure_id", F.col("centre").alias("e"), "points", F.array_join("types", ",").alias("types"))
    side = lambda k: own.join(p, ["structure_id", "e"]).join(e.select("structure_id", "centre", F.col("points").alias("o")), ["structure_id", "centre"]).toDF(f"s{k}", f"c{k}", f"e{k}", f"p{k}", f"t{k}", f"o{k}")
    # Not of like centres: contacts of centres of two kinds never fit.
    pairs = side(1).where("s1 = 's0' AND c1 % 5 = 1").join(side(2).where("s2 = 's1'"), F.expr("t1 = t2 AND size(p1) = size(p2)"))
    free = ~((F.abs(F.col("e1") - F.col("c1")) < 3) | (F.abs(F.col("e2") - F.col("c2")) < 3)) | (F.col("e1") - F.col("c1") == F.col("e2") - F.col("c2"))
    plain = pairs.where(free).withColumn("rmsd", rmsd(F.col("p1"), F.col("p2"))).where("rmsd <= 2.5").checkpoint()
    both = plain.where("size(o1) = size(o2)").withColumn("rmsd", rmsd(F.concat("o1", "p1"), F.concat("o2", "p2"))).where("rmsd <= 4")
    same = both.join(e.select(F.col("structure_id").alias("s1"), F.col("centre").alias("c1"), F.col("types").alias("x")), ["s1", "c1"]).join(e.select(F.col("structure_id").alias("s2"), F.col("centre").alias("c2"), F.col("types").alias("y")), ["s2", "c2"]).where("x = y")
    found = desc.where("structure_id = 's0' AND centre % 5 = 1").selectExpr("structure_id AS s1", "centre AS c1").crossJoin(desc.where("structure_id = 's1'").selectExpr("structure_id AS s2", "centre AS c2"))
    shown = lambda df: sorted((r.s1, r.c1, r.e1, r.s2, r.c2, r.e2, round(r.rmsd, 5)) for r in df.collect())
    for want, got in ((plain, D.like_elements(found, desc, e, 2.5)), (same, D.like_elements(found, desc, e, 2.5, 4.0))):
        assert shown(got) == shown(want) and len(shown(want)) > 50


@pytest.mark.parametrize("name", ["c3_element_similarity", "c4_contact_similarity"])
def test_element_pairs_are_not_rows_before_they_fit(spark, sf_dir, name):
    """All pairs of elements of all candidate pairs were joined as rows with their points."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GroupsInArrow" in plan and "ArrowEvalPython" not in plan
