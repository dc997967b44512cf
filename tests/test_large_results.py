"""Results that grow with the square of a structure's mers, or faster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import vec
from helixframe.jobs.queries import QUERIES
from helixframe.operators import contacts as K
from helixframe.operators import descriptors as D
from helixframe.operators import motion as Mo


def test_rounding_without_decimals(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -1.5, 0.125, -0.375, *[k / 42 for k in range(43)], *rng.normal(size=500).tolist()]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 2, 6, 9):
        got = rows.select((vec.rounded(F.col("v"), n) + 0.0).alias("a"), (F.round("v", n) + 0.0).alias("b")).collect()
        assert all(r.a == r.b for r in got)


@pytest.mark.parametrize("name", ["c3_element_similarity", "c4_contact_similarity"])
def test_element_pairs_leave_tasks_as_arrays(spark, sf_dir, name):
    """Tasks gave a row a pair of elements, and each was rounded as a decimal."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "explode(fits" in plan and "round(" not in plan.replace("FlatMapGroups", "")


def test_fits_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(2, 50, 4, 3)) * 9
    args = np.full(50, 4.0), p.sum(1).T, (p * p).sum((1, 2)), np.full(50, 4.0), q.sum(1).T, (q * q).sum((1, 2)), np.einsum("kni,knj->ijk", p, q).reshape(9, -1)
    want = D.fit_sums(*args)
    monkeypatch.setattr(D, "FITTED", 7)
    assert np.abs(D.fit_sums(*args) - want).max() < 1e-9


@pytest.mark.parametrize("tiles", [1, 40, 10**9])
def test_tiles_of_several_blocks(spark, monkeypatch, tiles):
    """Each block met each other in a group of its own, so a mer was sent once for each block of its structure."""
    monkeypatch.setattr(K, "LEAST_TILES", tiles)
    rng = np.random.default_rng(5)
    at = {(s, f, 3 * i): rng.normal(size=3) * 5 for s in "ab" for f in range(5) for i in range(40) if (i + f) % 11}
    frames = spark.createDataFrame([(*k, tuple(map(float, p))) for k, p in at.items()], "structure_id string, frame int, ind int, p struct<x:double,y:double,z:double>")
    criterion = K.by_distance("p", 8.0, 0.5)
    cmap = K.contact_map(frames, K.Criterion(criterion.value, criterion.points, criterion.bounds), "frame")
    shown = lambda df: sorted(tuple(r) for r in df.select("structure_id", "ind1", "ind2", "occurs").collect())
    want = shown(K.frequency_map(cmap, frames))
    for frame_block in (2, 9):
        assert shown(K.contact_frequencies(frames, criterion, block=9, frame_block=frame_block)) == want and len(want) > 100
    few = K.contact_frequencies(frames, criterion, of=F.col("ind") == 6, block=9, frame_block=2)
    assert shown(few) == [r for r in want if r[1] == 6]
    side = K._tiles(frames, F.col("frame").cast("long"), 9, 2)[0]
    assert side == {1: 72, 40: 36, 10**9: 9}[tiles]


@pytest.mark.parametrize("name", ["a5_frequency_map", "a6_frequency_map_from_maps"])
def test_mers_are_sent_once_a_tile(spark, sf_dir, name):
    """Both sides of a tile were sent, and a tile's result was one table."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "CoGroups" not in plan and "round(" not in plan


@pytest.mark.parametrize("tiles", [1, 12])
def test_correlation_in_tiles(spark, monkeypatch, tiles):
    """Ids far apart; a row of each frame was sent once for each 1,024 ids."""
    monkeypatch.setattr(Mo, "LEAST_TILES", tiles)
    rng = np.random.default_rng(7)
    a = {(1000 * i, f): float(rng.normal()) for i in range(30) for f in range(9) if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in a.items()], "ind long, frame int, angle double")
    edges, tasks, several = Mo._sides(df, 4, 5)
    assert len(edges) == {1: 0, 12: 3}[tiles] and several
    got = {(r.ind1, r.ind2): complex(r.re, r.im) for r in Mo.angle_correlation(df, df, mers=4, frames=5).collect()}
    want = {}
    for i in range(30):
        for j in range(i + 1, 30):
            both = [a[1000 * i, f] - a[1000 * j, f] for f in range(9) if (1000 * i, f) in a and (1000 * j, f) in a]
            if both:
                want[1000 * i, 1000 * j] = np.mean(np.exp(1j * np.array(both)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_mers_of_a_correlation_are_sent_as_arrays(spark, sf_dir):
    plan = QUERIES["m10_angle_correlation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan
