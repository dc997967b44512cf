"""Two criteria as one map."""

import numpy as np
import pytest

from helixframe.jobs.queries import QUERIES
from helixframe.operators import contacts as K


@pytest.mark.parametrize("name", ["u3_combine_maps", "u4_relative_complement"])
def test_combined_maps_shuffle_no_pairs(spark, sf_dir, name):
    """Both maps were shuffled by pair."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ind1" not in " ".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_criteria_give_what_maps_give(spark):
    rng = np.random.default_rng(4)
    point = lambda: None if rng.random() < 0.1 else tuple(map(float, rng.normal(size=3) * 5))
    rows = [(s, i, point(), point()) for s in "ab" for i in range(50)]
    mers = spark.createDataFrame(rows, "structure_id string, ind int, p struct<x:double,y:double,z:double>, q struct<x:double,y:double,z:double>")
    a, b = K.by_distance("p", 8.0, 1.0), K.by_distance("q", 8.0, 2.0)
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    one, other = K.contact_map(mers, a), K.contact_map(mers, b)
    for both, want in ((a | b, K.combine_maps(one, other)), (a - b, K.relative_complement(one, other))):
        rowwise = K.Criterion(both.value, both.points, both.bounds)
        assert shown(K.contact_map(mers, both)) == shown(K.contact_map(mers, rowwise)) == shown(want) and want.count() > 50
