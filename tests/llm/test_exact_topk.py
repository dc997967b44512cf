"""Top-k with scores beyond what float64 holds, against Python's integers."""

import math

import numpy as np
import pytest

from helixframe.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("near", "d"), [(2.0**19, 4), (2.0**21.4, 8), (2.0**22.4, 3), (1.0, 4)])
def test_scores_beyond_float64(spark, near, d, monkeypatch):
    """Components of about `near`, alike in all but their last bits, so that scores differ by little; small leaves and shards."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    rng = np.random.default_rng(int(near))
    rows = [(i, (near + rng.integers(-9, 9, d) / 256).tolist()) for i in range(150)] + [(i, (-near + rng.integers(-9, 9, d) / 256).tolist()) for i in range(150, 180)]
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    want = set()
    for q in (i for i in x if i % 50 == 0):
        order = sorted(((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x if i != q))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(order)}
    assert {tuple(r) for r in topk.top_by_inner_product(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert near == 1.0 or max(abs(s) for *_, s in want) > 2**53


def test_what_does_not_fit_is_an_error(spark):
    with pytest.raises(Exception, match="passes 64 bits"):
        topk.top_by_inner_product(spark.createDataFrame([(0, [1e18]), (1, [1.0])], SCHEMA)).collect()
    with pytest.raises(Exception, match="passes 64 bits"):
        topk.top_by_inner_product(spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 2.0])], SCHEMA)).collect()
