"""Components of a small graph need no rounds of jobs; those of a graph of several tasks are the same."""

import random

import pytest

from helixframe.llm import neardup


@pytest.mark.parametrize("links", [1 << 15, 40])
def test_components_of_chains(spark, monkeypatch, links):
    kept = []
    cut = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: kept.append(1) or cut(df))
    monkeypatch.setattr(neardup, "LINKS", links)
    ids = random.Random(4).sample(range(-(10**12), 10**12), 300)
    chains = [ids[k : k + 60] for k in range(0, 300, 60)]
    pairs = [(min(p), max(p)) for c in chains for p in zip(c[:-1], c[1:], strict=True)]
    rows = spark.createDataFrame(pairs + pairs[:7], "a long, b long").repartition(9)
    found = {r.node: r.label for r in neardup.components(rows).collect()}
    assert found == {i: min(c) for c in chains for i in c}
    assert links < 100 or len(kept) == 1
    assert neardup.components(rows.limit(0)).count() == 0
    names = spark.createDataFrame([(b"\xff", b"\x01a"), (b"\x01", b"\xff"), (b"b", b"c")], "a binary, b binary")
    assert {bytes(r.node): bytes(r.label) for r in neardup.components(names).collect()} == {b"\xff": b"\x01", b"\x01": b"\x01", b"\x01a": b"\x01", b"b": b"b", b"c": b"b"}
