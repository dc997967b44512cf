"""Merged numberings and ordered alignments against their plain forms."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.operators import alignments as L
from helixframe.operators import numbering as Nu

IDS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5), st.sampled_from(["", "a"])), max_size=14)


def merged_by_table(first, second):
    """The whole table of what can still be matched, a cell for every pair of places."""
    n, m = len(first), len(second)
    best = np.zeros((n + 1, m + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = max(best[i + 1, j], best[i, j + 1], best[i + 1, j + 1] + 1 if first[i] == second[j] else 0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and first[i] == second[j]:
            out, i, j = [*out, first[i]], i + 1, j + 1
        elif j == m or (i < n and (best[i + 1, j] > best[i, j + 1] or (best[i + 1, j] == best[i, j + 1] and first[i] < second[j]))):
            out, i = [*out, first[i]], i + 1
        else:
            out, j = [*out, second[j]], j + 1
    return list(dict.fromkeys(out))


@settings(max_examples=400, deadline=None)
@given(IDS, IDS, st.booleans())
def test_merged_ids(a, b, tidy):
    if tidy:
        a, b = sorted(set(a)), sorted(set(b))
    assert Nu.merge_ids(a, b) == merged_by_table(a, b)


def test_long_lists_of_ids_are_merged_without_a_table():
    a = [("a", n, "") for n in range(100_000) if n % 7]
    b = [("a", n, "") for n in range(100_000) if n % 5]
    got = Nu.merge_ids(a, b[:40_000] + b[60_000:] + b[40_000:60_000])
    assert set(got) == {*a, *b} and len(got) == len(set(got)) and Nu.merge_ids(a, b) == sorted({*a, *b})


def test_common_numbering_of_models(spark):
    """Structures with crossing, repeated and absent ids; a hundred models with two lists among them."""
    rng = random.Random(3)
    pool = [(c, n, i) for c in "ab" for n in range(4) for i in (None, "a")]
    lists = {"p": [rng.sample(pool, 6) for _ in range(5)], "q": [pool[:5], pool[2:]] * 50, "r": [pool, pool], "s": [pool[:3], []]}
    rows = [(s, m, *x, k) for s, models in lists.items() for m, ids in enumerate(models) for k, x in enumerate(ids)]
    got = {}
    for r in Nu.common_numbering(spark.createDataFrame(rows, "structure_id string, model int, chain string, num int, icode string, pos int")).orderBy("structure_id", "ind").collect():
        got.setdefault(r.structure_id, []).append((r.ind, (r.chain, r.num, r.icode or "")))
    for s, models in lists.items():
        want = []
        for ids in models:
            want = merged_by_table(want, [(c, n, i or "") for c, n, i in ids])
        assert got[s] == list(enumerate(want))


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_alignments(spark, seed):
    """Random alignments: shuffled ones, ones without any order, one with a null key, and one that is nearly all dash rows
    that depend on each other."""
    rng, rows, want = random.Random(seed), [], {}
    for a in [None, *range(60)]:
        n, names = 40 if a == 0 else rng.randint(1, 14), "abcde"[: rng.randint(1, 5)]
        found = []
        for r in range(n):
            have = [s for s in names if rng.random() < 0.45] or [rng.choice(names)]
            found.append({s: r if a is None or a % 3 == 1 else rng.randint(0, n) for s in have})
        if a == 0:
            found = [{s: rng.randint(0, n) for s in rng.sample("bcdef", 2)} for _ in range(n)] + [{"a": k} for k in range(n)]
        rng.shuffle(found)
        rows += [(a, 3 * r, s, i, "x") for r, own in enumerate(found) for s, i in own.items()]
        want |= {(a, 3 * k): at for at, k in enumerate(L.insertion_order(found))}
    df = spark.createDataFrame(rows, "alignment int, row long, structure_id string, ind int, place string")
    got = L.order_alignment(df, "alignment").collect()
    assert sorted((r.alignment or -1, r.row, r.structure_id, r.ind) for r in got) == sorted((r[0] or -1, *r[1:4]) for r in rows)
    assert {(r.alignment, r.row): r.place for r in got} == want


def test_order_of_odd_cells(spark):
    schema = "alignment int, row string, structure_id string, ind int"
    assert L.order_alignment(spark.createDataFrame([], schema), "alignment").collect() == []
    rows = [(1, "r", "a", 5), (1, "r", "a", 1), (1, "q", "a", 3), (1, "q", "a", 3), (1, "p", "b", None)]
    got = {(r.row, r.place) for r in L.order_alignment(spark.createDataFrame(rows, schema), "alignment").collect()}
    assert got == {("q", 0), ("r", 1), ("p", None)}


def test_rows_are_keyed_by_their_contents(spark):
    pairs = spark.createDataFrame([("a", "b", 1, 2), ("a", "b", 1, 3), ("a", "c", 1, 2)], "s1 string, s2 string, i1 int, i2 int")
    cells = L.to_columns(pairs)
    assert sorted(tuple(r) for r in L.to_pairs(cells).drop("row").collect()) == sorted(tuple(r) for r in pairs.collect())
    wide = L.wide_rows(cells).select("cells")
    assert sorted(map(str, L.wide_rows(L.from_wide(wide)).select("cells").collect())) == sorted(map(str, wide.collect()))
