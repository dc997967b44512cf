"""Blocked joins against plain ones, streams of frames, and errors that are defined."""

import uuid

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.operators import alignments as L
from helixframe.operators import contacts as K
from helixframe.operators import motion as Mo
from helixframe.operators import superpose as Su
from helixframe.sources.shared import shared_dir
from helixframe.streaming import frequency

POINT = "structure_id string, ind int, p struct<x: double, y: double, z: double>"


def cells(spark, rows):
    return spark.createDataFrame(rows, "row long, structure_id string, ind int")


@pytest.mark.parametrize("keyed", [True, False])
def test_correlation_in_blocks(spark, keyed):
    rng = np.random.default_rng(1)
    rows = [(s, int(i), int(f), float(a)) for s in "ab" for i in range(-3, 9) for f in range(23) for a in rng.normal(size=rng.integers(0, 3))]
    df = spark.createDataFrame([*rows, ("a", 1, 5, None), ("c", 1, 5, 0.5), ("a", 2, None, 1.0)], "structure_id string, ind int, frame int, angle double")
    by = ["structure_id"] if keyed else []
    got = {(*[r[b] for b in by], r.ind1, r.ind2): (r.re, r.im) for r in Mo.angle_correlation(df, df.where("ind > 0"), *by, mers=4, frames=7).collect()}
    terms = {}
    for s, i, f, a in rows:
        for t, j, g, b in rows:
            if j > 0 and i < j and f == g and (s == t or not keyed):
                terms.setdefault((*[s] * keyed, i, j), []).append(np.exp(1j * (a - b)))
    if not keyed:  # the mer of structure c meets others in its frame
        for s, i, f, a in rows:
            if f == 5 and i < 1:
                terms.setdefault((i, 1), []).append(np.exp(1j * (a - 0.5)))
            if f == 5 and i > 1:
                terms.setdefault((1, i), []).append(np.exp(1j * (0.5 - a)))
    assert got.keys() == terms.keys()
    assert all(complex(*got[k]) == pytest.approx(np.mean(v), abs=1e-12) for k, v in terms.items())


def test_all_pairs_in_blocks(spark):
    m = spark.createDataFrame([(s, i, (float(i), 0.0, 0.0)) for s, n in (("a", 23), ("b", 1), ("c", 6)) for i in range(n)], POINT)
    left = m.where("ind % 2 = 0")
    got = sorted((r.structure_id, r.ind1, r.ind2, r.a_p.x, r.b_p.x) for r in K.all_pairs(left, m, ["p"], block=4).collect())
    assert got == sorted((s, i, j, float(i), float(j)) for s, n in (("a", 23), ("c", 6)) for i in range(0, n, 2) for j in range(n) if i != j)
    once = [(r.structure_id, *sorted((r.ind1, r.ind2))) for r in K.all_pairs_within(m, ["p"], block=4).collect()]
    assert sorted(once) == sorted((s, i, j) for s, n in (("a", 23), ("c", 6)) for j in range(n) for i in range(j))


def test_all_pairs_of_a_large_structure_spread(spark):
    m = spark.range(64).select(F.lit("a").alias("structure_id"), F.col("id").cast("int").alias("ind"), F.struct(*[F.lit(0.0).alias(i) for i in "xyz"]).alias("p"))
    key = K._dealt(m, ["p"], "a", ["structure_id"], K._blocks(m, ["structure_id"], "_i", 8).withColumn("_j", F.lit(8).cast("long")), "1")
    most = key.groupBy("structure_id", "_i", "_j").count().agg(F.max("count")).first()[0]
    assert key.count() == 64 * 8 and most < 24


def test_multifit_of_turned_shapes(spark):
    rng = np.random.default_rng(2)
    shape = rng.normal(size=(9, 3)) * 5
    rows = [("x", int(k), "abc"[s], tuple(map(float, p))) for s in range(3) for k, p in enumerate(shape @ np.linalg.qr(np.eye(3) + 0.2 * rng.normal(size=(3, 3)))[0] * 1.0 + s)]
    schema = "alignment_id string, row int, structure_id string, p struct<x: double, y: double, z: double>"
    lone = [("x", 99, "a", (0.0, 0.0, 0.0)), ("y", 1, "a", (0.0, 0.0, 0.0)), ("y", 2, "b", (0.0, 0.0, 0.0))]
    got = {(r.alignment_id, r.structure_id): r for r in Su.multifit(spark.createDataFrame(rows + lone, schema), "alignment_id").collect()}
    assert [got["x", s].n for s in "abc"] == [9] * 3 and all(got["y", s].n == 0 and got["y", s].rmsd is None and got["y", s].transform is None for s in "ab")
    with pytest.raises(PySparkException, match="twice in a row"):
        Su.multifit(spark.createDataFrame([*rows, rows[0]], schema), "alignment_id").collect()
    whole = Su.multifit(spark.createDataFrame(rows, schema).drop("alignment_id")).collect()
    assert sorted(r.rmsd for r in whole) == pytest.approx(sorted(got["x", s].rmsd for s in "abc"), abs=1e-6)


def test_frequencies_of_a_stream_count_frames_without_contacts(spark):
    frames = spark.createDataFrame([("a", f) for f in range(8)] + [("b", 0)], "structure_id string, frame int")
    contacts = spark.createDataFrame([("a", 0, 1, 2, 2), ("a", 1, 1, 2, 1), ("a", 6, 3, 4, 2)], "structure_id string, frame int, ind1 int, ind2 int, value int")
    path = f"{shared_dir(spark)}/test-frames-{uuid.uuid4().hex}"
    rows = frequency.mark_frames(contacts, frames)
    rows.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = frequency.with_frequency(frequency.drain(frequency.stream_frequency_map(stream)))
    assert sorted((r.ind1, r.ind2, r.occurs, r.frequency) for r in table.collect()) == [(1, 2, 1.5, 1.5 / 8), (3, 4, 1.0, 1 / 8)]


def test_one_frame_as_a_structure(spark):
    f = spark.createDataFrame([("a", 0, 1, None), ("a", 1, 1, (1.0, 2.0, 3.0)), ("b", 0, 1, (0.0, 0.0, 0.0))], "structure_id string, frame int, ind int, p struct<x: double, y: double, z: double>")
    assert Mo.freeze_frame(f.where("structure_id = 'a'"), 1).select("structure_id", "ind", "p.x").collect() == [("a", 1, 1.0)]
    assert Mo.freeze_frame(f, 0).count() == 2 and Mo.freeze_frame(f.limit(0), 0).count() == 0
    with pytest.raises(PySparkException, match="no frame 1 in b"):
        Mo.freeze_frame(f, 1).count()


def test_a_mer_aligned_twice_is_an_error(spark):
    once = cells(spark, [(1, "a", 1), (1, "b", 1), (2, "a", 2), (2, "b", 2)])
    twice = cells(spark, [(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 2)])
    elsewhere = cells(spark, [(1, "a", 9), (1, "b", 9), (2, "a", 9), (2, "b", 8)])
    assert L.is_consistent_with(once, once).first().consistent
    assert L.is_consistent_with(once, elsewhere).first().consistent  # no mer of both stands twice
    assert L.is_consistent_with(once, twice, repeats=True).first().n_conflicts == 2
    for a, b in ((once, twice), (twice, once)):
        with pytest.raises(PySparkException, match="aligned twice"):
            L.is_consistent_with(a, b).collect()


def test_order_of_structures_names_all_and_no_others(spark):
    c = cells(spark, [(1, "a", 1), (1, "b", 1), (2, "a", 2)])
    assert sorted((r.structure_id, r.column) for r in L.reorder_structures(c, ["b", "a"]).collect()) == [("a", 1), ("a", 1), ("b", 0)]
    for names in (["a"], ["a", "b", "c"], ["a", "c"]):
        with pytest.raises(PySparkException, match="name all aligned structures"):
            L.reorder_structures(c, names).collect()
    with pytest.raises(ValueError, match="twice"):
        L.reorder_structures(c, ["a", "a", "b"])
    assert {r.structure_id: r.column for r in L.reorder_structures(c, ["b", "z"], partial=True).collect()} == {"a": None, "b": 0}


def test_ranks_need_a_key_and_structures_are_counted_without_a_window(spark):
    c = cells(spark, [(1, "a", 1), (1, "b", 1)])
    matches = spark.createDataFrame([(1, 1, 0.5)], "match int, size int, rmsd double")
    for ranked in (lambda: L.alignment_rows(c, 0, 1), lambda: L.rank_matches(matches), lambda: L.rank_alignments(matches), lambda: L.order_alignment(c)):
        with pytest.raises(ValueError, match="tell alignments apart"):
            ranked()
    named = spark.createDataFrame([("a",), ("b",), ("z",)], "structure_id string")
    left = L.drop_empty_structures(c, named)
    assert sorted(map(tuple, left.collect())) == [("a", True), ("b", True)]
    assert [tuple(r) for r in L.drop_empty_structures(c, named.where("structure_id <> 'a'")).collect()] == [("b", False)]
    assert "Window" not in left._jdf.queryExecution().toString()
