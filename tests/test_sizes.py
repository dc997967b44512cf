"""Tables whose size is guessed too low, and long ones."""

import dataclasses

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.jobs.queries import ORACLES, QUERIES
from helixframe.operators import alignments as L
from helixframe.operators import contacts as K
from helixframe.sources import structures as St
from helixframe.sources.shared import keep


def test_closure_broadcasts_nothing(spark, tmp_path):
    """A narrow table of parts becomes four cells each, so its size is guessed too low."""
    spark.range(3000).selectExpr("id AS ind").write.parquet(f"{tmp_path}/t")
    cells = spark.read.parquet(f"{tmp_path}/t").selectExpr("ind", "inline(array(struct(ind * 2 AS row, 'a' AS structure_id), struct(ind * 2 AS row, 'b' AS structure_id), struct(ind * 2 + 1 AS row, 'b' AS structure_id), struct(ind * 2 + 1 AS row, 'c' AS structure_id)))").select("row", "structure_id", "ind")
    plans = []

    def kept(df):
        out = keep(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    got = L.close(cells, kept)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    assert got.count() == 9000 and got.where("row % 2 = 1 OR ambiguous").count() == 0


@pytest.fixture(scope="module")
def long_structures(spark, tmp_path_factory):
    """Two structures of 560 mers: their chains go on to B1."""
    d = str(tmp_path_factory.mktemp("long"))
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v], k % 2) for k, v in enumerate(rng.normal(size=(1120, 64)).astype("float32") / 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def against_sql(name, spark, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    con.execute(ORACLES[name])
    got, names = QUERIES[name](spark, d), [c[0] for c in con.description]
    assert compare.rows(got.columns, [tuple(r) for r in got.collect()]) == compare.rows(names, con.fetchall())


@pytest.mark.parametrize("name", ["s1_parse_pdb", "s4_s7_write_and_read", "s4_read_entries"])
def test_more_chains_than_letters(name, spark, long_structures):
    against_sql(name, spark, long_structures)


def test_written_lines_stay_in_order(spark, tmp_path):
    """Lines come from many tasks, in no order."""
    n = 70_000
    lines = spark.range(n).selectExpr("concat('s', id % 2) AS structure_id", "id AS pos", "concat('line ', id) AS line").repartition(16)
    St.write_lines(lines, f"{tmp_path}/t")
    got = {r.structure_id: r.lines for r in St.read_written(spark, f"{tmp_path}/t").groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"].alias("lines")).collect()}
    assert got == {f"s{k}": [f"line {i}" for i in range(k, n, 2)] for k in (0, 1)}


def test_common_numbering_across_long_chain_names(spark, long_structures):
    """Between Z:20 and A1:1 either model may be the one that lacks a mer."""
    against_sql("a2_common_numbering", spark, long_structures)


@pytest.mark.parametrize("criterion", [K.by_distance("p", 8.0, 0.5), K.by_distance("p", 5.0, 0.5) ^ K.by_distance("q", 6.0, 1.0), ~K.by_distance("p", 6.0, 0.5), K.by_distance("q", 9.0, 1.0) & K.by_difference("p", "q", 0.75, 0.05)])
def test_frequencies_by_blocks(spark, criterion):
    """Against the maps of all frames: mers absent from some frames or without a point, several blocks of mers and frames."""
    rng = np.random.default_rng(7)
    point = lambda: None if rng.random() < 0.05 else tuple(map(float, rng.normal(size=3) * 6))
    rows = [(s, f, i, point(), point()) for s in "ab" for f in (0, 1, 3, 4, 7) for i in range(23) if rng.random() < 0.9]
    frames = spark.createDataFrame(rows, "structure_id string, frame int, ind int, p struct<x:double,y:double,z:double>, q struct<x:double,y:double,z:double>")
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    want = shown(K.frequency_map(K.contact_map(frames, criterion, "frame"), frames))
    assert len(want) > 100
    assert shown(K.contact_frequencies(frames, criterion)) == want
    assert shown(K.contact_frequencies(frames, criterion, block=7, frame_block=3)) == want
    assert shown(K.contact_frequencies(frames, criterion, of=F.col("ind") == 2, block=7)) == [r for r in want if r[1] == 2]


def test_frequencies_shuffle_no_pairs(spark, sf_dir):
    """The maps of frames were shuffled by pair."""
    plan = QUERIES["a5_frequency_map"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ind1" not in " ".join(line for line in plan.splitlines() if "hashpartitioning" in line)


@pytest.mark.parametrize("criterion", [K.by_distance("p", 8.0, 0.5), K.by_distance("p", 5.0, 0.5) ^ K.by_distance("q", 6.0, 1.0), K.by_distance("p", 5.0, 0.5) | (K.by_distance("q", 9.0, 1.0) & K.by_difference("p", "q", 0.75, 0.05)), ~K.by_distance("p", 6.0, 0.5)])
def test_crowded_maps_by_blocks(spark, criterion):
    """Arrays give what rows give; crowded cells choose them, wide apart ones don't."""
    rng = np.random.default_rng(8)
    point = lambda: None if rng.random() < 0.05 else tuple(map(float, rng.normal(size=3) * 5))
    rows = [(s, i, point(), point()) for s in "ab" for i in range(60)]
    mers = spark.createDataFrame(rows, "structure_id string, ind int, p struct<x:double,y:double,z:double>, q struct<x:double,y:double,z:double>")
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    plan = lambda c: K.contact_map(mers, c)._jdf.queryExecution().executedPlan().toString()
    plain = dataclasses.replace(criterion, array=None)
    assert "CoGroupsInArrow" in plan(criterion) and "CoGroupsInArrow" not in plan(plain)
    assert shown(K.contact_map(mers, criterion)) == shown(K.contact_map(mers, plain))
    apart = spark.range(1000).selectExpr("'a' AS structure_id", "CAST(id AS int) AS ind", "struct(id * 50.0D AS x, 0.0D AS y, 0.0D AS z) AS p")
    assert "CoGroupsInArrow" not in K.contact_map(apart, K.by_distance("p", 8.0, 0.5))._jdf.queryExecution().executedPlan().toString()


def test_correlation_of_short_series_shuffles_no_pairs(spark, sf_dir):
    """The products of one block of frames are the result; they were shuffled by pair."""
    plan = QUERIES["m10_angle_correlation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(ind1" in line]
