"""Queries over alignments."""

from pyspark.sql import functions as F

from helixframe.jobs import views as W
from helixframe.jobs.registry import query
from helixframe.operators import alignments as L
from helixframe.sources.shared import keep

CELL = "row, structure_id, ind"


def asked(cells):
    return cells.where("structure_id = '1' AND ind % 10 = 0").select("structure_id", "ind")


Q_ROWS = "SELECT DISTINCT row FROM cells WHERE structure_id = '1' AND ind % 10 = 0"


@query("j11_aligned_with", f"WITH {W.CELLS} SELECT structure_id, ind FROM cells WHERE structure_id <> '1' AND row IN ({Q_ROWS}) GROUP BY ALL")
def j11(spark, d):
    c = W.cells(spark, d)
    return L.aligned_with(c, asked(c)).select("structure_id", F.explode("inds").alias("ind"))


@query("j12_extract_aligned_with", f"WITH {W.CELLS} SELECT {CELL} FROM cells WHERE row IN ({Q_ROWS})")
def j12(spark, d):
    c = W.cells(spark, d)
    return L.extract_aligned_with(c, asked(c)).select("row", "structure_id", "ind")


@query("j13_transit", f"""WITH {W.CELLS}, h1 AS (SELECT ind, max(row) AS row FROM cells WHERE structure_id = '2' AND row % 2 = 0 GROUP BY 1), h2 AS (SELECT ind, max(row) AS row FROM cells WHERE structure_id = '2' AND row % 2 = 1 GROUP BY 1)
SELECT a.structure_id AS structure_a, a.ind AS ind_a, c.structure_id AS structure_c, c.ind AS ind_c FROM h1 JOIN h2 USING (ind) JOIN cells a ON a.row = h1.row AND a.structure_id = '1' JOIN cells c ON c.row = h2.row AND c.structure_id = '3'""")
def j13(spark, d):
    c = W.cells(spark, d)
    return L.transit(c.where("row % 2 = 0 AND structure_id IN ('1', '2')"), c.where("row % 2 = 1 AND structure_id IN ('2', '3')"), "2")


@query("j14_common_structures", f"WITH {W.CELLS} SELECT DISTINCT structure_id FROM cells WHERE structure_id < '4'")
def j14(spark, d):
    c = W.cells(spark, d)
    return L.common_structures(c, c.where("structure_id < '4'"))


_PART = "SELECT DISTINCT a.structure_id AS s1, a.ind AS i1, b.structure_id AS s2, b.ind AS i2 FROM cells a JOIN cells b ON a.row = b.row AND a.structure_id <> b.structure_id WHERE a.structure_id < '3' AND b.structure_id < '3' AND a.row % 2 = "


@query("j15_is_consistent_with", f"WITH {W.CELLS}, a AS ({_PART} 0), b AS ({_PART} 1) SELECT count(*) = 0 AS consistent, count(*) AS n_conflicts FROM a JOIN b USING (s1, i1, s2) WHERE a.i2 <> b.i2")
def j15(spark, d):
    c = W.cells(spark, d).where("structure_id < '3'")
    return L.is_consistent_with(c.where("row % 2 = 0"), c.where("row % 2 = 1"), repeats=True)


_ONCE = "SELECT min(ind) FILTER (structure_id = '1') AS i1, min(ind) FILTER (structure_id = '2') AS i2, row % 2 AS side FROM cells WHERE structure_id < '3' GROUP BY row HAVING count(*) = 2"
_ONCE_A_MER = f"SELECT i1, min(i2) AS i2, side FROM (SELECT min(i1) AS i1, i2, side FROM ({_ONCE}) GROUP BY i2, side) GROUP BY i1, side"


@query("j15_consistent_once", f"WITH {W.CELLS}, o AS ({_ONCE_A_MER}), n AS (SELECT (SELECT count(*) FROM o a JOIN o b USING (i1) WHERE a.side = 0 AND b.side = 1 AND a.i2 <> b.i2) + (SELECT count(*) FROM o a JOIN o b USING (i2) WHERE a.side = 0 AND b.side = 1 AND a.i1 <> b.i1) AS n_conflicts) SELECT n_conflicts = 0 AS consistent, n_conflicts FROM n")
def j15_once(spark, d):
    """Pair alignments in which a mer stands once: of its partners the least, from either side."""
    p = L.to_pairs(W.cells(spark, d).where("structure_id < '3'"))
    p = p.groupBy("i2", (F.col("row") % 2).alias("side")).agg(F.min("i1").alias("i1")).groupBy("i1", "side").agg(F.min("i2").alias("i2"))
    c = p.select("side", F.col("i1").alias("row"), F.inline(F.array(F.struct(F.lit("1").alias("structure_id"), F.col("i1").alias("ind")), F.struct(F.lit("2").alias("structure_id"), F.col("i2").alias("ind")))))
    return L.is_consistent_with(c.where("side = 0").drop("side"), c.where("side = 1").drop("side"))


@query("j16_aligned_subsets", f"WITH {W.CELLS} SELECT CAST(l_linenumber AS VARCHAR) AS structure_id, l_partkey AS ind FROM lineitem WHERE EXISTS (SELECT 1 FROM cells c WHERE c.structure_id = CAST(l_linenumber AS VARCHAR) AND c.ind = l_partkey) GROUP BY ALL")
def j16(spark, d):
    m = W.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("structure_id"), F.col("l_partkey").alias("ind")).distinct()
    return L.aligned_subsets(W.cells(spark, d), m)


VERTICES = f"{W.CELLS}, vs AS (SELECT a.row % 40 AS v, a.structure_id AS s1, a.ind AS i1, b.structure_id AS s2, b.ind AS i2 FROM cells a JOIN cells b ON a.row = b.row WHERE a.structure_id = '1' AND b.structure_id = '2')"


def vertices(spark, d, v="row % 40"):
    return L.to_pairs(W.cells(spark, d).where("structure_id IN ('1', '2')")).select(F.expr(v).alias("v"), "s1", "i1", "s2", "i2")


@query("j17_consistency_graph", f"WITH {VERTICES}, cl AS (SELECT x.v AS v1, y.v AS v2 FROM vs x JOIN vs y ON x.i1 = y.i1 WHERE x.i2 <> y.i2 UNION SELECT x.v, y.v FROM vs x JOIN vs y ON x.i2 = y.i2 WHERE x.i1 <> y.i1), ed AS (SELECT a.v AS v1, b.v AS v2 FROM (SELECT DISTINCT v FROM vs) a JOIN (SELECT DISTINCT v FROM vs) b ON a.v < b.v ANTI JOIN cl ON a.v = cl.v1 AND b.v = cl.v2) SELECT * FROM ed")
def j17(spark, d):
    return L.consistency_graph(vertices(spark, d))


@query("j17_contradictions", f"WITH {VERTICES} SELECT x.v AS v1, y.v AS v2 FROM vs x JOIN vs y ON x.i1 = y.i1 WHERE x.i2 <> y.i2 AND x.v < y.v UNION SELECT x.v, y.v FROM vs x JOIN vs y ON x.i2 = y.i2 WHERE x.i1 <> y.i1 AND x.v < y.v")
def j17_contradictions(spark, d):
    return L.contradictions(vertices(spark, d))


# Small alignments for the graph of mers: a vertex is a run of rows, an edge joins one with the next.
RUNS = VERTICES.replace("a.row % 40 AS v", "a.row // 64 AS v")


@query("j18_aligned_mers_graph", f"WITH {RUNS} SELECT a.v AS va, a.i1 AS a1, a.i2 AS a2, b.v AS vb, b.i1 AS b1, b.i2 AS b2 FROM vs a JOIN vs b ON (a.v = b.v OR a.v + 1 = b.v) AND (a.v, a.i1, a.i2) < (b.v, b.i1, b.i2) AND NOT (a.i1 = b.i1 AND a.i2 = b.i2)")
def j18(spark, d):
    w = vertices(spark, d, "row div 64")
    own = w.select("v").distinct()
    edges = own.select(F.col("v").alias("v1"), (F.col("v") + 1).alias("v2")).join(own.withColumnRenamed("v", "v2"), "v2")
    a, b = F.col("a"), F.col("b")
    return L.aligned_mers_graph(w, edges).select(a["v"].alias("va"), a["i1"].alias("a1"), a["i2"].alias("a2"), b["v"].alias("vb"), b["i1"].alias("b1"), b["i2"].alias("b2"))


@query("a13_alignment_size", f"WITH {W.CELLS} SELECT count(DISTINCT row) AS n_rows, count(*) AS n_mers, count(DISTINCT structure_id) AS n_structures FROM cells")
def a13(spark, d):
    return L.alignment_size(W.cells(spark, d))


@query("a13_coverage", f"WITH {W.CELLS} SELECT structure_id, count(DISTINCT ind) AS n_mers FROM cells GROUP BY 1")
def a13b(spark, d):
    return L.coverage(W.cells(spark, d))


@query("a14_prune", f"WITH {W.CELLS} SELECT {CELL} FROM (SELECT *, count(*) OVER (PARTITION BY row) AS n FROM cells) WHERE n >= 2")
def a14(spark, d):
    return L.prune(W.cells(spark, d))


@query("a15_is_internally_consistent", f"WITH {W.CELLS} SELECT max(n) = 1 AS consistent FROM (SELECT count(*) AS n FROM cells GROUP BY structure_id, ind)")
def a15(spark, d):
    return L.is_internally_consistent(W.cells(spark, d))


@query("a16_close", "SELECT p_partkey * 2 AS row, 'M' || s AS structure_id, p_partkey AS ind, false AS ambiguous FROM part, (VALUES (1), (2), (3)) t(s)")
def a16(spark, d):
    return L.close(W.pairs(spark, d), keep)


@query("a17_drop_empty_structures", f"WITH {W.CELLS} SELECT DISTINCT structure_id, true AS enough FROM cells")
def a17(spark, d):
    c = W.cells(spark, d)
    named = c.select("structure_id").distinct().unionByName(W.table(spark, d, "region").select(F.col("r_name").alias("structure_id")))
    return L.drop_empty_structures(c, named)


@query("k1_rank_matches", "SELECT o_custkey AS motif, o_orderkey AS match, CAST(o_totalprice AS DOUBLE) AS rmsd, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def k1(spark, d):
    o = W.table(spark, d, "orders").select(F.col("o_custkey").alias("motif"), F.col("o_orderkey").alias("match"), F.col("o_totalprice").cast("double").alias("rmsd"))
    return L.rank_matches(o, 3, "motif")


@query("k2_rank_alignments", """SELECT grp, match, size, rmsd, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN best - size <= 3 THEN 0 ELSE 1 END, CASE WHEN best - size <= 3 THEN 0 ELSE -size END, rmsd, match) AS rank
FROM (SELECT *, max(size) OVER (PARTITION BY grp) AS best FROM (SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS match, CAST(l_quantity AS INTEGER) AS size, CAST(l_extendedprice AS DOUBLE) AS rmsd FROM lineitem))) WHERE rank <= 5""")
def k2(spark, d):
    t = W.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match"), F.col("l_quantity").cast("int").alias("size"), F.col("l_extendedprice").cast("double").alias("rmsd"))
    return L.rank_alignments(t, 5, 3, "grp")


@query("k3_order_alignment", "SELECT p_partkey // 1000 AS alignment, p_partkey * 2 AS row, 'M' || s AS structure_id, p_partkey AS ind, CAST(row_number() OVER (PARTITION BY s, p_partkey // 1000 ORDER BY p_partkey) - 1 AS INTEGER) AS place FROM part, (VALUES (1), (2)) t(s)")
def k3(spark, d):
    """An alignment for each thousand parts."""
    rows = W.pairs(spark, d).where("row % 2 = 0").withColumn("alignment", F.floor(F.col("ind") / 1000))
    return L.order_alignment(rows, "alignment").select("alignment", "row", "structure_id", "ind", "place")


DASHED = """
    rows AS (SELECT CAST(vec_id AS BIGINT) AS k FROM embeddings),
    cells AS (
        SELECT k // 4096 AS alignment, k AS row, s AS structure_id, CASE WHEN s <> 'A' THEN k WHEN k % 2 = 0 THEN k + 1 ELSE k - 1 END AS ind FROM rows, (VALUES ('A'), ('B'), ('C')) t(s)
        WHERE (s = 'A' AND k % 5 <> 0) OR (s = 'B' AND k % 3 = 0) OR (s = 'C' AND (k % 4 = 0 OR (k % 5 = 0 AND k % 3 <> 0)))),
    counted AS (SELECT alignment, structure_id, row_number() OVER (PARTITION BY alignment ORDER BY count(*) DESC, structure_id) AS k FROM cells GROUP BY alignment, structure_id),
    ranked AS (
        SELECT alignment, row, row_number() OVER (PARTITION BY alignment ORDER BY ind, row) - 1 AS rank
        FROM cells JOIN counted USING (alignment, structure_id) WHERE k = 1),
    placed AS (SELECT * FROM cells LEFT JOIN ranked USING (alignment, row)),
    later AS (
        SELECT *, min(rank) OVER (PARTITION BY alignment, structure_id ORDER BY ind DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM placed),
    gaps AS (SELECT alignment, row, coalesce(min(rank), min(first), 1000000) AS gap, min(rank) IS NOT NULL AS is_ranked FROM later GROUP BY alignment, row),
    places AS (SELECT alignment, row, CAST(row_number() OVER (PARTITION BY alignment ORDER BY gap, is_ranked, row) - 1 AS INTEGER) AS place FROM gaps)"""


@query("k3_order_with_dashes", f"WITH {DASHED} SELECT alignment, row, structure_id, ind, place FROM cells JOIN places USING (alignment, row)")
def k3_dashes(spark, d):
    """An alignment for each 4,096 vectors; a fifth of its rows are dashes in the structure with most mers, whose
    neighbours stand in turned order."""
    k = F.col("vec_id").cast("long")
    one = lambda s, has, ind=k: F.when(has, F.struct(F.lit(s).alias("structure_id"), ind.alias("ind")))
    of_c = (k % 4 == 0) | ((k % 5 == 0) & (k % 3 != 0))
    own = F.array(one("A", k % 5 != 0, F.when(k % 2 == 0, k + 1).otherwise(k - 1)), one("B", k % 3 == 0), one("C", of_c))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(k / 4096).alias("alignment"), k.alias("row"), F.inline(F.array_compact(own)))
    return L.order_alignment(rows, "alignment")


@query("k4_reorder_structures", f"WITH {W.CELLS} SELECT {CELL}, CASE structure_id WHEN '3' THEN 0 WHEN '1' THEN 1 END AS \"column\" FROM cells")
def k4(spark, d):
    return L.reorder_structures(W.cells(spark, d), ["3", "1"], partial=True)


@query("k4_reorder_all_structures", f"WITH {W.CELLS} SELECT {CELL}, CAST(7 - CAST(structure_id AS INTEGER) AS INTEGER) AS \"column\" FROM cells")
def k4_all(spark, d):
    """lineitem's seven line numbers in falling order."""
    return L.reorder_structures(W.cells(spark, d), ["7", "6", "5", "4", "3", "2", "1"])


@query("k5_alignment_rows", f"WITH {W.CELLS} SELECT {CELL} FROM (SELECT *, dense_rank() OVER (PARTITION BY structure_id ORDER BY row) - 1 AS k FROM cells) WHERE k >= 5 AND k < 25")
def k5(spark, d):
    return L.alignment_rows(W.cells(spark, d), 5, 25, "structure_id")


_WIDE = "SELECT DISTINCT list(structure_id || ':' || ind ORDER BY structure_id, ind) AS c FROM cells WHERE structure_id < '4' GROUP BY row"


@query("u5_sum_rows", f"WITH {W.CELLS}, w AS ({_WIDE}) SELECT array_to_string(c, ' ') AS cells FROM w")
def u5(spark, d):
    c = W.cells(spark, d)
    a, b = c.where("row % 2 = 0 OR row % 3 = 0"), c.where("row % 2 = 1 AND structure_id < '4'")
    rows = L.sum_rows(a, b)
    return rows.select(F.array_join(F.transform("cells", lambda x: F.concat(x["structure_id"], F.lit(":"), x["ind"].cast("string"))), " ").alias("cells")).distinct()


_PAIRS = "SELECT a.structure_id AS s1, b.structure_id AS s2, a.row, a.ind AS i1, b.ind AS i2 FROM cells a JOIN cells b ON a.row = b.row AND a.structure_id < b.structure_id"


@query("u6_join_pairs", f"WITH {W.CELLS} SELECT DISTINCT s1, s2, i1, i2 FROM ({_PAIRS})")
def u6(spark, d):
    p = L.to_pairs(W.cells(spark, d))
    return L.join_pairs(p.where("i1 % 2 = 0"), p.where("i1 % 2 = 1 OR i2 % 2 = 0"))


@query("u7_to_pairs", f"WITH {W.CELLS} {_PAIRS}")
def u7(spark, d):
    return L.to_pairs(W.cells(spark, d))


@query("u8_to_columns", f"WITH {W.CELLS}, p AS (SELECT DISTINCT s1, s2, i1, i2 FROM ({_PAIRS})) SELECT structure_id, count(*) AS n FROM (SELECT s1 AS structure_id FROM p UNION ALL SELECT s2 FROM p) GROUP BY 1")
def u8(spark, d):
    p = L.to_pairs(W.cells(spark, d))
    return L.to_columns(L.join_pairs(p, p)).groupBy("structure_id").agg(F.count("*").alias("n"))


@query("u9_limit_to_structures", f"WITH {W.CELLS} {_PAIRS} WHERE a.structure_id IN ('1', '3') AND b.structure_id IN ('1', '3')")
def u9(spark, d):
    names = ["1", "3"]
    return L.limit_pairs_to_structures(L.to_pairs(L.limit_to_structures(W.cells(spark, d), names)), names)
