"""The given tables in the shape of structures: views for queries and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import vec

# Residue names of the view, by vec_id modulo 20.
NAMES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
ATOMS = ("N", "C", "CB", "O")
PER_CHAIN, CA_SCALE, ATOM_SCALE = 20, 60, 5
#: A bond threshold at which a share of the view's neighbours are bonded.
BOND = 20.0
FRAMES = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with structure_id, ind, chain and num."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("structure_id"))
    e = e.withColumn("ind", (F.row_number().over(Window.partitionBy("structure_id").orderBy("vec_id")) - 1).cast("int"))
    k = F.floor(F.col("ind") / PER_CHAIN).cast("int")
    chain = F.concat(F.char(65 + k % 26), F.when(k >= 26, F.floor(k / 26).cast("string")).otherwise(""))
    return e.select("*", chain.alias("chain"), (F.col("ind") % PER_CHAIN + 1).cast("int").alias("num"))


def mers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a mer: structure_id, ind, chain, num, icode, name, type, chainable, atoms (map of points), ss, vec_id."""
    e = vectors(spark, sf_dir)
    at = lambda k: F.col("embedding")[k].cast("double")
    ca = [at(i) * float(CA_SCALE) for i in range(3)]
    atoms = [F.lit("CA"), vec.point(*ca)]
    for n, a in enumerate(ATOMS, 1):
        atoms += [F.lit(a), vec.point(*[ca[i] + at(3 * n + i) * float(ATOM_SCALE) for i in range(3)])]
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("vec_id") % 20 + 1).cast("int"))
    ligand = F.col("vec_id") % 17 == 0
    return e.select(
        "structure_id", "ind", "chain", "num", F.lit(None).cast("string").alias("icode"), name.alias("name"),
        F.when(ligand, "Compound").otherwise("Residue").alias("type"), (~ligand).alias("chainable"), F.create_map(*atoms).alias("atoms"),
        F.substring(F.lit("HBEGITS-"), (F.col("vec_id") % 8 + 1).cast("int"), F.lit(1)).alias("ss"), "vec_id",
    )


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an atom, as read from a file; water, ions and modified names among them."""
    m = mers(spark, sf_dir)
    v = F.col("vec_id")
    res = F.when(v % 23 == 0, "HOH").when(v % 29 == 0, "MG").when(v % 19 == 0, "MSE").otherwise(F.col("name"))
    kept = F.when(v % 23 == 0, F.array(F.lit("O"))).when(v % 29 == 0, F.array(F.lit("CB"))).when(v % 17 == 0, F.array(F.lit("CB"), F.lit("O"))).otherwise(F.array(*map(F.lit, ("N", "CA", "C", "CB", "O"))))
    rows = m.select("structure_id", "chain", "num", "icode", res.alias("res_name"), "ind", "atoms", F.posexplode(kept).alias("k", "atom_name"))
    p = F.col("atoms")[F.col("atom_name")]
    return rows.select(
        "structure_id", F.lit(1).alias("model"), "chain", "num", "icode", "res_name", "atom_name", (F.col("ind") * 5 + F.col("k") + 1).alias("serial"),
        F.substring("atom_name", 1, 1).alias("element"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), (F.col("ind") * 5 + F.col("k")).cast("long").alias("pos"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(structure_id, frame, ind, p): CA of every mer in every frame."""
    e = vectors(spark, sf_dir)
    rows = e.select("structure_id", "ind", "embedding", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    at = lambda k: F.get("embedding", F.col("frame") * 3 + k).cast("double") * float(CA_SCALE)
    return rows.select("structure_id", "frame", "ind", vec.point(at(0), at(1), at(2)).alias("p"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ind, frame, angle) from events: one mer a user, angles folded to (-pi, pi]."""
    e = table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    v = F.col("value").cast("double")
    return e.select(F.col("user_id").alias("ind"), frame.cast("int").alias("frame"), F.atan2(F.sin(v), F.cos(v)).alias("angle"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment cells (row, structure_id, ind) from lineitem."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("string").alias("structure_id")).agg(F.min("l_partkey").alias("ind"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent cells from part: rows (M1:p, M2:p) and (M2:p, M3:p)."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ind"))
    row = lambda k: F.array(*[F.struct((F.col("ind") * 2 + k).alias("row"), F.lit(f"M{k + s}").alias("structure_id")) for s in (1, 2)])
    return t.select("ind", F.inline(F.concat(row(0), row(1)))).select("row", "structure_id", "ind")


# The same in SQL. Vectors are triples of expressions.


class V(tuple):
    def __sub__(self, o):
        return V(f"({a} - {b})" for a, b in zip(self, o, strict=True))

    def __add__(self, o):
        return V(f"({a} + {b})" for a, b in zip(self, o, strict=True))

    def __mul__(self, k):
        return V(f"({a} * ({k}))" for a in self)


def v(name: str) -> V:
    return V(f"{name}_{i}" for i in "xyz")


def sdot(a: V, b: V) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def scross(a: V, b: V) -> V:
    return V(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def slen(a: V) -> str:
    return f"sqrt({sdot(a, a)})"


def sunit(a: V) -> V:
    return a * f"1 / {slen(a)}"


def select(a: V, name: str, digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {name}_{i}" for e, i in zip(a, "xyz", strict=True))


def _atom(name: str, k: int) -> str:
    return ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 60.0" + (f" + CAST(embedding[{3 * k + i + 1}] AS DOUBLE) * 5.0" if k else "") + f" AS {name}_{'xyz'[i]}" for i in range(3))


VECTORS = """vectors AS (SELECT *, CAST(ind // 20 AS INTEGER) AS k, chr(CAST(65 + (ind // 20) % 26 AS INTEGER)) || CASE WHEN ind // 20 >= 26 THEN CAST(ind // 520 AS VARCHAR) ELSE '' END AS chain,
  CAST(ind % 20 + 1 AS INTEGER) AS num FROM (SELECT vec_id, embedding, CAST(label AS VARCHAR) AS structure_id,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS ind FROM embeddings))"""
MERS = f"""{VECTORS}, mers AS (SELECT structure_id, ind, chain, num, CAST(NULL AS VARCHAR) AS icode, vec_id,
  (['{"','".join(NAMES)}'])[CAST(vec_id % 20 + 1 AS INTEGER)] AS name, CASE WHEN vec_id % 17 = 0 THEN 'Compound' ELSE 'Residue' END AS type, vec_id % 17 <> 0 AS chainable,
  substr('HBEGITS-', CAST(vec_id % 8 + 1 AS INTEGER), 1) AS ss, {_atom("ca", 0)}, {_atom("n", 1)}, {_atom("c", 2)}, {_atom("cb", 3)}, {_atom("o", 4)} FROM vectors)"""
ATOM_ROWS = f"""{MERS}, atoms AS (SELECT structure_id, chain, num, icode, ind, vec_id, res_name, atom_name, ind * 5 + k AS pos FROM (
  SELECT *, CASE WHEN vec_id % 23 = 0 THEN 'HOH' WHEN vec_id % 29 = 0 THEN 'MG' WHEN vec_id % 19 = 0 THEN 'MSE' ELSE name END AS res_name,
    unnest(CASE WHEN vec_id % 23 = 0 THEN ['O'] WHEN vec_id % 29 = 0 THEN ['CB'] WHEN vec_id % 17 = 0 THEN ['CB', 'O'] ELSE ['N', 'CA', 'C', 'CB', 'O'] END) AS atom_name,
    unnest(CASE WHEN vec_id % 23 = 0 OR vec_id % 29 = 0 THEN [0] WHEN vec_id % 17 = 0 THEN [0, 1] ELSE [0, 1, 2, 3, 4] END) AS k FROM mers))"""
FRAME_ROWS = f"""{VECTORS}, frames AS (SELECT structure_id, frame, ind, {", ".join(f"CAST(embedding[CAST(frame * 3 + {i + 1} AS INTEGER)] AS DOUBLE) * 60.0 AS p_{'xyz'[i]}" for i in range(3))}
  FROM (SELECT *, CAST(unnest(range(21)) AS INTEGER) AS frame FROM vectors))"""
ANGLES = """angles AS (SELECT user_id AS ind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
  atan2(sin(CAST(value AS DOUBLE)), cos(CAST(value AS DOUBLE))) AS angle FROM events)"""
CELLS = """cells AS (SELECT l_orderkey AS row, CAST(l_linenumber AS VARCHAR) AS structure_id, min(l_partkey) AS ind FROM lineitem GROUP BY ALL)"""
PAIRS = """pairs AS (SELECT p_partkey * 2 + k AS row, 'M' || (k + s) AS structure_id, p_partkey AS ind FROM part, (VALUES (0), (1)) a(k), (VALUES (1), (2)) b(s))"""
