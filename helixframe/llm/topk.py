"""Exact top-k by inner product with KD-trees.

Median splits of a bounded sample cut space into regions; a region's vectors, dealt by hash if they are many, are shards.
Each shard's KD-tree (median splits, tight boxes) is built once. Queries first search the shard that they lie in; the
k-th score found there goes with them to the shards of those regions whose box can still beat it, and within a tree only
boxes that can are opened, best first. Equal scores go to the smaller id, so a box also keeps its smallest id.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, share, shared

LEAF, SHARD_ROWS, BLOCK_QUERIES = 128, 1 << 14, 1 << 11
#: The most regions, and vectors (whose row numbers hash lowest) by which each one's split is chosen.
MAX_REGIONS, SAMPLE_PER_REGION = 1 << 10, 32


class KDTree:
    """lo, hi, least id, and children (or a range of rows) for each node; rows are reordered by leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.arange(len(x))
        nodes: list[list] = []
        todo = [(0, len(x), -1, 0)]
        self.children: list[list[int]] = []
        while todo:
            a, b, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                self.children[parent][side] = me
            part = x[order[a:b]]
            nodes.append([part.min(0), part.max(0), ids[order[a:b]].min(), a, b])
            self.children.append([-1, -1])
            if b - a > LEAF:
                axis = int(np.argmax(nodes[me][1] - nodes[me][0])) if x.shape[1] else 0
                mid = (b - a) // 2
                if x.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.lo, self.hi = np.array([n[0] for n in nodes], float), np.array([n[1] for n in nodes], float)
        self.least, self.rows = [int(n[2]) for n in nodes], [(n[3], n[4]) for n in nodes]
        self.x, self.ids = x[order], ids[order]

    def dump(self) -> bytes:
        return pickle.dumps(vars(self))

    @staticmethod
    def opened(raw: bytes) -> KDTree:
        tree = KDTree.__new__(KDTree)
        vars(tree).update(pickle.loads(raw))
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, bounds: list[tuple[float, int]], k: int):
        """For each query the k best (score, id) that beat its bound, a (score, id) that k rows reach elsewhere. Scores are
        exact integers: float64 where all products and sums are below EXACT, else 64-bit ones, else Python's."""
        top, scale = limits_of(queries, self.lo, self.hi)
        exact = self.x.astype(float) if scale[:, 0].min(initial=EXACT) < EXACT else self.x
        for q, bound, mine, limits, most in zip(queries, bounds, own, top, scale[:, 0].tolist(), strict=True):
            rows = exact if most < EXACT else self.x if most < 1 << 62 else self.x.astype(object)
            q = q.astype(rows.dtype)
            best: list[tuple[float, int]] = []  # a heap, worst first; ids negated, so that larger ids are worse
            worst = (bound[0], -bound[1])
            heap = [(-limits[0], 0)]
            while heap:
                limit, node = heapq.heappop(heap)
                if -limit < worst[0]:
                    break
                if (-limit, -self.least[node]) < worst:
                    continue
                left, right = self.children[node]
                if left >= 0:
                    heapq.heappush(heap, (-limits[left], left))
                    heapq.heappush(heap, (-limits[right], right))
                    continue
                a, b = self.rows[node]
                scores, ids = rows[a:b] @ q, self.ids[a:b]
                able = np.flatnonzero((scores >= worst[0]) & (ids != mine))
                if len(able) > k:
                    able = able[np.lexsort((ids[able], -scores[able]))[:k]]
                for j in able:
                    found = (int(scores[j]), -int(ids[j]))
                    if found < worst:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                    if len(best) == k:
                        worst = max(worst, best[0])
            yield [(s, -i) for s, i in best]


#: Integers below this are exact as float64, with room for a sum's rounding.
EXACT = 1 << 52


def limits_of(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most that a vector in each box can score with each query, and the most that any partial sum can be. Where that
    isn't below EXACT, the limit has what rounding may take added."""
    q = queries.astype(float)
    scale = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    top = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    return top + np.where(scale < EXACT, 0, scale * (q.shape[1] + 8) * 2.0**-51), scale


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.int64).reshape(len(values), -1)


#: Score and id of a query that has no bound yet: the id tells.
_NONE = (0, np.iinfo(np.int64).max)


def median_splits(x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the splits of a full binary tree with `many` (a power of two) leaves; the children of k are
    2k + 1 and 2k + 2. A region without a sampled vector sends all to its left."""
    axis, value = np.zeros(many - 1, np.int64), np.full(many - 1, np.inf)
    parts = {0: x}
    for k in range(many - 1):
        own = parts.pop(k)
        if len(own):
            axis[k] = int(np.argmax(own.max(0) - own.min(0)))
            value[k] = np.median(own[:, axis[k]])
        left = own[:, axis[k]] < value[k] if own.shape[1] else np.ones(len(own), bool)
        parts[2 * k + 1], parts[2 * k + 2] = own[left], own[~left]
    return axis, value


def region_of(x: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] >= value[at])
    return at - len(axis)


def top_by_inner_product(vectors: DataFrame, k: int = 5, query_every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of every row whose id is divisible by `query_every`.

    Vectors that are null or hold null or non-finite values take no part, nor do rows with a null id; vectors are only
    compared with others of their length; an id that occurs twice is never its own partner. Every row
    counts, as in the SQL: a repeated candidate takes a place for each of its rows, and the ranks of a repeated query id
    go over the pairs of all its rows. Components become floor(256 x), scores are exact; a component or a score found among
    the best that doesn't fit 64 bits is an error. Fewer rows than k give fewer results; an empty table gives none. Only vec_id and embedding are
    read."""
    spark, x = vectors.sparkSession, F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine)
    large = F.raise_error(F.lit("a component times 256 passes 64 bits")).cast("long")
    whole = lambda v: F.when(F.abs(v.cast("double") * 256) < 2.0**63, F.floor(v.cast("double") * 256)).otherwise(large)
    rows = cut(valid.select("vec_id", F.transform(x, whole).alias("x"), F.size(x).alias("dims"), F.monotonically_increasing_id().alias("row")))

    # Regions for each length of vectors.
    splits = {}
    for r in rows.groupBy("dims").count().collect():
        regions = 1
        while r.dims and regions < MAX_REGIONS and regions * SHARD_ROWS < r["count"]:
            regions *= 2
        sample = rows.where(F.col("dims") == r.dims).orderBy(F.xxhash64("row"), "row").limit(SAMPLE_PER_REGION * regions).select("x").collect() if regions > 1 else []
        splits[r.dims] = median_splits(np.array([s.x for s in sample], np.float64).reshape(len(sample), r.dims), regions)
    sent = share(spark, splits)

    @F.pandas_udf("int")
    def region(values: pd.Series) -> pd.Series:
        known, sizes = shared(sent), values.map(len)
        out = pd.Series(0, index=values.index, dtype="int32")
        for n, own in values.groupby(sizes):
            out[own.index] = region_of(_matrix(own), *known[n]).astype("int32")
        return out

    placed = cut(rows.withColumn("region", region("x")))
    sizes = placed.groupBy("dims", "region").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"))
    cell = ["dims", "region", "part"]
    placed = placed.join(F.broadcast(sizes), ["dims", "region"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    trees = cut(placed.groupBy(*cell).applyInPandas(_tree, "dims int, region int, part int, tree binary, lo array<double>, hi array<double>"))
    queries = cut(placed.where(F.col("vec_id") % query_every == 0))

    start = queries.withColumns({"score": F.lit(_NONE[0]), "last": F.lit(_NONE[1])})
    home = cut(_searched(trees, start, cell, k))
    kth = home.groupBy("query_row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    kth = kth.where(F.size("best") >= k).select("query_row", (-F.element_at("best", k)["s"]).alias("score"), F.element_at("best", k)["vec_id"].alias("last"))
    known = queries.join(kth, F.col("row") == F.col("query_row"), "left").drop("query_row")
    known = known.withColumns({"score": F.coalesce("score", F.lit(_NONE[0])), "last": F.coalesce("last", F.lit(_NONE[1]))})

    # A region's box, of at most MAX_REGIONS for each length, and how many shards it has.
    boxes: dict[int, list] = {}
    for r in _boxes(trees):
        boxes.setdefault(r.dims, []).append((r.region, r.parts, np.array(r.lo), np.array(r.hi)))
    box = share(spark, boxes)

    @F.pandas_udf("array<bigint>")
    def reach(values: pd.Series, score: pd.Series, last: pd.Series, own: pd.Series, part: pd.Series) -> pd.Series:
        known_, sizes_ = shared(box), values.map(len)
        out: dict = {}
        for n, these in values.groupby(sizes_):
            q, found = _matrix(these), known_[n]
            top, _ = limits_of(q, np.array([b[2] for b in found], float), np.array([b[3] for b in found], float))
            least = score[these.index].to_numpy().astype(float)
            least = np.where(last[these.index] == _NONE[1], -np.inf, np.nextafter(least, -np.inf, where=np.abs(least) >= EXACT, out=least))
            able = top >= least[:, None]
            for i, row in zip(these.index, able, strict=True):
                out[i] = [found[j][0] << 32 | p for j in np.flatnonzero(row) for p in range(found[j][1]) if (found[j][0], p) != (own[i], part[i])]
        return pd.Series([out[i] for i in values.index], index=values.index, dtype=object)

    away = known.withColumn("to", F.explode(reach("x", "score", "last", "region", "part"))).withColumns({"region": F.shiftright("to", 32).cast("int"), "part": F.col("to").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")}).drop("to")
    found = home.unionByName(_searched(trees, cut(away), cell, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(trees: DataFrame) -> list:
    """Boxes of regions, as the least and greatest corner over their shards."""
    flat = trees.select("dims", "region", "part", F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "z"))
    flat = flat.groupBy("dims", "region", "k").agg(F.max("part").alias("part"), F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"))
    whole = flat.groupBy("dims", "region").agg((F.max("part") + 1).alias("parts"), F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("b"))
    empty = trees.where("dims = 0").groupBy("dims", "region").agg((F.max("part") + 1).alias("parts"), F.array().cast("array<struct<k:int,lo:double,hi:double>>").alias("b"))
    return whole.unionByName(empty).select("dims", "region", "parts", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")).collect()


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "row"])
    tree = KDTree(_matrix(rows["x"]), rows["vec_id"].to_numpy())
    return pd.DataFrame({"dims": rows["dims"][:1], "region": rows["region"][:1], "part": rows["part"][:1], "tree": [tree.dump()], "lo": [tree.lo[0].tolist()], "hi": [tree.hi[0].tolist()]})


def _searched(trees: DataFrame, queries: DataFrame, cell: list[str], k: int) -> DataFrame:
    """What queries (row, vec_id, x, score, last, and their shard) find in their shards. A shard with many queries searches
    them in blocks, each with a copy of its tree."""
    blocks = queries.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    copies = trees.select(*cell, "tree").join(blocks, cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = queries.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    key = [*cell, "block"]
    return dealt.select(*key, "row", "vec_id", "x", "score", "last").groupBy(*key).cogroup(copies.select(*key, "tree").groupBy(*key)).applyInPandas(lambda q, t: _search(q, t, k), _FOUND)


def _search(queries: pd.DataFrame, trees: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple[int, int, int, int]] = []
    if len(queries):
        tree = KDTree.opened(trees["tree"].iloc[0])
        for a in range(0, len(queries), 256):
            part = queries.iloc[a : a + 256]
            bounds = [(-np.inf if i == _NONE[1] else s, i) for s, i in zip(part["score"].tolist(), part["last"].tolist(), strict=True)]
            found = tree.search(_matrix(part["x"]), part["vec_id"].to_numpy(), bounds, k)
            out += [(r, q, i, s) for r, q, best in zip(part["row"], part["vec_id"], found, strict=True) for s, i in best]
    if any(not -(1 << 63) <= s < 1 << 63 for *_, s in out):
        raise OverflowError("a score passes 64 bits")
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")


def op6_topk(spark, sf_dir):
    return top_by_inner_product(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
