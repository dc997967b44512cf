"""An exact Jaccard join of word n-gram sets by signature trees.

Sets in p% of their union differ in at most (100 - p) / (100 + p) of their sizes' sum, D elements say. Dealt by hash over
more than D parts, two such sets are equal in some part, so sets that share the hash of a part meet in a bucket, and
buckets lose no link. Parts are as many as a class of sizes needs, about nine elements each; sets near a class's upper end
also go to the next one. A part without elements is no bucket: there are some parts to spare, and sets with more empty
parts than that are dealt anew with another hash, a last time with empty parts as buckets.

In a bucket sets are leaves of a signature tree: its nodes hold the OR of their sets' token bitmaps and their range of
sizes. Two trees are traversed together; a pair of nodes is left out if even the largest overlap that sizes and bitmaps
allow is too small, or if all below is known to be connected. What is left is compared on whole sets. Large buckets go
in blocks, two blocks a task. Equal sets are one; only links between sets that weren't connected come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, if_small, mix64
from helixframe.llm.neardup import OP9_SQL, components, confirmed, shingle_sets, whole_sets

#: Ratio of the sizes of a class, the most parts to spare for empty ones, and times that sets are dealt.
RATIO, SPARE, DEALS = 1.5, 2, 4
#: Sets of a lowest node, children of others, sets of a block, and their elements.
LEAF, FANOUT, BLOCK, BLOCK_ELEMENTS = 8, 4, 256, 1 << 20
#: Buckets that a set is first compared in; the rest are for what these haven't connected.
FIRST_BUCKETS = 2
#: Keys of buckets are looked for among one of so many sets; one with so many sets there is hot.
SAMPLED, HOT = 64, 64
MAX_HOT = 200_000
#: Candidate pairs for each set of a group that are listed.
MAX_PAIRS = 8


def size_classes(most: int, percent: int) -> list[tuple[int, int]]:
    """(first, last) size of each class up to `most`; a set's partners are in its own or the next class."""
    out, first = [], 1
    while first <= most:
        last = max(int(first * RATIO), 100 * first // percent)
        out.append((first, last))
        first = last + 1
    return out


def differing(a: int, b: int, percent: int) -> int:
    """The most elements in one of two linked sets of these sizes but not in both."""
    return (100 - percent) * (a + b) // (100 + percent)


def bucket_keys(shingles: np.ndarray, percent: int, classes: list[tuple[int, int]]) -> np.ndarray:
    """Keys of the buckets of a set, given as sorted distinct 64-bit hashes."""
    n, out = len(shingles), []
    firsts = [c[0] for c in classes]
    own = int(np.searchsorted(firsts, n, "right")) - 1
    for k in {own, own + 1} if 100 * n // percent > classes[own][1] else {own}:
        most = differing(classes[k][1], classes[k][1], percent)
        if not most:
            continue  # only equal sets link
        spare = min(SPARE, most // 8)
        parts = most + 1 + spare
        for deal in range(DEALS):
            salt = mix64(np.array([k * DEALS + deal + 1], np.uint64))
            spread = mix64(shingles ^ salt)
            part = (spread % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, mix64(spread))
            counts = np.bincount(part, minlength=parts)
            keys = mix64(sums + mix64(np.arange(parts, dtype=np.uint64) * np.uint64(DEALS * 64) + salt))
            full = counts > 0
            enough = parts - int(full.sum()) <= spare
            out.append(keys if deal == DEALS - 1 and not enough else keys[full])
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def keyed_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, th, n, node, keys): hash of the text, size of the set, its fingerprint and its buckets' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(1 << 40, percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, node, keys = [], [], []
                for s in shingle_sets(part.column(2), size):
                    n.append(len(s))
                    node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(bucket_keys(s, percent, classes).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "n", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, n long, node binary, keys array<long>")


class Signatures:
    """A signature tree over some of the sets of a flat array with offsets: `order` has their numbers by size, then bitmap;
    levels, from single sets up to the root, hold the OR of the bitmaps, least and greatest size, the most elements of a
    set beyond one a bit, and the label where all below have the same (else -1)."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.order = rows[np.lexsort((*maps[rows, :4].T, sizes[rows]))]
        maps, sizes, labels = maps[self.order], sizes[self.order], labels[self.order]
        low = maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(1, dtype=np.int64), labels
        self.levels, step = [low], LEAF
        while len(low[0]) > 1:
            begin = np.arange(0, len(low[0]), step)
            least, most = np.minimum.reduceat(low[4], begin), np.maximum.reduceat(low[4], begin)
            low = np.bitwise_or.reduceat(low[0], begin), np.minimum.reduceat(low[1], begin), np.maximum.reduceat(low[2], begin), np.maximum.reduceat(low[3], begin), np.where(least == most, least, -1)
            self.levels.append(low)
            step = FANOUT


def able_pairs(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int, single: bool) -> np.ndarray:
    """Which of the node pairs (i of a, j of b) may hold a link: not all of one label, sizes within the ratio, and the most
    elements that sets below can share enough. Shared elements lie on bits that both maps have, one each but for the
    elements beyond one a bit; of a single set, each bit that the other lacks is an element that isn't shared."""
    (map_a, least_a, most_a, beyond_a, label_a), (map_b, least_b, most_b, beyond_b, label_b) = (tuple(x[k] for x in level) for level, k in ((a, i), (b, j)))
    fits = (100 * most_a >= percent * least_b) & (100 * most_b >= percent * least_a) & ((label_a != label_b) | (label_a < 0))
    share = np.minimum(np.minimum(most_a, most_b), np.bitwise_count(map_a & map_b).sum(1, dtype=np.int64) + np.minimum(beyond_a, beyond_b))
    if single:
        share = np.minimum(share, np.minimum(most_a - np.bitwise_count(map_a & ~map_b).sum(1, dtype=np.int64), most_b - np.bitwise_count(map_b & ~map_a).sum(1, dtype=np.int64)))
    return fits & ((100 + percent) * share >= percent * (least_a + least_b))


def candidate_pairs(a: Signatures, b: Signatures, percent: int) -> np.ndarray:
    """Pairs of sets (k, 2) that a traversal of both trees leaves; of one tree with itself, each pair once."""
    a_levels, b_levels = a.levels, b.levels
    x, y = len(a_levels) - 1, len(b_levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        on = able_pairs(a_levels[x], b_levels[y], i, j, percent, x == y == 0)
        i, j = i[on], j[on]
        if x == y == 0 or not len(i):
            break
        # The higher tree's nodes are opened, or both if they are level.
        down_a, down_b = x >= y, y >= x
        x, y = x - down_a, y - down_b
        for side, level in ((0, x), (1, y)):
            if (down_a, down_b)[side]:
                step, n = (LEAF if level == 0 else FANOUT), len((a_levels, b_levels)[side][level][0])
                child = (i, j)[side][:, None] * step + np.arange(step)
                rows, cols = np.nonzero(child < n)
                i, j = (child[rows, cols], j[rows]) if side == 0 else (i[rows], child[rows, cols])
        if a is b:
            keep = i <= j
            i, j = i[keep], j[keep]
    if a is b:
        i, j = i[i < j], j[i < j]
    return np.stack([a.order[i], b.order[j]], 1)


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """Four bits or more for each element. A bitmap of half the bits is the OR of both halves."""
    bits = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    cell = mix64(shingles) & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return out


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of the shortest one's width."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width)) for m in maps])


def tree_pairs(maps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int) -> np.ndarray:
    a = Signatures(maps, sizes, labels, left)
    return candidate_pairs(a, a if right is None else Signatures(maps, sizes, labels, right), percent)


def links_of(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets with different labels, `left` against `right` (or itself), enough to connect all that links
    connect. Labels are numbers from 0."""
    pairs = tree_pairs(folded([bitmap_of(s) for s in sets]), np.array([len(s) for s in sets]), labels, left, right, percent)
    root = list(range(int(labels.max(initial=-1)) + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for x, y in pairs.tolist():
        p, q = find(int(labels[x])), find(int(labels[y]))
        if p == q:
            continue
        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if (100 + percent) * shared >= percent * (len(sets[x]) + len(sets[y])):
            root[p] = q
            out.append((x, y))
    return out


def _group(table: pa.Table) -> tuple:
    """(nid, labels from 0, left, right or None) of a group."""
    nid, label, block = (table[c].to_numpy() for c in ("nid", "label", "block"))
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    return nid, np.unique(label, return_inverse=True)[1], np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within groups (key, i, j) of (nid, label, block, shingles): block i against block j."""

    def compare(table: pa.Table) -> pa.Table:
        nid, labels, left, right = _group(table)
        sets = [s.values.to_numpy().view(np.uint64) for s in table["shingles"]]
        found = links_of(sets, labels, left, right, percent) if len(left) and (right is None or len(right)) else []
        x, y = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table({"a": nid[x], "b": nid[y]})

    found = rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the trees of each group (key, i, j) of (nid, n, label, block, map) leave. A group with more than
    MAX_PAIRS for each of its sets gives none, but key, i and j."""

    def compare(table: pa.Table) -> pa.Table:
        nid, labels, left, right = _group(table)
        maps = folded([np.frombuffer(m, np.uint64) for m in table["map"].to_pylist()])
        pairs = tree_pairs(maps, table["n"].to_numpy(), labels, left, right, percent) if len(left) and (right is None or len(right)) else np.zeros((0, 2), np.int64)
        pairs = pairs[labels[pairs[:, 0]] != labels[pairs[:, 1]]]
        if len(pairs) > MAX_PAIRS * len(nid):
            return pa.Table.from_pylist([{c: table[c][0].as_py() for c in ("key", "i", "j")}], _FOUND)
        a, b = nid[pairs].T
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.nulls(len(pairs), f.type) for f in list(_FOUND)[2:]]], schema=_FOUND)

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, key long, i int, j int")


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])


def bitmaps(sets: DataFrame) -> DataFrame:
    """(nid, n, map) of sets (nid, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.values.to_numpy().view(np.uint64) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([bitmap_of(s).tobytes() for s in found], pa.binary())], ["nid", "n", "map"])

    return sets.select("nid", "shingles").mapInArrow(run, "nid long, n long, map binary")


def _blocks(members: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(elements / BLOCK_ELEMENTS)).cast("int")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, nid, n) of sets in buckets of two or more, without buckets that hold the same sets as another. Hot buckets,
    found in a sample, are counted map-side, so that no task holds them; all others meet in one task."""
    spread = nodes.select(F.explode("keys").alias("key"), "nid")
    seen = spread.where(F.pmod(F.xxhash64("nid", F.lit(5)), F.lit(SAMPLED)) == 0).groupBy("key").count()
    hot = if_small(cut(seen.where(F.col("count") >= HOT).select("key", F.lit(True).alias("hot"))), MAX_HOT)
    spread = spread.join(hot, "key", "left")
    cold = spread.where("hot IS NULL").select("key", "nid", F.count("*").over(Window.partitionBy("key")).alias("m")).where("m > 1")
    warm = spread.where("hot").select("key", "nid")
    counts = if_small(cut(warm.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")), MAX_HOT)
    members = cut(cold.unionByName(warm.join(counts, "key")))
    mark = lambda k: F.bit_xor(F.xxhash64("nid", F.lit(k)))
    buckets = members.groupBy("key").agg(F.first("m").alias("m"), F.min("nid").alias("least"), mark(0).alias("x"), mark(1).alias("y"))
    one = cut(buckets.groupBy("m", "least", "x", "y").agg(F.min("key").alias("key")))
    return members.join(if_small(one.select("key"), MAX_HOT), "key", "left_semi").join(nodes.select("nid", "n"), "nid").select("key", "nid", "n", "m")


def linked_sets(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) of every nid that links to another."""
    members = cut(bucket_members(nodes))
    named = nodes.join(members.select("nid").distinct(), "nid").select("nid", "node", "one.doc_id", "one.th")
    sets = cut(whole_sets(docs, named, size).join(named.select("node", "nid"), "node").select("nid", "shingles"))
    # First each set's largest buckets, block by block, with the least set of a bucket in each of its blocks.
    order = Window.partitionBy("nid").orderBy(F.desc("m"), "key")
    first = cut(members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FIRST_BUCKETS).select("key", "nid", "n"))
    full = first.groupBy("key").agg(F.min("nid").alias("pivot"), F.count("*").alias("m"), _blocks(F.count("*"), F.sum("n")).alias("blocks")).where("m > 1")
    full = if_small(cut(full), MAX_HOT)
    dealt = first.join(full, "key").where("nid <> pivot").select("key", "nid", F.pmod(F.hash("nid"), "blocks").alias("i"))
    pivots = full.select("key", F.col("pivot").alias("nid"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    rows = dealt.unionByName(pivots).select("key", "i", F.col("i").alias("j"), F.col("i").alias("block"), "nid", F.col("nid").alias("label"))
    links = cut(_links(rows.join(sets, "nid"), percent))
    labels = components(links)
    # Then what is left: a bucket's sets that aren't in its largest component, against those of other components. Bitmaps
    # alone leave few pairs; groups where they leave many are compared on whole sets at once.
    known = members.join(labels.select(F.col("node").alias("nid"), "label"), "nid", "left").select("key", "nid", "n", F.coalesce("label", "nid").alias("label"))
    groups = known.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("e"))
    main = F.max_by(F.struct("label", "m", "e"), F.struct("m", "label")).alias("main")
    rest = groups.groupBy("key").agg(F.sum("m").alias("all"), F.sum("e").alias("elements"), main, F.count("*").alias("parts")).where("parts > 1")
    rest = if_small(cut(rest.select("key", F.col("main.label").alias("main"), _blocks(F.col("all") - F.col("main.m"), F.col("elements") - F.col("main.e")).alias("few"), _blocks(F.col("main.m"), F.col("main.e")).alias("many"))), MAX_HOT)
    other = F.col("label") != F.col("main")
    block = F.when(other, F.pmod(F.hash("nid"), "few")).otherwise(F.col("few") + F.pmod(F.hash("nid"), "many"))
    partners = F.sequence(F.lit(0), F.when(other, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))
    rows = known.join(rest, "key").select("key", "nid", "label", block.alias("block"), F.explode(partners).alias("p"))
    rows = cut(rows.select("key", F.least("block", "p").alias("i"), F.greatest("block", "p").alias("j"), "block", "nid", "label"))
    found = cut(_candidates(rows.join(bitmaps(sets), "nid"), percent))
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    more = confirmed(pairs, sets.withColumnRenamed("nid", "node"), percent)
    dense = if_small(cut(found.where("a IS NULL").select("key", "i", "j")), MAX_HOT)
    most = _links(rows.join(dense, ["key", "i", "j"], "left_semi").join(sets, "nid"), percent)
    return components(links.unionByName(cut(more.unionByName(most))))


def join_similar_sets(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the number of distinct word shingles of every document, and the smallest id that
    it reaches by links, itself included. Documents link whose shingles in common are `percent` of those in either.

    Words are runs of anything but white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle; texts
    without words, and null ones, have none and link with nothing. Equal sets always link, so repeated rows do. A null id
    is never the smallest; a component of null ids only has a null component_id. An empty table gives an empty result.
    Shingles are told apart by 64-bit hashes, sets by 128 bits. A set has about (100 - percent) / 50 buckets for each
    of its shingles, so low percentages cost much. Only doc_id and text are read."""
    signed = cut(keyed_sets(docs, size, percent))
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(nodes).withColumn("nid", F.monotonically_increasing_id())
    labels = linked_sets(docs, nodes, size, percent)
    named = nodes.select("nid", "node", "least").join(labels.select(F.col("node").alias("nid"), "label"), "nid", "left").select("node", "least", F.coalesce("label", "nid").alias("label"))
    component = named.groupBy("label").agg(F.min("least").alias("component"))
    found = named.join(component, "label").select("node", "component")
    rows = signed.select("doc_id", "n", "node").join(found, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op13_setjoin(spark, sf_dir):
    return join_similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)


OP13_SQL = OP9_SQL.replace("100 * k >= 85 * (na + nb - k)", "100 * k >= 90 * (na + nb - k)").replace(", coalesce(component_id, s.doc_id) = s.doc_id AS kept", "")
