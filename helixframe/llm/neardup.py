"""Near-duplicate groups by min-max hashing.

Every hash function gives two values of a signature, the least and the greatest over a document's shingles, so a
signature of 128 values takes 64 evaluations a shingle. Documents with equal shingle sets are one node. Nodes that share
a band of the signature are candidates. First a bucket's nodes are compared with one pivot, which joins most copies; nodes
of one component needn't be compared again. What then still lies in different components of one bucket is compared in
blocks, two blocks a task, and only links come out. So no pairs are listed, yet every pair of a bucket is either
compared or already connected. Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import SPACES, TO_LOWER, cut, if_small, mix64, utf8_parts, word_hashes, word_spans

FUNCTIONS = 64
#: The most a pair just at the threshold may be missed.
MISS = 1e-4
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
#: A bucket with more members is joined by broadcast, if there are no more than so many of these.
HOT, MAX_HOT = 1_000, 200_000
#: Links of which one task finds the components.
LINKS = 1 << 15


def bands_for(similarity: float) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands that miss a pair at this similarity at most once in 1 / MISS."""
    for rows in range(12, 1, -1):
        bands = 2 * FUNCTIONS // rows
        if (1 - similarity**rows) ** bands <= MISS:
            return bands, rows
    return 2 * FUNCTIONS, 1


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted. With fewer words, the whole sequence is one shingle."""
    odd = mix64(np.arange(1, size + 2, dtype=np.uint64)) | np.uint64(1)
    for a, b, data, offsets in utf8_parts(texts):
        data = TO_LOWER[data]
        starts, ends, first = word_spans(data, offsets, SPACES)
        words = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        n = max(len(words) - size + 1, 0)
        runs = np.full(n, odd[-1])
        for k in range(size):
            runs += words[k : k + n] * odd[k]
        runs = mix64(runs)
        for d in range(b - a):
            i, j = first[d], first[d + 1]
            if j - i >= size:
                yield np.unique(runs[i : j - size + 1])
            elif j > i:
                yield mix64(np.array([(words[i:j] * odd[: j - i]).sum(dtype=np.uint64) + np.uint64(int(j - i))]))
            else:
                yield np.zeros(0, np.uint64)


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of each of FUNCTIONS hash functions, next to each other."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)
    lo, hi = np.full(FUNCTIONS, np.uint64(2**64 - 1)), np.zeros(FUNCTIONS, np.uint64)
    for k in range(0, len(shingles), 2048):
        values = shingles[k : k + 2048, None] * a + b
        lo, hi = np.minimum(lo, values.min(0)), np.maximum(hi, values.max(0))
    return np.stack([lo, hi], 1).ravel()


def signatures(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, th, n, node, bands): a hash of the text, the set's size and fingerprint, and a key for each band."""
    bands, rows = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix64(np.arange(bands * rows, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
        for batch in batches:
            n, node, keys = [], [], []
            for s in shingle_sets(batch.column(2), size):
                n.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    parts = (mix64(min_max_signature(s)[: bands * rows]) * weights).reshape(bands, rows).sum(1, dtype=np.uint64)
                    keys.append(mix64(parts + np.arange(bands, dtype=np.uint64)).view(np.int64))
                else:
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "n", "node", "bands"])

    rows_ = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows_.mapInArrow(run, "doc_id long, th long, n long, node binary, bands array<long>")


def whole_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) for nodes that are given with the id and text hash of one of their documents."""
    named = nodes.select("node", F.col("doc_id").alias("d"), F.col("th").alias("h"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.mapInArrow(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets overlap in `percent` of their union or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def joined(kind: str):
    """For mapInArrow over links (a, b): (node, label), the least node that each reaches by the links of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, types = {}, None

        def find(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for batch in batches:
            types = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(a, a), root.setdefault(b, b)
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), types), pa.array([find(k) for k in root], types)], ["node", "label"])

    return run, f"node {kind}, label {kind}"


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each can reach. Tasks first join what LINKS links connect, so a small graph needs
    no rounds and a large one few; then labels go to neighbours, and on to their own labels. A round's columns are
    aggregates: what the optimizer concludes from others is kept with the rows and would double with each round."""
    tasks = max(1, -(-links.count() // LINKS))
    near = cut(links.select("a", "b").coalesce(tasks).mapInArrow(*joined(dict(links.dtypes)["a"])))
    if tasks == 1:
        return near
    edges = near.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(near.groupBy("node").agg(F.min("label").alias("label")))
    none = F.lit(None).cast(dict(links.dtypes)["a"]).alias("old")
    least = lambda rows: rows.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
    while True:
        sent = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", none)
        new = least(labels.select("node", "label", F.col("label").alias("old")).unionByName(sent))
        ahead = new.select(F.col("node").alias("label"), F.col("label").alias("ahead")).join(new.select("node", "label"), "label")
        new = cut(least(new.unionByName(ahead.select("node", F.col("ahead").alias("label"), none))))
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def by_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows joined with their buckets. Buckets of over HOT members are few, so they go to the rows; the members of one
    never meet in one task."""
    hot = if_small(cut(buckets.where(F.col("m") > HOT)), MAX_HOT)
    cold = buckets.where(F.col("m") <= HOT)
    return rows.join(hot, "bucket").unionByName(rows.join(cold, "bucket"))


def linked_nodes(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) of every node that is linked to another."""
    nodes = cut(signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = nodes.select("node", "n", "one", F.explode("bands").alias("bucket"))
    full = cut(spread.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count("*").alias("m")).where("m > 1"))
    members = cut(by_bucket(spread, full.select("bucket", "pivot", "m")).drop("m"))
    sets = cut(whole_sets(docs, members.select("node", "one.doc_id", "one.th").distinct(), size))
    members = members.select("bucket", "node", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.col("node") != F.col("pivot"))
    pairs = members.select("node", "n", "pivot", "pivot_n").where(near("n", "pivot_n")).distinct()
    links = cut(confirmed(pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets, percent))
    labels = components(links)
    # What is left: members of a bucket that are not in its largest component, against those of other components.
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    groups = named.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    rest = groups.groupBy("bucket").agg(F.sum("m").alias("all"), F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rest = rest.withColumn("m", F.col("all"))
    more = cut(links_in_blocks(by_bucket(named, rest).drop("m"), sets, percent))
    return components(links.unionByName(more))


def links_in_blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within buckets between members of different components, from (bucket, node, label, all, main, most).
    Members are dealt over blocks of about BLOCK, those of the largest component apart; a task compares two blocks."""
    few = F.col("label") != F.col("main")
    n_few, n_main = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    block = F.when(few, F.pmod(F.hash("node"), n_few)).otherwise(n_few + F.pmod(F.hash("node"), n_main))
    partners = F.sequence(F.lit(0), F.when(few, n_few + n_main - 1).otherwise(n_few - 1))
    rows = left.select("bucket", "node", "label", block.alias("block"), F.explode(partners).alias("p"))
    rows = rows.select("bucket", F.least("block", "p").alias("i"), F.greatest("block", "p").alias("j"), "block", "node", "label").join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, label, block = (np.array(table[c].to_pylist(), object) for c in ("node", "label", "block"))
        shingles = table["shingles"].combine_chunks()
        lengths = np.diff(shingles.offsets.to_numpy())
        _, column, times = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(node)), lengths), times > 1
        keep = shared[column]
        row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
        left, right = np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())
        overlap = np.zeros((len(left), len(right)))
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        for at in range(0, int(shared.sum()), 1 << 13):
            a, b = np.searchsorted(column, (at, at + (1 << 13)))
            dense = np.zeros((len(node), 1 << 13), np.float32)
            dense[row[a:b], column[a:b] - at] = 1
            overlap += dense[left] @ dense[right].T
        x, y = np.nonzero((label[left][:, None] != label[right][None, :]) & (100 * overlap >= percent * (lengths[left][:, None] + lengths[right][None, :] - overlap)))
        # One link between two components joins them.
        number = np.unique(label, return_inverse=True)[1] if len(label) else np.zeros(0, int)
        one = np.unique(number[left[x]] * len(label) + number[right[y]], return_index=True)[1]
        x, y = x[one], y[one]
        return pa.table({"a": pa.array(node[left[x]].tolist(), pa.binary()), "b": pa.array(node[right[y]].tolist(), pa.binary())})

    found = rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest id of the group), kept and group (a key of the group, null
    without shingles) of every document.

    Words are runs of anything but white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle.
    Texts without words, and null ones, have no shingles and are their own group. Rows with equal sets always link, so
    repeated rows fall into one group. A null id is never a group's smallest; a group of null ids only has a null
    component_id, and keeps its rows. An empty table gives an empty result. Only doc_id and text are read."""
    signed = cut(signatures(docs, size, percent / 100))
    labels = linked_nodes(docs, signed, size, percent)
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    group = nodes.groupBy("label").agg(F.min("least").alias("component"))
    nodes = nodes.join(group, "label").select("node", "component", F.col("label").alias("group"))
    rows = signed.select("doc_id", "th", "n", "node").join(nodes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(id, hash) of one document of each near-duplicate group: that with the smallest id, null last, then text hash. A
    document without shingles is its own group."""
    found = near_duplicates(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    kept = found.where("group IS NOT NULL").groupBy("group").agg(first).select(F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("hash"))
    return kept.unionByName(found.where("group IS NULL").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct())


def op9_neardup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM (SELECT e.* FROM e SEMI JOIN f USING (x)) a JOIN (SELECT e.* FROM e SEMI JOIN f USING (x)) b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.node
"""
