"""A trie of conversations that share their first turns, as one row for each node.

A turn is a hash of its role and text. Conversations are dealt by ranges of their sequences of turns, so those that share
a prefix lie side by side. A shard is a padded matrix of turns, sorted by numpy's lexsort; a mask of where a column differs
from the row above, OR-accumulated from left to right, marks where nodes start at every depth, and reduceat adds up their
members. Long conversations are taken a few columns at a time, with only the rows that reach so far.

A node can only lie in several shards if it is a prefix of a shard's first or last row. Those boundary nodes come out as
parts that Spark adds up by their key; all others are whole. What lies below a boundary node is a running sum along its
shard's path of boundary nodes, each of which counts in one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import count_space_words, crc_mod, cut

#: Turns of a shard, and columns of its matrix that are looked at together.
SHARD_TURNS, COLUMNS = 1 << 20, 8
#: The longest run of ends' ids in one row.
TEXT_BYTES = 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, id, words). Null turns come first, equal ones by
    their hash; a null role or text is empty; rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").alias("turn"), key.alias("id"), count_space_words(text).alias("words"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns"))


def rebuilt(turns: DataFrame, base: Column, taken: Column) -> DataFrame:
    """(conv_id, ids, words): the first `taken` turns of conversation `base`, which may be absent, then the conversation's
    own turns after its first `taken`. A base goes once to each of those that want it, cut to what they want."""
    own = turns.select("conv_id", "turns", base.alias("base"), taken.cast("int").alias("taken"))
    most = own.groupBy("base").agg(F.max("taken").alias("most"))
    heads = turns.select(F.col("conv_id").alias("base"), F.col("turns").alias("head")).join(most, "base")
    heads = heads.select("base", F.slice("head", F.lit(1), F.col("most")).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.slice("turns", 1, 0))
    tail = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns"), F.lit(1)))
    whole = own.join(heads, "base", "left").select("conv_id", F.concat(head, tail).alias("t"))
    return whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


class Level:
    """The nodes of one depth of a shard, in order: least conversation, members, parent (its place in the level above),
    words of the last turn, ids of the first and last node's last turn, and who ends at which node."""

    def __init__(self, conv, n, parent, words, edges, end_node, end_conv):
        self.conv, self.n, self.parent, self.words, self.edges, self.end_node, self.end_conv = conv, n, parent, words, edges, end_node, end_conv
        self.children = np.zeros(len(conv), np.int64)
        self.leaves, self.saved = self.children.copy(), self.children.copy()


def levels_of(conv: np.ndarray, lengths: np.ndarray, ids: np.ndarray, words: np.ndarray) -> list[Level]:
    """Levels from the root on, of at least one conversation: `lengths` turns each, all conversations' turns one after the
    other in ids (n, 2) and words."""
    starts = np.cumsum(lengths) - lengths
    zero = np.zeros(1, np.int64)
    at_once = np.sort(conv[lengths == 0])
    levels = [Level(conv[[conv.argmin()]], np.array([len(conv)]), zero, zero, ids[:0], np.zeros(len(at_once), np.int64), at_once)]
    alive = np.flatnonzero(lengths > 0)
    group, parent, depth = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), 0
    while len(alive):
        n = lengths[alive]
        width = min(COLUMNS, int(n.max()) - depth)
        at = starts[alive][:, None] + depth + np.arange(width)
        inside = depth + np.arange(width) < n[:, None]
        matrix = np.zeros((len(alive), width, 2), np.uint64)
        matrix[inside] = ids[at[inside]]
        on = n > depth + width
        # By group, then turns, then those that end here before those that go on, then conversation.
        order = np.lexsort((conv[alive], on, *[matrix[:, c, h] for c in range(width - 1, -1, -1) for h in (1, 0)], group))
        alive, matrix, inside, group, parent, n, on = alive[order], matrix[order], inside[order], group[order], parent[order], n[order], on[order]
        changes = np.ones((len(alive), width), bool)
        changes[1:] = (matrix[1:] != matrix[:-1]).any(2) | (inside[1:] != inside[:-1])
        changes[1:, 0] |= group[1:] != group[:-1]
        changes = np.logical_or.accumulate(changes, 1)
        for c in range(width):
            rows = np.flatnonzero(inside[:, c])
            own, begin = alive[rows], np.flatnonzero(changes[rows, c])
            members = np.diff(np.append(begin, len(rows)))
            number = np.repeat(np.arange(len(begin)), members)
            last = starts[own[begin]] + depth + c
            ends = n[rows] == depth + c + 1
            levels.append(Level(np.minimum.reduceat(conv[own], begin), members, parent[rows[begin]], words[last], ids[last[[0, -1]]], number[ends], conv[own[ends]]))
            parent[rows] = number
        depth += width
        group = np.cumsum(changes[:, -1])[on]
        alive, parent = alive[on], parent[on]
    return levels


def edge_paths(levels: list[Level]) -> tuple[list[int], list[int]]:
    """Places of the nodes along the shard's first and last row, from the root on."""
    first, last = [0], [0]
    while len(first) < len(levels) and not (levels[len(first) - 1].end_node == 0).any():
        first.append(0)
    while len(last) < len(levels) and levels[len(last)].parent[-1] == last[-1]:
        last.append(len(levels[len(last)].conv) - 1)
    return first, last


def add_up(levels: list[Level], paths: tuple[list[int], list[int]]) -> None:
    """Children, leaves and saved tokens below each node, from the deepest level up; nodes on the paths neither count as
    children nor add leaves or tokens of their own, as they may have more members elsewhere."""
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        whole = np.ones(len(level.conv), bool)
        for path in paths:
            if d < len(path):
                whole[path[d]] = False
        level.leaves += whole & (level.children == 0)
        level.saved += whole * (level.n - 1) * level.words
        if d:
            above = levels[d - 1]
            for total, own in ((above.children, whole), (above.leaves, level.leaves), (above.saved, level.saved)):
                np.add.at(total, level.parent, own)


def _pieces(ids: list[int]) -> Iterator[str]:
    step = max(1, TEXT_BYTES // 21)
    for at in range(0, len(ids), step):
        yield ",".join(map(str, ids[at : at + step]))


_EMPTY = hashlib.sha256().hexdigest()
_SHARD = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
    ("saved", pa.int64()), ("words", pa.int64()), ("key", pa.binary()), ("above", pa.binary()), ("ends", pa.string()),
])  # fmt: skip
_SHARD_SQL = "kind int, shard int, side int, depth long, conv_id long, parent long, n long, children long, leaves long, saved long, words long, key binary, above binary, ends string"
#: Kinds of rows: whole nodes with a whole parent, those whose parent is on the path `side`, parts of boundary nodes, and
#: pieces of the ids that end at these.
WHOLE, BELOW, PART, PIECE = range(4)


def shard_rows(shard: int, levels: list[Level]) -> Iterator[pa.RecordBatch]:
    paths = edge_paths(levels)
    add_up(levels, paths)
    keys: list[list[bytes]] = [[b""], [b""]]
    sides = (0,) if paths[0] == paths[1] else (0, 1)
    for side in sides:
        for d in range(1, len(paths[side])):
            keys[side].append(hashlib.blake2b(keys[side][-1] + levels[d].edges[side].tobytes(), digest_size=16).digest())
    for d, level in enumerate(levels):
        m = len(level.conv)
        begin, end = np.searchsorted(level.end_node, np.arange(m)), np.searchsorted(level.end_node, np.arange(m), "right")
        on = {path[d]: side for side, path in reversed(list(enumerate(paths))) if d < len(path)}
        whole = np.ones(m, bool)
        whole[list(on)] = False
        ends = [_EMPTY] * m
        for i in np.flatnonzero((end > begin) & whole).tolist():
            ends[i] = hashlib.sha256(",".join(map(str, level.end_conv[begin[i] : end[i]].tolist())).encode()).hexdigest()
        if whole.any():
            kind, side, parent = np.full(m, WHOLE, np.int32), np.zeros(m, np.int32), levels[d - 1].conv[level.parent]
            for s in (1, 0):
                if d - 1 < len(paths[s]):
                    below = level.parent == paths[s][d - 1]
                    kind[below], side[below] = BELOW, s
            rows = {"kind": kind, "side": side, "conv_id": level.conv, "parent": parent, "n": level.n, "children": level.children, "leaves": level.leaves, "saved": level.saved}
            arrays = {k: pa.array(v[whole]) for k, v in rows.items()} | {"ends": pa.array([e for e, w in zip(ends, whole.tolist(), strict=True) if w])}
            k = int(whole.sum())
            arrays |= {"shard": pa.array(np.full(k, shard, np.int32)), "depth": pa.array(np.full(k, d))}
            yield pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) if f.name in arrays else pa.nulls(k, f.type) for f in _SHARD], schema=_SHARD)
        parts = []
        for side in sides:
            if d >= len(paths[side]):
                continue
            i = paths[side][d]
            head = {"shard": shard, "depth": d, "key": keys[side][d]}
            part = {"kind": PART, "side": side, "above": keys[side][d - 1] if d else None, "words": int(level.words[i])}
            if on[i] == side:
                part |= {"conv_id": int(level.conv[i]), "n": int(level.n[i]), "children": int(level.children[i]), "leaves": int(level.leaves[i]), "saved": int(level.saved[i])}
                parts += [head | {"kind": PIECE, "side": j, "ends": text} for j, text in enumerate(_pieces(level.end_conv[begin[i] : end[i]].tolist()))]
            else:  # on both paths: its figures are those of side 0
                part |= {"n": 0, "children": 0, "leaves": 0, "saved": 0}
            parts.append(head | part)
        if parts:
            yield pa.RecordBatch.from_pylist(parts, schema=_SHARD)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of conversations (conv_id, ids, words)."""
    conv, lengths, ids, words = [], [], [], []
    for batch in batches:
        conv.append(batch.column(0).to_numpy())
        lengths.append(batch.column(2).value_lengths().to_numpy())
        words.append(batch.column(2).flatten().to_numpy())
        flat = batch.column(1).flatten()
        raw = np.frombuffer(flat.buffers()[2], np.uint8)[16 * flat.offset : 16 * (flat.offset + len(flat))] if len(flat) else np.zeros(0, np.uint8)
        ids.append(raw.view(">u8").astype(np.uint64).reshape(-1, 2))
    if sum(map(len, conv)):
        yield from shard_rows(TaskContext.get().partitionId(), levels_of(*map(np.concatenate, (conv, lengths, ids, words))))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) from pieces (key, ends) in order: a running hash, so that no node's ids are in memory at once."""
    key, state = None, hashlib.sha256()
    give = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])  # noqa: E731
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield give()
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if key is not None:
        yield give()


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of a trie of sequences (conv_id, ids array<binary> of 16 bytes each, words array<long>), as the columns that
    `conversation_trie` describes. conv_id is a key."""
    rows = cut(sequences.select("conv_id", "ids", F.col("words").cast("array<long>").alias("words")))
    spark = rows.sparkSession
    turns = rows.agg(F.sum(F.size("ids"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    found = cut(rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_shard, _SHARD_SQL))
    parts = found.where(F.col("kind") == PART)
    total = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    nodes = parts.groupBy("key").agg(F.max("depth").alias("depth"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.min(F.struct("shard", "side")).alias("owner"), *total)
    nodes = cut(nodes)
    kids = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids")
    nodes = cut(nodes.withColumns({"own_leaves": (F.col("children") == 0).cast("long"), "own_saved": (F.col("n") - 1) * F.col("words")}))
    # Each boundary node counts where it is first met, and adds to all nodes above it on that path.
    path = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    along = parts.select("shard", "side", "depth", "key").join(nodes.select("key", "owner", "own_leaves", "own_saved", F.col("conv_id").alias("above_id")), "key")
    along = cut(along)
    mine = F.col("owner") == F.struct("shard", "side")
    below = along.select("key", *[F.sum(F.when(mine, F.col(f"own_{c}")).otherwise(F.lit(0))).over(path).alias(c) for c in ("leaves", "saved")])
    below = below.groupBy("key").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    pieces = found.where(F.col("kind") == PIECE).select("key", "shard", "side", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard", "side").select("key", "ends").mapInArrow(_hash_ends, "key binary, ends string")
    parents = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent"))
    edge = nodes.join(below, "key").join(ends, "key", "left").join(parents, "above", "left")
    edge = edge.select("conv_id", "depth", "parent", "n", "children", F.col("leaves") + F.col("more_leaves"), F.col("saved") + F.col("more_saved"), F.coalesce("ends", F.lit(_EMPTY)))
    columns = ["conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    places = along.select("shard", "side", (F.col("depth") + 1).alias("depth"), "above_id")
    hung = found.where(F.col("kind") == BELOW).drop("parent").join(places, ["shard", "side", "depth"]).withColumnRenamed("above_id", "parent")
    out = found.where(F.col("kind") == WHOLE).select(*columns).unionByName(hung.select(*columns)).union(edge)
    return out.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text), from the root on: conv_id (the smallest that begins
    so), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree, itself included),
    saved_tokens (over its subtree, words of a node's last turn times one less than its conversations) and ends_sha256
    (of the ids of those that end there, in order, comma-joined).

    Turns are ordered by turn, null first; equal ones by a hash of role and text, so repeated rows are turns of their own.
    A null role or text is empty; rows without conv_id are left out; an empty table gives no rows. Turns are told apart by
    128-bit hashes. A conversation's turns (24 bytes each) are one row. Only conv_id, turn, role and text are read."""
    turns = turns_of(conversations)
    return prefix_trie(turns.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")))


def op12_prefix_trie(spark, sf_dir):
    turns = cut(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 20, crc_mod(F.col("conv_id"), 4)))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, list({'m': md5(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 'w': len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))}
                  ORDER BY turn NULLS FIRST, md5(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS BIGINT) % 4 AS h FROM t),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(p.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS s FROM h c LEFT JOIN t p ON p.conv_id = c.conv_id - c.conv_id % 20),
k AS (SELECT conv_id, len(s) AS n, array_to_string(list_transform(s, lambda x: x.m), ',') AS k, list_transform(s, lambda x: x.w) AS w, unnest(range(0, len(s) + 1)) AS depth FROM r),
p AS (SELECT conv_id, depth, n = depth AS ends, substr(k, 1, greatest(33 * depth - 1, 0)) AS k, CASE WHEN depth = 0 THEN 0 ELSE w[depth] END AS w FROM k),
o AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
c AS (SELECT o.*, u.conv_id AS parent_conv_id FROM o LEFT JOIN o u ON o.depth = u.depth + 1 AND substr(o.k, 1, greatest(33 * o.depth - 34, 0)) = u.k),
n AS (SELECT depth - 1 AS depth, substr(k, 1, greatest(33 * depth - 34, 0)) AS k, count(*) AS n_children FROM o WHERE depth > 0 GROUP BY ALL),
d AS (SELECT c.*, coalesce(n_children, 0) AS n_children, unnest(range(0, c.depth + 1)) AS up FROM c LEFT JOIN n USING (k, depth)),
s AS (SELECT up AS depth, substr(k, 1, greatest(33 * up - 1, 0)) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM d GROUP BY ALL)
SELECT d.conv_id, d.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM d JOIN s USING (k, depth) WHERE d.up = d.depth
"""
