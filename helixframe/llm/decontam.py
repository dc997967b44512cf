"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of documents with a bounded number of words. Its index has the benchmark's words as its alphabet; any
other word separates, and runs of known words that are shorter than the shortest window aren't indexed, since no window
fits into them. All windows are searched at once, backwards; their places mark the words to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import MARKS, TO_LOWER, share, shared
from helixframe.llm.fmindex import FMIndex

WINDOW = 13
#: Words of a shard (a longer document is a shard of its own), and bytes of benchmark text searched for at once.
SHARD_WORDS, BLOCK_BYTES = 1 << 20, 4 << 20
#: 5 %: a document is contaminated if so many of its words are hit.
HIT_SHARE = 20

_TO_WORDS = bytes(32 if MARKS[TO_LOWER[b]] else int(TO_LOWER[b]) for b in range(256))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Windows:
    """The windows of one block of benchmark items, as rows of word numbers grouped by length."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            n = min(size, len(ids))
            if n:
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number[item]))
        self.by_size = {}
        for n, runs in sorted(found.items()):
            rows, which = np.unique(np.concatenate([r for r, _ in runs]), axis=0, return_inverse=True)
            owned = np.unique(np.stack([which.ravel(), np.repeat([k for _, k in runs], [len(r) for r, _ in runs])], 1), axis=0)
            self.by_size[n] = (rows, np.searchsorted(owned[:, 0], np.arange(len(rows) + 1)), owned[:, 1].astype(np.int32))


def search(shard: list[list[int]], windows: Windows) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Per document: merged spans of hit words, and the items that have a window there."""
    sizes = np.array([len(x) + 1 for x in shard])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.zeros(int(offsets[-1]), np.int32)
    for a, x in zip(offsets, shard, strict=False):
        ids[a : a + len(x)] = x
    spans: list[list[tuple[int, int]]] = [[] for _ in shard]
    items: list[list[str]] = [[] for _ in shard]
    if not windows.by_size:
        return spans, items
    known = np.concatenate([[False], ids > 0, [False]])
    starts, ends = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    fit = ends - starts >= min(windows.by_size)
    starts, lengths = starts[fit], (ends - starts)[fit] + 1  # a run ends with its 0
    if not len(starts):
        return spans, items
    origin = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
    index = FMIndex(ids[origin], len(windows.vocabulary) + 1)
    mark = np.zeros(len(ids) + 1, np.int64)
    pairs = []
    for n, (patterns, first, owner) in windows.by_size.items():
        which, at = index.find(patterns)
        at = origin[at]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n, -1)
        hits = np.unique(np.stack([np.searchsorted(offsets, at, "right") - 1, which], 1), axis=0)
        many = first[hits[:, 1] + 1] - first[hits[:, 1]]
        place = np.repeat(first[hits[:, 1]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(hits) else np.zeros(0, np.int64)
        pairs.append(np.stack([np.repeat(hits[:, 0], many), owner[place]], 1))
    for d, i in np.unique(np.concatenate(pairs), axis=0):
        items[d].append(windows.items[i])
    hit = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    for a, b in zip(np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:]), strict=True):
        d = int(np.searchsorted(offsets, a, "right")) - 1
        spans[d].append((int(a - offsets[d]), int(b - offsets[d])))
    return spans, items


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search(docs: DataFrame, blocks: list[Broadcast], text: str, found: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(found, FOUND)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared(blocks[0]) if len(blocks) == 1 else None
        for batch in batches:
            rows, shard, n = [], [], 0

            def flush(rows=rows, shard=shard):
                every = [([], []) for _ in shard]
                for block in blocks:  # a worker holds one block's windows at a time
                    windows = only or shared(block)
                    get = windows.vocabulary.get
                    for (spans, items), more, also in zip(every, *search([[get(w, 0) for w in doc] for doc in shard], windows), strict=True):
                        spans[:] = merged(spans, more)
                        items += also
                for doc, (spans, items) in zip(shard, every, strict=True):
                    named = sorted(set(items), key=lambda i: (i is None, i or ""))
                    rows.append({"n_words": len(doc), "spans": [{"start": a, "end": b} for a, b in spans], "items": named})
                shard.clear()

            for x in batch.column(text):
                doc = words(x.as_py())
                if shard and n + len(doc) > SHARD_WORDS:
                    flush()
                    n = 0
                shard.append(doc)
                n += len(doc)
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _FOUND_ARROW)], names)

    return docs.mapInArrow(run, schema)


_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", found: str = "found") -> DataFrame:
    """docs with one more column, `found`: n_words, merged spans of hit words (from 0, end exclusive), and the ids (as
    text) of benchmark items with a window there. An input column of that name is replaced.

    Null and empty texts have no words and no hits; items without words have no window, an item with a null id has
    windows like any other and stands as null among the items; repeated rows get equal results; an empty table of either
    kind gives no hits. The benchmark goes in blocks of bounded size: the driver makes the windows of one block at a time,
    and a worker splits a shard's texts once and searches for block after block, each with an index over the words that
    the block has. So neither table is shuffled, and memory is bounded by a block and a shard."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    many = -(-size // BLOCK_BYTES) or 1
    blocks = []
    for k in range(many):
        block = items.where(F.pmod(F.hash("item", "t"), F.lit(many)) == k)
        blocks.append(share(docs.sparkSession, Windows([tuple(r) for r in block.collect()], window)))
    return _search(docs.drop(found), blocks, text, found)


def contaminated(found: str = "found"):
    n_hit = hit_words(found)
    return (n_hit > 0) & (n_hit * HIT_SHARE >= F.col(f"{found}.n_words"))


def hit_words(found: str = "found"):
    return F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def op3_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    return rows.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, list_aggregate(w[s : s + least(13, len(w)) - 1], 'string_agg', ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, list_aggregate(w[s : s + n - 1], 'string_agg', ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.n, dw.s, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
