"""Language-model scores: an exact unigram score by words, and an attention model's score by subwords.

Documents go in chunks. A chunk lists each of its distinct words once, with its count in the chunk's training texts, in
rows by ranges of the words' hashes. One task adds up the words of a range over all chunks and sends each chunk the sums
of its own words. Which documents hold a word stays with the chunk, so a common word costs an entry a chunk, and no task
holds the whole vocabulary.

Words become subwords once for each distinct word of a chunk. The ids of whole texts are kept beside the chunks, for the
counts, the attention weights and the scores. Weights are learned in rounds: groups of training documents, dealt by hash,
each go on from the last weights over all their tokens, and the round ends with the mean of the groups' weights by
tokens. Every training token is in one round.
"""

from __future__ import annotations

import base64
import math
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.attention import CLASSES, AttentionModel
from helixframe.llm.common import SPACES, TO_LOWER, checkpoint_dir, crc_mod, cut, distinct_hashes, share, shared, utf8_parts, word_hashes, word_spans

#: A public vocabulary of byte pairs for many languages; one free id marks a text's end. Another file in tiktoken's format
#: can be given as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Training tokens of a group, whose weights one task learns, and rounds over the groups at most.
GROUP_TOKENS, ROUNDS = 1 << 18, 8
CHUNK_BYTES = 1 << 23
_END_WORD = np.uint64(0)


class Subwords:
    """Ids of texts by a vocabulary file in tiktoken's format, given as bytes."""

    def __init__(self, raw: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.end = max(self.ranks.values()) + 1
        self.sizes = np.zeros(self.end + 1, np.int64)
        self.sizes[list(self.ranks.values())] = list(map(len, self.ranks))
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @staticmethod
    def opened(raw: bytes) -> Subwords:
        import tiktoken

        kept = vars(tiktoken).setdefault("_opened", {})  # a worker process opens a vocabulary once
        if raw not in kept:
            kept[raw] = Subwords(raw)
        return kept[raw]

    def spell(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given by their bytes, each with a space before it; and how many ids each word has."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = ends - starts + 1
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        raw = np.where(within > 0, data[np.repeat(starts, size) + within - 1], np.uint8(32))
        try:
            text = raw.tobytes().decode()
        except UnicodeDecodeError:
            words = [b" " + bytes(data[a:b]).decode("utf-8", "replace").encode() for a, b in zip(starts, ends, strict=True)]
            text, size = b"".join(words).decode(), np.array(list(map(len, words)))
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size), "right"), prepend=0)

    def encode(self, text: str | None) -> np.ndarray:
        data = TO_LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), SPACES)
        return self.spell(data, starts, ends)[0]


def _summed(train: DataFrame, end: int, kind: str, count, cells: int) -> np.ndarray:
    """Sums of count(ids) over the ids of all training texts, which stand in a row between ends."""
    edge = np.array([end], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += count(np.frombuffer(edge + b"".join(x + edge for x in batch.column(0).to_pylist()), kind))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(cells, np.int64)
    for r in train.select("ids").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out


def fit_attention(train: DataFrame, subwords: Subwords) -> AttentionModel:
    """Counts and attention weights from all tokens of all training texts, given as rows with deal and ids."""
    end, kind = subwords.end, _id_type(subwords.end)
    spaced = np.zeros(end + 1, bool)
    spaced[[i for w, i in subwords.ranks.items() if w[:1] == b" "]] = True
    model = AttentionModel(_summed(train, end, kind, lambda ids: np.bincount(ids[1:], minlength=end + 1), end + 1), spaced, end)
    kinds, classes, cells = model.kinds, model.classes, len(model.follow) * CLASSES
    model.follows(_summed(train, end, kind, lambda ids: np.bincount(kinds[ids[:-1]] * CLASSES + classes[ids[1:]], minlength=cells), cells))
    groups = max(1, model.tokens // GROUP_TOKENS)
    rounds = min(ROUNDS, groups)
    fan = math.isqrt(groups // rounds) + 1  # sums of this many groups each go to the driver
    grouped = train.select(F.pmod("deal", F.lit(groups)).alias("team"), "deal", "ids")
    for k in range(rounds):
        sent = share(train.sparkSession, model)
        learned = grouped.where(F.col("team") % rounds == k).groupBy("team").applyInArrow(_learner(sent, _id_type(subwords.end), rounds), "team long, n long, weights binary")
        sums = learned.withColumn("fan", F.floor(F.col("team") / rounds) % fan).groupBy("fan").applyInArrow(_sum_weights, "team long, n long, weights binary")
        found = sorted((r.team, r.n, r.weights) for r in sums.collect())
        if found:
            total, at = sum(np.frombuffer(w) for _, _, w in found) / sum(n for _, n, _ in found), 0
            for name, w in model.p.items():
                model.p[name] = total[at : at + w.size].reshape(w.shape).astype(np.float32)
                at += w.size
    return model


def _learner(sent, kind: str, rounds: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["deal"].to_pylist(), table["ids"].to_pylist(), strict=True))
        texts = [np.frombuffer(x, kind).astype(np.int64) for _, x in rows]
        model = shared(sent).fit(texts, rounds)
        n = sum(len(t) + 1 for t in texts)
        weights = np.concatenate([w.ravel() for w in model.p.values()]).astype(np.float64) * n
        return pa.table({"team": table["team"][:1], "n": [n], "weights": pa.array([weights.tobytes()], pa.binary())})

    return run


def _sum_weights(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["team"].to_pylist(), table["weights"].to_pylist(), strict=True))
    total = sum(np.frombuffer(w) for _, w in rows)
    return pa.table({"team": [rows[0][0]], "n": [sum(table["n"].to_pylist())], "weights": pa.array([total.tobytes()], pa.binary())})


def _id_type(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


#: deal is a hash by which a training document goes to a group; null if it is held out.
_ROWS = "part int, chunk long, words binary, meta binary, doc int, deal long, ids binary"
_KINDS = {"part": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "meta": pa.binary(), "doc": pa.int32(), "deal": pa.int64(), "ids": pa.binary()}
#: Tokens for which a part is laid out; a part holds some words of every chunk, and is counted in one task.
PART_TOKENS = 1 << 24


def _chunk_row(chunk: int, n: int, **columns: list) -> pa.RecordBatch:
    columns["chunk"] = [chunk] * n
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kind) for name, kind in _KINDS.items()], list(_KINDS))


def chunk_rows(docs: DataFrame, sent, parts: int) -> DataFrame:
    """A row (part, chunk, words) for each part of a chunk's distinct words, one with meta for its documents and which of
    the words they hold, and one with the subword ids of each document. docs: doc_id, held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, k = Subwords.opened(shared(sent)), 0
        kind = _id_type(subwords.end)
        for batch in batches:
            ids, held, texts = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool), batch.column(2)
            for a, b, data, offsets in utf8_parts(texts, CHUNK_BYTES):
                data = TO_LOWER[data]
                starts, ends, first = word_spans(data, offsets, SPACES)
                hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                # The ends of the texts come after all words, so that a word's place stays its number.
                words = np.concatenate([np.where(hashes == _END_WORD, np.uint64(1), hashes), np.full(b - a, _END_WORD)])
                distinct, place, word = distinct_hashes(words)
                n, docs_of = np.diff(first) + 1, np.arange(b - a)
                table, held_by = chunk_words(distinct, word, np.concatenate([np.repeat(docs_of, n - 1), docs_of]), held[a:b], parts)
                chunk = TaskContext.get().partitionId() << 32 | k
                k += 1
                yield _chunk_row(chunk, len(table), part=list(table), words=list(table.values()))
                yield _chunk_row(chunk, 1, meta=[pickle.dumps((ids[a:b], held[a:b], n, *held_by))])
                # The end's hash is the least, so it comes first and has no ids.
                flat, many = subwords.spell(data, starts[place[1:]], ends[place[1:]])
                flat, many = flat.astype(kind), np.concatenate([[0], many])
                begin = np.cumsum(many) - many
                for at in range(a, b, 256):
                    to, coded = min(b, at + 256), []
                    for d in range(at - a, to - a):
                        w = word[first[d] : first[d + 1]]
                        size = many[w]
                        coded.append(flat[np.repeat(begin[w] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes())
                    deal = [None if h else zlib.crc32(x, zlib.crc32(repr(i).encode())) for i, h, x in zip(ids[at:to], held[at:to], coded, strict=True)]
                    yield _chunk_row(chunk, to - at, doc=list(range(at - a, to - a)), deal=deal, ids=coded)

    return docs.mapInArrow(run, _ROWS)


_SCORE = np.dtype([("doc", "<u4"), ("score", "<f8")])


def score_rows(rows: DataFrame, sent, kind: str) -> DataFrame:
    """(chunk, scores): scores of some documents of a chunk, from rows with chunk, doc and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                chunk, doc, ids = (c.to_pylist() for c in batch.slice(at, 256).columns)
                scores = np.empty(len(doc), _SCORE)
                scores["doc"], scores["score"] = doc, model.score([np.frombuffer(x, kind).astype(np.int64) for x in ids]) / math.log(10)
                chunk = np.array(chunk)
                own = np.unique(chunk)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([scores[chunk == c].tobytes() for c in own], pa.binary())], ["chunk", "scores"])

    return rows.select("chunk", "doc", "ids").mapInArrow(run, "chunk long, scores binary")


def chunk_words(distinct: np.ndarray, word: np.ndarray, owner: np.ndarray, held: np.ndarray, parts: int):
    """Each part's distinct words of a chunk with their counts in training documents; and, for all distinct words, how
    many postings each has, and the postings: a document's number in the chunk, and a count of up to 255 (more take more
    postings). `word` and `owner` are the number among the distinct words, and the document, of each word."""
    pairs, times = np.unique(word * len(held) + owner, return_counts=True)
    word, owner = np.divmod(pairs, len(held))
    train = np.bincount(word, np.where(held[owner], 0, times), len(distinct)).astype("<u4")
    entries = (times + 254) // 255
    last = np.cumsum(entries) - 1
    count = np.full(int(entries.sum()), 255)
    count[last] = times - 255 * (entries - 1)
    post = (np.repeat(owner, entries) << 8 | count).astype("<u4")
    many = np.bincount(word, entries, len(distinct)).astype("<u4")
    # Parts are ranges of hashes, so that each is a run of the sorted words.
    edges = np.searchsorted(distinct, np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64))
    edges = [0, *edges.tolist(), len(distinct)]
    table = {p: distinct[i:j].astype("<u8").tobytes() + train[i:j].tobytes() for p, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i}
    return table, (many, post)


_COUNTS = "part int, chunk long, counts binary, n_all long, n_distinct long"


def _count_part(table: pa.Table) -> pa.Table:
    """Counts the words of one part over all chunks; each chunk gets back the counts of its own words."""
    chunks, blobs = table["chunk"].to_pylist(), table["words"].to_pylist()
    hashes = [np.frombuffer(x, "<u8", len(x) // 12) for x in blobs]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    train = np.concatenate([np.frombuffer(x, "<u4", -1, 8 * len(h)) for x, h in zip(blobs, hashes, strict=True)])
    counts = np.bincount(at, train, len(distinct)).astype("<u8")
    kind = next(k for k in ("<u2", "<u4", "<u8") if counts.max() < 1 << 8 * int(k[2]))
    out = [kind.encode() + c.tobytes() for c in np.split(counts.astype(kind)[at], np.cumsum([len(h) for h in hashes])[:-1])]
    none = [None] * len(chunks)
    return pa.table({
        "part": pa.array([table["part"][0].as_py()] * (len(chunks) + 1), pa.int32()), "chunk": pa.array([*chunks, None], pa.int64()), "counts": pa.array([*out, None], pa.binary()),
        "n_all": pa.array([*none, int(counts.sum())], pa.int64()), "n_distinct": pa.array([*none, int((counts > 0).sum())], pa.int64()),
    })


def _totals(n_all: int, n_distinct: int):
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def run(table: pa.Table) -> pa.Table:
        ids, held, n, many, post = pickle.loads(next(x for x in table["meta"].to_pylist() if x is not None))
        score = np.zeros(len(ids))
        for x in table["scores"].to_pylist():
            if x is not None:
                scores = np.frombuffer(x, _SCORE)
                score[scores["doc"]] = scores["score"]
        counts = sorted((p, x) for p, x in zip(table["part"].to_pylist(), table["counts"].to_pylist(), strict=True) if x is not None)
        c = np.repeat(np.concatenate([np.frombuffer(x, x[:3].decode(), -1, 3) for _, x in counts]), many)
        doc, times = post >> 8, post & 255
        logs = np.bincount(doc, times * np.log10(c + 1.0), len(ids))
        known = np.bincount(doc, np.where(c > 0, times, 0), len(ids)).astype(np.int64)
        base = logs - n * math.log10(n_all + n_distinct + 1)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": n, "n_known": known, "base_score": base, "score": score})

    return run, out


def score_documents(docs: DataFrame, held_out: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Words are runs of anything but white space, A-Z lower-cased, told apart by 64-bit hashes; the end of a text is a
    token. Null texts count as empty and consist of their end; without training documents all counts are 0; repeated
    rows are scored alike; an empty table gives an empty result. The chunks' rows are kept as a table in the checkpoint
    folder, which may be cleared once the result is read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    raw = open(tokenizer, "rb").read()
    subwords = Subwords(raw)
    parts = 8 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (4 * PART_TOKENS)
    path = f"{checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunk_rows(docs, share(spark, raw), parts).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(_ROWS).parquet(path)
    model = fit_attention(rows.where("deal IS NOT NULL"), subwords)
    counts = cut(rows.where("part IS NOT NULL").select("part", "chunk", "words").groupBy("part").applyInArrow(_count_part, _COUNTS))
    n_all, n_distinct = counts.agg(F.sum("n_all"), F.sum("n_distinct")).first()
    n_all, n_distinct = n_all or 0, n_distinct or 0
    kinds = {"part": "int", "counts": "binary", "meta": "binary", "scores": "binary"}
    filled = lambda df: df.select("chunk", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    metas = rows.where("meta IS NOT NULL").select("chunk", "meta")
    scores = score_rows(rows.where("doc IS NOT NULL"), share(spark, model), _id_type(subwords.end))
    run, schema = _totals(n_all, n_distinct)
    out = filled(counts.where("chunk IS NOT NULL").drop("n_all", "n_distinct")).unionByName(filled(metas)).unionByName(filled(scores)).groupBy("chunk").applyInArrow(run, schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2)
