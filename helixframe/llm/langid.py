"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Spark counts the four-character sequences of each language in all training texts. A sequence is a 64-bit key of sixteen
bits a character (letters beyond sixteen bits count as two, their surrogates, which stand for no other letter), so its context and its shorter endings are shifts and masks of the key. A model keeps sorted arrays of
keys with log probabilities for each order, and of contexts with log weights for falling back to a shorter one. A text
goes to the language with the lowest cross-entropy a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import crc_mod, share, shared

ORDER, DISCOUNT, SYMBOLS = 4, 0.75, 1 << 16
#: The score is calibrated by a tenth of the training documents, this many at most (whose ids hash lowest), on models that
#: haven't counted them. A prediction is marked as rejected under this score.
APART, MAX_CALIBRATION, REJECT = 10, 2_000, 0.5
UNKNOWN, PAD = "und", " " * (ORDER - 1)


def letter_table() -> np.ndarray:
    """Whether each character of sixteen bits is a letter; the last entry stands for all beyond."""
    return np.array([chr(i).isalpha() for i in range(SYMBOLS)] + [False], bool)


def letters_of(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    out = letters[np.minimum(codes, SYMBOLS)]
    beyond = np.flatnonzero(codes >= SYMBOLS)
    if len(beyond):
        distinct, at = np.unique(codes[beyond], return_inverse=True)
        out[beyond] = np.array([chr(c).isalpha() for c in distinct.tolist()])[at]
    return out


def parts_of(texts: list[str | None], max_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and n + len(t or "") > max_chars:
            yield a, i
            a, n = i, 0
        n += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def sequences(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the four-character sequences of all texts, the first key of each text (and the end), and whether a text
    has a letter. Other characters than letters become one space. Three spaces stand before each text and one after it, so
    that every letter ends one key and no key reaches into another text."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(f"{PAD}{t} " for t in lower).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(PAD) + len(t) + 1 for t in lower], np.int64)
    is_letter = letters_of(codes, letters)
    codes = np.where(is_letter, codes, np.uint32(32))
    wide = np.flatnonzero(codes >= SYMBOLS)
    if len(wide):
        many = np.ones(len(codes), np.int64)
        many[wide] = 2
        sizes = np.add.reduceat(many, np.cumsum(sizes) - sizes)
        beyond = codes[wide] - np.uint32(SYMBOLS)
        codes, is_letter, at = np.repeat(codes, many), np.repeat(is_letter, many), wide + np.arange(len(wide))
        codes[at], codes[at + 1] = 0xD800 + (beyond >> np.uint32(10)), 0xDC00 + (beyond & np.uint32(0x3FF))
    begin = np.zeros(len(codes), bool)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    begin[(bounds[:-1, None] + np.arange(len(PAD))).ravel()] = True
    keep = is_letter | begin
    keep[1:] |= is_letter[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    counts = np.add.reduceat(is_letter, bounds[:-1]) if len(texts) else np.zeros(0)
    c = codes[keep].astype(np.uint64)
    n = max(len(c) - ORDER + 1, 0)
    keys = c[:n].copy()
    for k in range(1, ORDER):
        keys = keys << np.uint64(16) | c[k : k + n]
    within = np.ones(n, bool)
    within[(place[bounds[1:-1], None] - np.arange(1, ORDER)).ravel()] = False
    return keys[within], place[bounds] - (ORDER - 1) * np.arange(len(bounds)), counts > 0


class KneserNey:
    """Log probabilities of four-character keys, from their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []  # (keys, logs, contexts, log weights), longest first
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((keys, counts))
            ending = keys & np.uint64((1 << 16 * (order - 1)) - 1) if order > 1 else keys
            keys, counts = np.unique(ending, return_counts=True)
        below: tuple[np.ndarray, np.ndarray] | None = None
        for order, (keys, counts) in zip(range(1, ORDER + 1), levels[::-1], strict=True):
            context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(at, counts), np.bincount(at)
            weight = DISCOUNT * kinds / total
            shorter = np.full(len(keys), 1.0 / SYMBOLS) if below is None else np.exp(below[1][np.searchsorted(below[0], keys & np.uint64((1 << 16 * (order - 1)) - 1))])
            logs = np.log((counts - DISCOUNT) / total[at] + weight[at] * shorter)
            self.orders.insert(0, (keys, logs, context, np.log(weight)))
            below = keys, logs

    def logs(self, keys: np.ndarray) -> np.ndarray:
        out, todo, order = np.zeros(len(keys)), np.arange(len(keys)), ORDER
        for known, logs, context, weight in self.orders:
            hit, at = _find(known, keys)
            out[todo[hit]] += logs[at[hit]]
            todo, keys = todo[~hit], keys[~hit]
            seen, at = _find(context, keys >> np.uint64(16))
            out[todo[seen]] += weight[at[seen]]
            order -= 1
            keys = keys & np.uint64((1 << 16 * order) - 1)
        out[todo] -= np.log(SYMBOLS)
        return out


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


class LanguageModels:
    """All languages' models. Log probabilities of every counted sequence under each language stand in one table; a slot
    table spares most searches of its sorted keys. Other sequences are worked out when they come."""

    SLOT_BITS = 20

    def __init__(self, models: dict[str, KneserNey]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.keys = np.unique(np.concatenate([m.orders[0][0] for m in self.models]))
        self.table = np.stack([m.logs(self.keys) for m in self.models], 1).astype(np.float32)
        self.slots = np.zeros(1 << self.SLOT_BITS, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))
        self.sharpness = 1.0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def entropies(self, texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a character under each language, characters, and whether a text has a letter."""
        out, size, some = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for a, b in parts_of(texts):
            keys, first, some[a:b] = sequences(texts[a:b], letters)
            size[a:b] = np.diff(first)
            at = self.slots[self._slot(keys)].astype(np.int64)
            miss = np.flatnonzero(self.keys[at] != keys)
            hit, found = _find(self.keys, keys[miss])
            at[miss[hit]] = found[hit]
            new, where = np.unique(keys[miss[~hit]], return_inverse=True)
            table = self.table
            if len(new):
                table = np.concatenate([table, np.stack([m.logs(new) for m in self.models], 1).astype(np.float32)])
                at[miss[~hit]] = len(self.keys) + where
            for k in range(0, len(keys), 1 << 18):
                lo = np.clip(first - k, 0, 1 << 18)
                run = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(table[at[k : k + (1 << 18)]], axis=0, dtype=np.float64)])
                lo = np.minimum(lo, len(run) - 1)
                out[a:b] += run[lo[1:]] - run[lo[:-1]]
        return -out / np.maximum(size, 1)[:, None], size, some

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        entropy, size, some = self.entropies(texts, letters)
        best = entropy.argmin(1)
        score = confidence(entropy, size, self.sharpness)
        return [self.names[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def confidence(entropy: np.ndarray, size: np.ndarray, sharpness: float) -> np.ndarray:
    """Share of the best language when the lead of each grows with the square root of the length."""
    lead = (entropy - entropy.min(1, keepdims=True)) * np.sqrt(np.maximum(size, 1))[:, None] * sharpness
    return 1 / np.exp(-np.minimum(lead, 50)).sum(1)


def count_sequences(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all given documents; each task sums up what it has read first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, kept = letter_table(), {}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, b in parts_of(own):
                    kept.setdefault(lang, []).append(np.unique(sequences(own[a:b], letters)[0], return_counts=True))
                    if len(kept[lang]) >= 8:
                        kept[lang] = [_sum(kept[lang])]
        for lang, found in kept.items():
            keys, n = _sum(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["lang", "key", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, key long, n long")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counts(train: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys of each language and how often each was counted."""
    found = {}
    for lang, own in count_sequences(train).toPandas().groupby("lang"):
        keys, n = own["key"].to_numpy().view(np.uint64), own["n"].to_numpy()
        by = np.argsort(keys)
        found[lang] = keys[by], n[by]
    return found


def _without(counts: dict, others: dict) -> dict:
    """Counts less those of some of the texts."""
    left = {}
    for lang, (keys, n) in counts.items():
        if lang in others:
            n = n.copy()
            n[np.searchsorted(keys, others[lang][0])] -= others[lang][1]
        if n.any():
            left[lang] = keys[n > 0], n[n > 0]
    return left


def fit_languages(train: DataFrame) -> LanguageModels | None:
    """Models of all sequences of (doc_id, text, lang); None without any letter in a text that has a lang. The driver and
    each worker hold them whole. The score's sharpness is found on documents set apart: models are made from all counts
    less theirs, measured on them, and made again from all counts. Without documents apart it is 1."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = _counts(train)
    if not counts:
        return None
    sharpness = _sharpness(train, counts)
    found = LanguageModels({lang: KneserNey(*c) for lang, c in counts.items()})
    found.sharpness = sharpness
    return found


def _sharpness(train: DataFrame, counts: dict) -> float:
    rows = train.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash"))
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0).select("doc_id", "text_hash").distinct()
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(MAX_CALIBRATION)
    apart = rows.join(F.broadcast(few), ["doc_id", "text_hash"], "left_semi").select("text", "lang")
    left = _without(counts, _counts(apart))
    if not left:
        return 1.0
    sent = share(train.sparkSession, LanguageModels({lang: KneserNey(*c) for lang, c in left.items()}))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letters = shared(sent), letter_table()
        for batch in batches:
            entropy, size, some = m.entropies(batch.column(0).to_pylist(), letters)
            own = np.array([m.names.index(x) if x in m.names else -1 for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([e.tobytes() for e in entropy[some]], pa.binary()), pa.array(size[some]), pa.array(own[some])], ["e", "size", "own"])

    # Rows that repeat a text and lang count once, so there are no more than MAX_CALIBRATION for each language.
    rows = apart.mapInArrow(measure, "e binary, size long, own long").distinct().orderBy("size", "own", "e").collect()
    if not rows:
        return 1.0
    entropy, size, own = np.array([np.frombuffer(r.e) for r in rows]), np.array([r.size for r in rows]), np.array([r.own for r in rows])
    right = entropy.argmin(1) == own
    loss = lambda k: -np.log(np.clip(np.where(right, c := confidence(entropy, size, k), 1 - c), 1e-6, 1)).mean()
    return float(min(np.geomspace(0.05, 20, 40), key=loss))


def predict_languages(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document; only doc_id and text are read."""
    sent = share(docs.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letters = shared(sent), letter_table()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, score = m.predict(texts, letters) if m else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("rejected", F.col("score") < REJECT)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and rejected, by models of the documents outside the held-out quarter.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing can be learned; documents
    with a null lang aren't learned from, but get a prediction; repeated rows get equal ones. A rejected prediction still
    names the likeliest language."""
    return predict_languages(docs, fit_languages(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")))


def op10_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
