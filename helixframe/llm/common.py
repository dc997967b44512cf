"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.shared import if_small, keep  # noqa: F401  operators take if_small from here
from helixframe.sources.shared import shared_dir as checkpoint_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between white space, and words of letters, digits and anything beyond ASCII.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
MARK_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_ascii_py(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER_MAP)


_LOWER_MAP = {ord(a): ord(b) for a, b in zip(UPPER, LOWER, strict=True)}


def count_space_words(text: Column) -> Column:
    """Number of runs of anything but white space (null: 0), from one split without filtering its parts."""
    edge = lambda c: F.ascii(c).isin(32, 9, 10, 11, 12, 13).cast("int")
    n = F.size(F.split(text, SPACE_CLASS)) - edge(text) - edge(F.substring(text, -1, 1))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> Column:
    """All columns as one, so that their names meet no others."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder, without the plan that made them."""
    bound_batches(df.sparkSession)
    return keep(df)


#: Rows of an Arrow batch: texts can be long, and a worker holds a batch at a time.
ARROW_ROWS = 1500


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts a value, of which the caller has bounded the size, in a form that workers open without this package."""
    bound_batches(spark)
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast):
    return cloudpickle.loads(value.value)


# Words of whole Arrow batches, in numpy. Bytes of UTF-8 text are enough, as every separator is ASCII.

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base from 1, and of its inverse modulo 2**64 from 0."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _POWERS[:] = np.cumprod(np.full(size, _BASE, np.uint64)), np.cumprod(inverse)
    return _POWERS[0], _POWERS[1]


def utf8_parts(texts: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for parts of a string array of about max_bytes; null is empty.
    A longer text is a part of its own."""
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the first word of each text (with one more entry for the end)."""
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, from running sums over the bytes; the same in every process. A few words at
    a time, to bound memory."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        first = starts[a]
        s, e = starts[a : a + step] - first, ends[a : a + step] - first
        n = int(e[-1])
        powers, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[first : first + n].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        out[a : a + step] = (sums[e] - sums[s]) * inverse[s]
    return mix64(out)


def distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number among them of each value."""
    order = np.argsort(hashes)
    by = hashes[order]
    first = np.concatenate([[True], by[1:] != by[:-1]])[: len(by)]
    number = np.empty(len(by), np.int64)
    number[order] = np.cumsum(first) - 1
    return by[first], order[first], number
