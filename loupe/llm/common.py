"""Shared parts of the corpus operators: tables, staging, words and windows.

Texts are handled as UTF-8 bytes. ``bytes.split()`` and ``bytes.lower()`` treat
exactly the ASCII white space (space, tab to carriage return) and exactly the
letters A-Z, which is what the operators' word definitions ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.staging import discarded, shared_dir, staged  # noqa: F401

#: Bytes of text that one numpy pass takes at a time, besides a single longer text.
SLICE_BYTES = 1 << 19
#: Words whose hashes a worker remembers before it starts afresh.
VOCABULARY = 1 << 19

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, n: int, part: int, least: int) -> int:
    """Parts for ``n`` rows: ``part`` rows each at most, and work for every core where they have ``least``."""
    return max(ceil(n / part), min(4 * spark.sparkContext.defaultParallelism, ceil(n / least)), 1)


def wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns in one, so that none can clash with an operator's own."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unwrapped(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some with a new value of their old type."""
    row = F.col("row")
    for name, value in changed.items():
        if name in docs.columns:
            row = row.withField(name, value.cast(docs.schema[name].dataType))
    return df.select(row.alias("row")).select("row.*")


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join with a right side that has one row for each key and ``n``, the
    rows of the left side with it.

    Keys with more than ``total / parts`` left rows would make hot tasks. There
    are fewer than ``parts`` of them, whatever the data, so their right rows are
    broadcast; all other keys meet through a shuffle. ``n`` is dropped.
    """
    least = max(total // parts, 1000)
    hot = right.where(F.col("n") > least).drop("n")
    cold = right.where(F.col("n") <= least).drop("n")
    keys = hot.select(key)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(keys), key, "left_anti").join(cold, key))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit of a 64-bit number over all of them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def windows(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive hashes, order counting."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(base)
    out = h[:m].copy()
    for j in range(1, n):
        out *= b
        out += h[j : j + m]
    return mixed(out)


def whole(h: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> int:
    """The hash of a sequence shorter than a window; its length counts too."""
    out = len(h)
    for x in h.tolist():
        out = (out * base + x) & _MASK
    return int(mixed(np.array([out], np.uint64))[0])


def inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the window of ``n`` that starts at each place stays in its document.

    ``offsets``: where each document starts in the joined sequence, and its end.
    """
    m = max(total - n + 1, 0)
    ok = np.ones(total + 1, bool)
    for back in range(1, n):  # a start less than n before a document's end crosses it
        at = offsets[1:] - back
        ok[at[at >= 0]] = False
    return ok[:m]


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of sorted columns begin and end."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def batches(source: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch cut into slices of bounded bytes, with its texts as UTF-8."""
    for batch in source:
        at = batch.schema.get_field_index(column)
        binary = batch.column(at).cast(pa.binary())
        lengths = np.asarray(pc.fill_null(pc.binary_length(binary), 0))
        for i, j in slices(lengths):
            yield batch.slice(i, j - i), binary.slice(i, j - i).to_pylist()
