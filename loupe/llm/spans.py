"""Spans found for documents, and how they meet the texts again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import batches, staged, unwrapped, wrapped

#: What stands for a null document id: later than all others.
LAST_ID = (1 << 63) - 1
#: Bytes of a table of spans, with 64 a row, up to which it is broadcast.
BROADCAST_BYTES = 96 << 20
#: Parts over which spans are dealt that need no more settling.
SPREAD = 1 << 12

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def covered(spans: bytes, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``length`` from a first to a last start (packed uint32 pairs)."""
    pairs = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 1] + length, total), -1)
    return np.cumsum(edge[:-1]) > 0


def gathered(spans: DataFrame) -> DataFrame:
    """One row for each document: a list of its packed spans. They are no longer than its text is."""
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"))


def _ranges(data: bytes, width: int) -> bytes:
    """Starts, or first and last starts, as the fewest ranges."""
    pairs = np.frombuffer(data, np.uint32).reshape(-1, width).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    first, last = pairs[:, 0], np.maximum.accumulate(pairs[:, -1])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1] + 1
    at = np.flatnonzero(new)
    ends = last[np.append(at[1:], len(first)) - 1]
    return np.stack([first[at], ends], 1).astype(np.uint32).tobytes()


def ranged(spans: DataFrame, width: int) -> DataFrame:
    """One row for each document, with the ranges of its starts (width 1) or pairs (width 2)."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            packed = [_ranges(b"".join(x), width) for x in batch.column("spans").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(packed, pa.binary())], schema=_SCHEMA)

    return staged(gathered(spans).mapInArrow(made, "doc_id long, text_key long, spans binary"), "ranges")


def joined_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with ``spans`` of a ranged() table, null where nothing was found."""
    size = spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0
    one = spans.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    one = F.broadcast(one) if size <= BROADCAST_BYTES else one
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    found = keyed.join(one, (F.coalesce(keyed["doc_id"].cast("long"), F.lit(LAST_ID)) == one["_doc"]) & (keyed["_text"] == one["_key"]), "left")
    return found.drop("_doc", "_key", "_text")


def with_cuts(docs: DataFrame, spans: DataFrame, cut: Callable[[bytes, bytes], bytes]) -> DataFrame:
    """All documents with all columns; ``cut`` makes the new text of one that has spans."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            new = [t if s is None else cut(t, s) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("row"), pa.array(new, pa.binary()).cast(pa.string())], names=["row", "text"])

    joined = joined_spans(wrapped(docs), spans).select("row", "text", "spans")
    return unwrapped(joined.mapInArrow(made, joined.select("row", "text").schema), docs, text=F.col("text"))
