"""Substring dedup on windows of words, behind a count-min prefilter.

Documents are packed into chunks. First pass: every task sketches the windows of
each chunk, counting each window once for a document. A sketch has ``ROWS`` rows of
cells whose counts stop at 2. The cells of a row are dealt into parts, whose number
grows with the corpus while a part keeps its size, so that the sketch has the same
load at any size. Partial sketches travel as sorted cell lists, one for each chunk
and part; whoever merges a part sends back to each chunk which of its cells were
counted twice. A window is estimated repeated if all its cells are; the estimate is
never too low.

Second pass: chunks meet their answers, and only windows estimated repeated are
grouped, exactly, by 96 bits of hashes. Windows repeated within a task are settled
there, so a hot window is sent once by each task. No task or driver holds more than
a part of the sketch or the answers of a chunk. The spans found for a document meet
its text through a broadcast of checked size or else a shuffle.

Defined results: null and empty texts and those with fewer words than a window
lose nothing; documents with one id don't count as earlier than each other, so
repeated rows lose the same; a null id counts as later than all others; an empty
table gives no rows. ``substrings_removed`` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import batches, discarded, hashes, inside, mixed, parts_for, runs, staged, table, windows
from loupe.llm.spans import LAST_ID, SPREAD, covered, joined_spans, ranged, with_cuts

WINDOW = 13
ROWS = 2
#: Cells of a row for each window expected.
SPARE = 4
#: Windows expected in a part of a row of cells, and those that make a part worth while.
SKETCH_PART, LEAST_SKETCH_PART = 8 << 20, 1 << 14
#: Bytes of a chunk's texts, and windows that a task gathers before it sends them.
CHUNK_BYTES, GATHERED = 12 << 20, 1 << 21
#: Windows of one part of the second pass, if all were repeated, and those that make a part worth while.
PART, LEAST_PART = 10 << 20, 1 << 14

_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_SECOND = 0xD6E8FEB86659FD93


class _Windows:
    """Window hashes of one slice: h and check of each, its document and place."""

    def __init__(self, texts: list[bytes | None], n: int) -> None:
        split = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = hashes([w for words in split for w in words])
        at = np.flatnonzero(inside(offsets, n, len(flat)))
        self.h = windows(flat, n)[at]
        self.doc = np.searchsorted(offsets, at, "right") - 1
        self.place = (at - offsets[self.doc]).astype(np.uint32)
        self._flat, self._n, self._at = flat, n, at

    def check(self, keep: np.ndarray) -> np.ndarray:
        return (windows(self._flat, self._n, _SECOND)[self._at[keep]] >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Sketch:
    """The shape of a sketch: the parts of each row, and the cells of a part as a power of two."""

    parts: int
    bits: int

    @classmethod
    def of(cls, spark: SparkSession, expected: int) -> Sketch:
        parts = parts_for(spark, expected, SKETCH_PART, LEAST_SKETCH_PART)
        return cls(parts, max(ceil(log2(SPARE * expected / parts)), 8))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """The cell of each window: its part in the upper half, its place there in the lower."""
        for _ in range(row):
            h = mixed(h * _ODD)
        part = ((h >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
        return (part << np.uint64(32)) | ((h & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.bits))

    def partial(self, h: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The sketch of some windows: (row * parts + part, cells counted and whether twice)."""
        order = np.argsort(h)
        h, twice = h[order], twice[order]
        starts, _ = runs(h)
        count = np.minimum(np.add.reduceat(twice.astype(np.int64) + 1, starts), 2)
        h = h[starts]
        for row in range(ROWS):
            c = self.cells(h, row)
            order = np.argsort(c)
            c, n = c[order], count[order]
            starts, _ = runs(c)
            n = np.add.reduceat(n, starts) > 1
            c = c[starts]
            edges = np.searchsorted(c, np.arange(self.parts + 1, dtype=np.uint64) << np.uint64(32))
            for part, (a, b) in enumerate(pairwise(edges.tolist())):
                if a < b:
                    yield row * self.parts + part, _pack(_gaps(c[a:b]), np.packbits(n[a:b]))


def _planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers byte plane by byte plane: the upper planes of small ones compress."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()


def _whole(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(4, -1).T.copy().view(np.uint32).reshape(-1)


def _gaps(cells: np.ndarray) -> np.ndarray:
    """Sorted places as the gaps between them."""
    return _planes(np.diff(cells.astype(np.uint32), prepend=np.uint32(0)))


def _places(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_whole(planes), dtype=np.uint32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; each is led by its length in bytes."""
    return zstandard.compress(b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


_CHUNKS = "chunk long, part long, data binary"
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
#: The part of rows that hold documents.
_TEXT = -1


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_CHUNK_SCHEMA.types)], schema=_CHUNK_SCHEMA)


def chunked(docs: DataFrame) -> DataFrame:
    """The documents, some packed into each row, with the chunk they belong to."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch, texts in batches(source):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            data = b"".join(t or b"" for t in texts)
            if not data:
                continue
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            yield _batch([(chunk, _TEXT, _pack(ids, keys, sizes, np.frombuffer(data, np.uint8)))])
            size += len(data)
            if size >= CHUNK_BYTES:
                chunk, size = chunk + 1, 0

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, _CHUNKS)


def _documents(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, text keys and texts of one row of chunked()."""
    ids, keys, sizes, text = _unpack(data, np.int64, np.int64, np.int64, np.uint8)
    ends = np.cumsum(sizes)
    whole = text.tobytes()
    return ids, keys, [whole[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def sketched(chunks: DataFrame, n: int, sketch: Sketch) -> DataFrame:
    """The partial sketches of the chunks, part by part."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            if size:
                h, twice = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                yield _batch([(chunk, part, data) for part, data in sketch.partial(h, twice)])

        for batch in source:
            for at, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                if at != chunk or size >= GATHERED:
                    yield from sent()
                    chunk, held, size = at, [], 0
                w = _Windows(_documents(data.as_buffer())[2], n)
                if len(w.h):
                    order = np.argsort(w.h, kind="stable")  # documents stay in order within a window
                    h, doc = w.h[order], w.doc[order]
                    starts, ends = runs(h)
                    held.append((h[starts], doc[starts] != doc[ends - 1]))
                    size += len(starts)
        yield from sent()

    return chunks.mapInArrow(made, _CHUNKS)


def answered(sketches: DataFrame, sketch: Sketch) -> DataFrame:
    """For each chunk and part, the cells of the chunk that were counted twice in all."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, counts = None, [], np.zeros(1 << sketch.bits, np.uint8)

        def done() -> Iterator[pa.RecordBatch]:
            for _, c, twice in held:
                counts[c] = np.minimum(counts[c] + 1 + twice, 2)
            for i in range(0, len(held), 256):
                told = [(chunk, c[counts[c] > 1]) for chunk, c, _ in held[i : i + 256]]
                if rows := [(chunk, part, _pack(_gaps(c))) for chunk, c in told if len(c)]:
                    yield _batch(rows)
            for _, c, _ in held:
                counts[c] = 0

        for batch in source:
            for chunk, at, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "data")), strict=True):
                if at != part:
                    yield from done()
                    part, held = at, []
                planes, twice = _unpack(data, np.uint8, np.uint8)
                c = _places(planes)
                held.append((chunk, c, np.unpackbits(twice, count=len(c))))
        yield from done()

    return sketches.repartition("part").sortWithinPartitions("part").mapInArrow(made, _CHUNKS)


def estimated_repeated(h: np.ndarray, told: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """Places of the windows whose cells are, row for row, among the sorted ones ``told``."""
    at = np.arange(len(h))
    for row, found in enumerate(told):
        if not len(found):
            return at[:0]
        c = sketch.cells(h[at], row)
        at = at[found[np.minimum(np.searchsorted(found, c), len(found) - 1)] == c]
    return at


def _settled(h: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows also start in a document with a smaller id, of those given."""
    order = np.lexsort((check, h))
    starts, ends = runs(h[order], check[order])
    later = np.empty(len(h), bool)
    if len(h):
        ids = ids[order]
        later[order] = ids > np.repeat(np.minimum.reduceat(ids, starts), ends - starts)
    return later


_SENT = "part int, doc_id long, text_key long, data binary"
_SENT_SCHEMA = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("data", pa.binary())])
_SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def _by_document(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The places of each document as one packed row."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    starts, ends = runs(doc)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        d = doc[a]
        yield int(ids[d]), int(keys[d]), place[a:b].astype(np.uint32).tobytes()


def repeated_windows(chunks: DataFrame, answers: DataFrame, n: int, sketch: Sketch, parts: int) -> DataFrame:
    """(doc_id, text_key, spans): the starts of windows that a document with a smaller id has as well."""

    def met(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[np.ndarray]]]:
        """The documents of each chunk that got answers, with its cells counted twice; the answers come first."""
        chunk, lists, told = None, [[] for _ in range(ROWS)], None
        for batch in source:
            for at, part, data in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if at != chunk:
                    chunk, lists, told = at, [[] for _ in range(ROWS)], None
                if part == _TEXT:
                    told = told or [np.sort(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in lists]
                    if all(map(len, told)):
                        yield data.as_buffer(), told
                else:
                    row, part = divmod(part, sketch.parts)
                    lists[row].append(_places(_unpack(data.as_buffer(), np.uint8)[0]).astype(np.uint64) | (np.uint64(part) << np.uint64(32)))

    def mapped(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            ids, keys = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            h, check, place = (np.concatenate([x[i] for x in held]) for i in (2, 3, 5))
            doc = np.concatenate([x[4] + b for x, b in zip(held, base[:-1], strict=True)])
            later = _settled(h, check, ids[doc])
            rows = [(parts + (i + k) % SPREAD, i, k, data) for i, k, data in _by_document(ids, keys, doc[later], place[later])]
            at = np.flatnonzero(~later)
            part = (h[at] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, part = at[order], part[order]
            for a, b in zip(*(x.tolist() for x in runs(part)), strict=True):
                x = at[a:b]
                names, local = np.unique(doc[x], return_inverse=True)
                rows.append((int(part[a]), None, None, _pack(ids[names], keys[names], h[x], check[x], _planes(local), _planes(place[x]))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SENT_SCHEMA.types, strict=True)], schema=_SENT_SCHEMA) if rows else pa.RecordBatch.from_pylist([], schema=_SENT_SCHEMA)

        for data, told in met(source):
            ids, keys, texts = _documents(data)
            w = _Windows(texts, n)
            keep = estimated_repeated(w.h, told, sketch)
            if not len(keep):
                continue
            held.append((ids, keys, w.h[keep], w.check(keep), w.doc[keep], w.place[keep]))
            size += len(keep)
            if size >= GATHERED // 2:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def reduced(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            ids, keys, h, check, place = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 3, 5))
            doc = np.concatenate([(x[4] + b).astype(np.int32) for x, b in zip(held, base[:-1], strict=True)])
            held.clear()  # a part takes much of a task's memory
            later = _settled(h, check, ids[doc])
            rows = list(_by_document(ids, keys, doc[later], place[later]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPAN_SCHEMA.types, strict=True)], schema=_SPAN_SCHEMA)

        for batch in source:
            settled = batch.filter(pc.is_valid(batch.column("text_key")))
            if settled.num_rows:
                yield pa.record_batch([settled.column("doc_id"), settled.column("text_key"), settled.column("data")], schema=_SPAN_SCHEMA)
            open_rows = batch.filter(pc.is_null(batch.column("text_key")))
            for i, at in enumerate(open_rows.column("part").to_pylist()):
                if at != part:
                    yield from done()
                    part, held = at, []
                *held_, local, place = _unpack(open_rows.column("data")[i].as_buffer(), np.int64, np.int64, np.uint64, np.uint32, np.uint8, np.uint8)
                held.append((*held_, _whole(local), _whole(place)))
        yield from done()

    rows = answers.unionByName(chunks).withColumn("_text", F.col("part") == _TEXT)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "_text").drop("_text")
    return rows.mapInArrow(mapped, _SENT).repartition("part").sortWithinPartitions("part").mapInArrow(reduced, "doc_id long, text_key long, spans binary")


def found_spans(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, spans): for each document that loses words, the ranges of its windows to go."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(size // 6, 1)  # windows: words of five letters and a space
    sketch = Sketch.of(spark, expected)
    chunks = staged(chunked(docs), "chunks")
    found = repeated_windows(chunks, answered(sketched(chunks, n, sketch), sketch), n, sketch, parts_for(spark, expected, PART, LEAST_PART))
    spans = ranged(found, 1)
    discarded(chunks)
    return spans


def substrings_removed(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut; where words went, those that stay are joined by one space."""

    def cut(text: bytes, spans: bytes) -> bytes:
        words = text.split()
        return b" ".join(w for w, g in zip(words, covered(spans, n, len(words)).tolist(), strict=True) if not g)

    return with_cuts(docs, found_spans(docs, n), cut)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat 13 words of an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                n = len(words)
                if spans is not None:
                    gone = covered(spans, WINDOW, n)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    joined = joined_spans(docs, found_spans(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "spans")
    return joined.mapInArrow(made, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM t WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > first),
e AS (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM t),
k AS (SELECT e.doc_id, string_agg(w[e.p], ' ' ORDER BY e.p) FILTER (WHERE r.p IS NULL) AS kept, count(r.p) AS gone FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.p = e.p GROUP BY e.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op6_substring": op6_substring}
ORACLES = {"op6_substring": _ORACLE}
