"""Suffix-array dedup: bytes covered by strings that start earlier as well.

A string of ``LENGTH`` bytes that stands twice holds, in both places, the same
least hash among its ``GRAM``-byte grams, so its suffix from there starts with
the same gram. Only suffixes at such anchors (about one place in 35) are sorted:
a sampled suffix array that misses no repeated string.

1. Every task finds the anchors of its documents and sends, for each, the hash
   of the gram and a hash of all bytes that strings over the anchor can reach.
   Anchors whose reach is equal settle each other at once; of such a class only
   the earliest matters from then on. Classes within a task are settled there. The
   classes of one gram are dealt over ``SALTS`` parts, and each part tells of how
   many it has, if they are many.
2. Classes meet again by their gram. Where a gram has several, the bytes around
   each class's earliest anchor are fetched, and the suffixes to the right and the
   reversed prefixes to the left are sorted by deep-shallow sorting. Common prefixes
   of neighbours then tell, for each offset, which strings over the anchors are
   equal, and all but the earliest of those are repeats.
3. A gram with so many classes that they shouldn't meet in one task (a passage
   that a large share of all documents quotes) is known from the counts of the first
   step, so its classes never meet: each string over its anchors is sent by its own
   hash, and settled in its task first.

Bytes are compared, never only hashes of them, between different classes of the
second step; a class, and a string of the third step, is told by 128 bits.
Positions travel as packed arrays, in parts of the hash space whose number grows
with the corpus.

Defined results: null and empty texts, and those shorter than ``LENGTH``, lose
nothing; rows that repeat an id and text are one document and lose the same;
different texts under one id are ordered by a hash of the text; a null id is
later than all others; an empty table gives no rows. ``suffixes_removed`` keeps
all columns, and drops what a cut leaves of a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import batches, discarded, mixed, parts_for, runs, staged, table
from loupe.llm.deepshallow import common_prefixes, deep_shallow
from loupe.llm.op6_substring import _pack, _unpack
from loupe.llm.spans import BROADCAST_BYTES, LAST_ID, SPREAD, covered, gathered, joined_spans, ranged, with_cuts

LENGTH = 100
GRAM = 32
#: Grams of a string, and the bytes to the left of an anchor that a string over it can reach.
GRAMS = LENGTH - GRAM + 1
LEFT = GRAMS - 1
#: Anchors that a task gathers before it sends them, and those of a part: a task holds them some ten times over while it settles them.
GATHERED = 1 << 19
PART = 1 << 19
#: Contexts of a part of the second step.
CONTEXTS = 1 << 17
#: Anchors or contexts that make a part worth while.
LEAST_PART = 1 << 12
#: Classes of one gram from which its strings go separate ways instead of meeting in one task.
HOT = 1 << 16
#: Hot grams that may be told to all tasks; with more, HOT rises. Parts over which a gram's classes are dealt at first.
HOT_GRAMS, SALTS = 1 << 20, 64
#: Words of eight bytes that the quicksort orders, to the right and to the left.
SHALLOW_RIGHT, SHALLOW_LEFT = 6, 2

_TABLE = np.random.default_rng(20240117).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR, _OTHER_FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place; the array is GRAM - 1 shorter."""
    h, n = _TABLE[data], 1
    while n < GRAM:
        left = h[:-n] * _FACTOR
        left ^= left >> np.uint64(31)
        left += h[n:]
        left *= np.uint64(0xC4CEB9FE1A85EC53)
        left ^= left >> np.uint64(29)
        h, n = left, 2 * n
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of the documents joined in ``data`` and the hashes of all grams."""
    h = grams(data) if len(data) >= GRAM else np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return np.empty(0, np.int64), h
    low = _sliding(h, GRAMS, np.minimum)  # for each place of a string
    crossing = np.zeros(len(low) + LENGTH, bool)
    for end in offsets[1:-1].tolist():
        crossing[max(0, end - LENGTH + 1) : end] = True
    low[crossing[: len(low)]] = 0
    edge = np.zeros(LEFT, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), GRAMS, np.maximum)  # of the strings over each gram
    return np.flatnonzero((high == h) & (h != 0)), h


def _reach(data: bytes, h: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from LEFT before an anchor to LENGTH behind it, within its document."""
    out = np.zeros(len(at), np.uint64)
    full = (at - LEFT >= start) & (at + LENGTH <= end)
    first = at[full] - LEFT
    x = np.zeros(len(first), np.uint64)
    for step in (0, GRAM, 2 * GRAM, 3 * GRAM, 4 * GRAM, LEFT + LENGTH - GRAM):
        x = mixed(x * _FACTOR + h[first + step])
    out[full] = x
    cut = np.flatnonzero(~full)
    for i, p, a, b in zip(cut.tolist(), at[cut].tolist(), start[cut].tolist(), end[cut].tolist(), strict=True):
        a, b = max(a, p - LEFT), min(b, p + LENGTH)
        out[i] = xxhash.xxh3_64_intdigest(data[a:b], 1 + (p - a) * 256 + (b - p))
    return out


def _plain(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = b"".join(t or b"" for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])]).astype(np.int64)
    return data, np.frombuffer(data, np.uint8), offsets


class _Entries:
    """Anchors as columns: h, x, the document as a place in (ids, keys, sizes), and the place in it.

    Documents are ordered by id and key, so their places compare as they do.
    """

    def __init__(self, docs: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray, x: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        self.docs, self.h, self.x, self.doc, self.at = docs, h, x, doc, at

    def __len__(self) -> int:
        return len(self.h)

    @classmethod
    def joined(cls, parts: list[_Entries]) -> _Entries:
        ids, keys, sizes = (np.concatenate([p.docs[i] for p in parts]) for i in range(3))
        order = np.lexsort((keys, ids))
        starts, ends = runs(ids[order], keys[order])
        place = np.empty(len(ids), np.int32)
        place[order] = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
        base = np.cumsum([0, *(len(p.docs[0]) for p in parts)])
        doc = np.concatenate([place[p.doc + b] for p, b in zip(parts, base[:-1], strict=True)])
        first = order[starts]
        return cls((ids[first], keys[first], sizes[first]), *(np.concatenate([getattr(p, c) for p in parts]) for c in ("h", "x")), doc, np.concatenate([p.at for p in parts]))

    def take(self, which: np.ndarray) -> _Entries:
        return _Entries(self.docs, self.h[which], self.x[which], self.doc[which], self.at[which])

    def packed(self) -> bytes:
        used, local = np.unique(self.doc, return_inverse=True)
        return _pack(*(c[used] for c in self.docs), self.h, self.x, local.astype(np.uint32), self.at)

    @classmethod
    def unpacked(cls, data: bytes) -> _Entries:
        ids, keys, sizes, h, x, local, at = _unpack(data, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32)
        return cls((ids, keys, sizes), h, x, local.astype(np.int32), at)

    def sizes(self) -> np.ndarray:
        return self.docs[2][self.doc]

    def settled(self) -> tuple[_Entries, np.ndarray, np.ndarray]:
        """Themselves put in order, without repeats; which are later in their class, and how many classes their gram has."""
        e = self
        order = np.lexsort((e.at, e.doc, e.x, e.h))
        for column in ("h", "x", "doc", "at"):  # one after the other: a part takes much of a task's memory
            setattr(e, column, getattr(e, column)[order])
        del order
        new = np.ones(len(e), bool)
        new[1:] = (e.h[1:] != e.h[:-1]) | (e.x[1:] != e.x[:-1]) | (e.doc[1:] != e.doc[:-1]) | (e.at[1:] != e.at[:-1])
        e = e if new.all() else e.take(new)
        starts, _ = runs(e.h, e.x)
        later = np.ones(len(e), bool)
        later[starts] = False
        a, b = runs(e.h)
        classes = np.repeat(np.add.reduceat((~later).astype(np.int64), a), b - a) if len(a) else later.astype(np.int64)
        return e, later, classes


def _rows(e: _Entries, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(id, key, packed uint32 columns, row by row) for each document of the entries."""
    order = np.lexsort((e.at, e.doc))
    packed = np.stack(columns, 1).astype(np.uint32)[order]
    doc = e.doc[order]
    for a, b in zip(*(x.tolist() for x in runs(doc)), strict=True):
        yield int(e.docs[0][doc[a]]), int(e.docs[1][doc[a]]), packed[a:b].tobytes()


def _strings(e: _Entries) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings over each anchor."""
    at = e.at.astype(np.int64)
    return np.maximum(at - LEFT, 0), np.minimum(at, e.sizes() - LENGTH)


_SENT = "part long, kind int, doc_id long, text_key long, data binary"
_SCHEMA = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("data", pa.binary())])
#: Kinds of rows: packed entries; spans (first and last start) of a document; anchors whose bytes are wanted, and those
#: of hot grams; the number (text_key) of classes of a gram (doc_id) in one part.
_ENTRIES, _SPANS, _WANTED, _HOT, _COUNTED = 0, 1, 2, 3, 4


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))


def _dealt(e: _Entries, part: np.ndarray) -> Iterator[tuple]:
    """The entries as one packed row for each part."""
    order = np.argsort(part, kind="stable")
    e, part = e.take(order), part[order]
    for a, b in zip(*(x.tolist() for x in runs(part)), strict=True):
        yield int(part[a]), _ENTRIES, None, None, e.take(np.arange(a, b)).packed()


def _sliced(entries_of: Callable[[pa.RecordBatch, list[bytes | None]], _Entries | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[_Entries]]:
    def found(source: Iterator[pa.RecordBatch]) -> Iterator[_Entries]:
        for batch, texts in batches(source):
            e = entries_of(batch, texts)
            if e is not None and len(e):
                yield e

    return found


def _packed_entries(source: Iterator[pa.RecordBatch]) -> Iterator[_Entries]:
    for batch in source:
        for data in batch.column("data"):
            yield _Entries.unpacked(data.as_buffer())


_Rows = Iterator[tuple[int, int | None, int | None, bytes | None]]


def _exchanged(
    rows: DataFrame,
    entries: Callable[[Iterator[pa.RecordBatch]], Iterator[_Entries]],
    strings: Callable,
    deal: Callable[[_Entries], np.ndarray],
    told: Callable[[_Entries, np.ndarray], _Rows] | None = None,
    hot: np.ndarray | None = None,
) -> DataFrame:
    """Entries settled in their task and then by the parts to which they are dealt.

    Gives the spans (``strings``) of those that are later in their class, and the
    rows (kind, doc_id, text_key, data) ``told`` of the earliest ones and the number
    of classes of their grams. Entries of ``hot`` grams aren't dealt, but given as they are.
    """

    def mapped(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Entries] = []
        size = 0

        def sent() -> pa.RecordBatch:
            joined = _Entries.joined(held)
            held.clear()
            e, later, _ = joined.settled()
            gone = e.take(later)
            rows = [(-1 - (i + key) % SPREAD, _SPANS, i, key, data) for i, key, data in _rows(gone, *strings(gone))]
            e = e.take(~later)
            if hot is not None:
                out = np.isin(e.h, hot)
                aside = e.take(out)
                rows += [(-1 - (i + key) % SPREAD, _HOT, i, key, data) for i, key, data in _rows(aside, aside.at)]
                e = e.take(~out)
            rows += _dealt(e, deal(e))
            return _batch(rows)

        for found in entries(source):
            held.append(found)
            size += len(found)
            del found
            if size >= GATHERED:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def reduced(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                joined = _Entries.joined(held)
                held.clear()
                e, later, classes = joined.settled()
                gone = e.take(later)
                rows = [(part, _SPANS, *r) for r in _rows(gone, *strings(gone))]
                if told is not None:
                    rows += [(part, *r) for r in told(e.take(~later), classes[~later])]
                if rows:
                    yield _batch(rows)

        for batch in source:
            open_rows = pc.equal(batch.column("kind"), _ENTRIES)
            if (given := batch.filter(pc.invert(open_rows))).num_rows:
                yield given
            parts, packed = batch.column("part").to_pylist(), batch.column("data")  # not filtered: a batch may be all that a task reads
            for i in np.flatnonzero(open_rows.to_numpy(zero_copy_only=False)).tolist():
                if (at := parts[i]) != part:
                    yield from done()
                    part, held = at, []
                held.append(_Entries.unpacked(packed[i].as_buffer()))
        yield from done()

    return rows.mapInArrow(mapped, _SENT).repartition("part").sortWithinPartitions("part").mapInArrow(reduced, _SENT)


def classed_anchors(docs: DataFrame, parts: int, hot: int) -> DataFrame:
    """Spans of what is settled by classes, the earliest anchor of each class, and counts of grams that may be hot."""
    salts = np.uint64(min(SALTS, parts))
    least = max(hot // (2 * int(salts)), 1)  # a gram with ``hot`` classes has half of them at least in parts that count them

    def found(batch: pa.RecordBatch, texts: list[bytes | None]) -> _Entries | None:
        data, joined, offsets = _plain(texts)
        at, h = anchors(joined, offsets)
        if not len(at):
            return None
        doc = np.searchsorted(offsets, at, "right") - 1
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
        start, end = offsets[doc], offsets[doc + 1]
        return _Entries((ids, keys, np.diff(offsets)), h[at], _reach(data, h, at, start, end), doc.astype(np.int32), (at - start).astype(np.uint32))

    def told(e: _Entries, classes: np.ndarray) -> _Rows:
        if len(e):
            yield _ENTRIES, None, None, e.packed()
        a, b = runs(e.h)
        for i in np.flatnonzero(b - a >= least).tolist():
            yield _COUNTED, int(e.h[a[i]].view(np.int64)), int(b[i] - a[i]), None

    def deal(e: _Entries) -> np.ndarray:
        return ((e.h % np.uint64(parts) + e.x % salts) % np.uint64(parts)).astype(np.int64)

    return _exchanged(_named(docs), _sliced(found), _strings, deal, told)


def hot_grams(classed: DataFrame, hot: int) -> np.ndarray:
    """The grams with half of ``hot`` classes or more, all with ``hot`` among them; no more than twice the classes over ``hot``."""
    counts = classed.where(F.col("kind") == _COUNTED).groupBy("doc_id").agg(F.sum("text_key").alias("n")).where(F.col("n") >= hot / 2)
    return np.array([r["doc_id"] for r in counts.select("doc_id").toLocalIterator()], np.int64).view(np.uint64)


def met_anchors(classed: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """The anchors whose bytes are wanted, as their gram has several classes, and those of hot grams."""

    def told(e: _Entries, classes: np.ndarray) -> _Rows:
        wanted = e.take(classes > 1)
        for r in _rows(wanted, wanted.at):
            yield _WANTED, *r

    return _exchanged(classed.where(F.col("kind") == _ENTRIES), _packed_entries, _strings, lambda e: (e.h % np.uint64(parts)).astype(np.int64), told, hot)


def _with_places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, spans): the documents with the packed places wanted of them."""
    named = _named(docs).withColumnsRenamed({"doc_id": "doc", "text_key": "key"})
    one = gathered(wanted.select("doc_id", "text_key", F.col("data").alias("spans")))
    small = (wanted.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = named.join(F.broadcast(one) if small else one, (named["doc"] == one["doc_id"]) & (named["key"] == one["text_key"]))
    return joined.select("doc_id", "text_key", "text", "spans")


def hot_strings(docs: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Spans of repeated strings over anchors of hot grams: each string goes its own way, by 128 bits of hashes."""

    def found(batch: pa.RecordBatch, texts: list[bytes | None]) -> _Entries | None:
        made = []
        for i, (text, places) in enumerate(zip(texts, batch.column("spans").to_pylist(), strict=True)):
            at = np.frombuffer(b"".join(places), np.uint32).astype(np.int64)
            n = len(text)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.maximum(at - LEFT, 0), 1)
            np.add.at(edge, np.minimum(at, n - LENGTH) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge) > 0)
            h = grams(np.frombuffer(text, np.uint8))
            x, y = np.zeros(len(starts), np.uint64), np.ones(len(starts), np.uint64)
            for step in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
                x, y = mixed(x * _FACTOR + h[starts + step]), mixed(y * _OTHER_FACTOR ^ h[starts + step])
            doc = (np.array([batch.column("doc_id")[i].as_py()]), np.array([batch.column("text_key")[i].as_py()]), np.array([n]))
            made.append(_Entries(doc, x, y, np.zeros(len(starts), np.int32), starts.astype(np.uint32)))
        return _Entries.joined(made) if made else None

    return _exchanged(_with_places(docs, hot), _sliced(found), lambda e: (e.at, e.at), lambda e: (e.h % np.uint64(parts)).astype(np.int64))


def contexts(docs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(part, data): the wanted anchors with the bytes around them, as packed entries."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sent() -> pa.RecordBatch:
            e = _Entries.joined([x for x, _ in held])
            around = np.concatenate([y for _, y in held])
            part = (e.h % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((e.h, part))  # like bytes together: they compress
            e, around, part = e.take(order), around[order], part[order]
            rows = [(int(part[a]), _ENTRIES, None, None, _pack(np.frombuffer(e.take(np.arange(a, b)).packed(), np.uint8), around[a:b])) for a, b in zip(*(x.tolist() for x in runs(part)), strict=True)]
            return _batch(rows)

        for batch, texts in batches(source):
            for i, (text, places) in enumerate(zip(texts, batch.column("spans").to_pylist(), strict=True)):
                at = np.unique(np.frombuffer(b"".join(places), np.uint32)).astype(np.int64)
                data = np.frombuffer(text, np.uint8)
                # UTF-8 has no byte above 0xF4: one more leaves 0 for what is outside the document
                padded = np.concatenate([np.zeros(LEFT, np.uint8), data + np.uint8(1), np.zeros(LENGTH, np.uint8)])
                around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[at]
                doc_id, key = batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py()
                docs_ = (np.array([doc_id]), np.array([key]), np.array([len(data)]))
                held.append((_Entries(docs_, grams(data)[at], np.zeros(len(at), np.uint64), np.zeros(len(at), np.int32), at.astype(np.uint32)), around))
                size += len(at)
            if size >= GATHERED // 4:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    return _with_places(docs, wanted).mapInArrow(made, _SENT)


def _classes(order: np.ndarray, prefixes: np.ndarray, group_changes: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that are equal for suffixes of one group with equal first ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum((prefixes < depth) | group_changes)
    return out


def repeated_starts(e: _Entries, around: np.ndarray) -> tuple[_Entries, np.ndarray, np.ndarray, np.ndarray]:
    """The entries by document and place, and runs (entry, first and last start) of strings over them that an earlier entry holds at the same offset.

    There are up to GRAMS strings an entry, so each is a bit of a table and only their runs become rows.
    """
    by = np.lexsort((e.at, e.doc))  # from here, earlier is smaller
    e, around = e.take(by), around[by]
    place, size = e.at.astype(np.int64), e.sizes()
    _, group = np.unique(e.h, return_inverse=True)
    sides = []
    for right, shallow in ((True, SHALLOW_RIGHT), (False, SHALLOW_LEFT)):
        rows = np.ascontiguousarray(around[:, LEFT:] if right else around[:, :LEFT][:, ::-1])
        order = deep_shallow(group, rows, shallow)
        changes = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        sides.append((order, common_prefixes(order, rows), changes))
    del around, rows
    gone = np.zeros((len(e), GRAMS), bool)  # by start: a column more is a byte on
    for offset in range(GRAMS):
        fits = np.flatnonzero((place >= offset) & (place - offset + LENGTH <= size))
        if len(fits) < 2:
            continue
        key = _classes(*sides[0], LENGTH - offset)[fits] * (len(e) + 1) + _classes(*sides[1], offset)[fits]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(fits), bool)
        later[first] = False
        gone[fits[later], LEFT - offset] = True
    edge = gone.copy()
    edge[:, 1:] &= ~gone[:, :-1]
    who, first = np.nonzero(edge)
    edge[:] = gone
    edge[:, :-1] &= ~gone[:, 1:]
    last = np.nonzero(edge)[1]
    return e, who, place[who] - LEFT + first, place[who] - LEFT + last


def _merged(e: _Entries, first: np.ndarray, last: np.ndarray) -> tuple[_Entries, np.ndarray, np.ndarray]:
    """Runs of starts (first, last) in the documents of the entries, as the fewest."""
    order = np.lexsort((first, e.doc))
    e, first = e.take(order), first[order]
    base = e.doc.astype(np.int64) << 32  # a place has 32 bits: no run reaches into the next document
    end = np.maximum.accumulate(base + last[order])
    new = np.ones(len(first), bool)
    new[1:] = (e.doc[1:] != e.doc[:-1]) | (base[1:] + first[1:] > end[:-1] + 1)
    a = np.flatnonzero(new)
    ends = (end - base)[np.append(a[1:], len(first)) - 1] if len(a) else last
    return e.take(a), first[a], ends


def compared(sent: DataFrame) -> DataFrame:
    """Spans of the strings that are repeats among the contexts."""

    def reduced(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            e, around = _Entries.joined([x for x, _ in held]), [y for _, y in held]
            held.clear()
            e, who, first, last = repeated_starts(e, np.concatenate(around))
            gone, first, last = _merged(e.take(who), first, last)
            gone.at = first
            if rows := [(part, _SPANS, *r) for r in _rows(gone, first, last)]:
                yield _batch(rows)

        for batch in source:
            for i, at in enumerate(batch.column("part").to_pylist()):
                if at != part:
                    yield from done()
                    part, held = at, []
                packed, around = _unpack(batch.column("data")[i].as_buffer(), np.uint8, np.uint8)
                held.append((_Entries.unpacked(packed.tobytes()), around.reshape(-1, LEFT + LENGTH)))
        yield from done()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(reduced, _SENT)


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): for each document that loses bytes, the ranges of its repeated strings' starts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(size, 1) * 2 // (GRAMS + 1)
    parts, least = parts_for(spark, expected, PART, LEAST_PART), max(HOT, expected // HOT_GRAMS)
    classed = staged(classed_anchors(docs, parts, least), "suffix-classes")
    met = staged(met_anchors(classed, hot_grams(classed, least), parts), "suffix-anchors")
    wanted, hot = (met.where(F.col("kind") == k) for k in (_WANTED, _HOT))
    n = (wanted.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // 4
    both = classed.where(F.col("kind") == _SPANS).unionByName(compared(contexts(docs, wanted, parts_for(spark, n, CONTEXTS, LEAST_PART))))
    n = (hot.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // 4
    if n:
        both = both.unionByName(hot_strings(docs, hot, parts_for(spark, n * GRAMS, PART, LEAST_PART)))
    spans = ranged(both.select("doc_id", "text_key", F.col("data").alias("spans")), 2)
    discarded(classed, met)
    return spans


def suffixes_removed(docs: DataFrame) -> DataFrame:
    """The documents without repeated bytes."""

    def cut(text: bytes, spans: bytes) -> bytes:
        return np.frombuffer(text, np.uint8)[~covered(spans, LENGTH, len(text))].tobytes().decode(errors="ignore").encode()

    return with_cuts(docs, found_spans(docs), cut)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a string of 100 bytes starting earlier as well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True):
                text, n_spans, n = text or b"", 0, len(text or b"")
                if spans is not None:
                    gone = covered(spans, LENGTH, n)
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc_id, n, n - len(text), n_spans, hashlib.sha256(text).hexdigest()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    joined = joined_spans(docs, found_spans(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "spans")
    return joined.mapInArrow(made, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_ORACLE = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 - 99 AS BIGINT))) AS i FROM t WHERE length(x) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM m),
v AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, s),
p AS (SELECT v.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM v),
k AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM p JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op4_suffix": op4_suffix}
ORACLES = {"op4_suffix": _ORACLE}
