"""WARC archives as chunked record tables.

``write_archives`` turns pages into WARC 1.1 records and stores the byte stream
of each archive as rows (archive, chunk, data) of at most ``CHUNK`` bytes, in
order; ``read_archives`` streams those rows, parses the records and passes each
payload on as rows (archive, record, chunk, data) with the digest so far, so no
more than one chunk is held, however large a record is. ``read_records`` folds
the digests of the last chunks into a row for each record.

The reader takes archives of others as well: headers in any case and folded, any
record type, HTTP headers of any length up to a limit, archives of gzip members.
Where a record names a SHA-1 of its payload, ``digest_ok`` says whether the bytes
read have it. What can't be read is a row with an ``error``; after a broken gzip
member or header the rest of its archive isn't read.

Of records with one payload of at least ``least`` bytes, the one with the
smallest page id is a response and carries the payload; the others are revisits
that carry its digest and length and name the response.

Defined results: a null html is an empty payload; a null url stays null; page
ids that repeat with the smallest id of a payload are all responses; a null
page id counts as larger than any other, and payloads known under no other id
are responses; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import join_counted, staged, table

CHUNK = 1 << 18
#: Bytes after which a writer begins another archive.
ARCHIVE = 1 << 24
_HEAD_LIMIT = 1 << 16
#: Revisits that are looked up by a broadcast; beyond, payloads are shuffled to meet them.
BROADCAST_ROWS = 1 << 20

_ARCHIVE_SCHEMA = pa.schema([("archive", pa.string()), ("chunk", pa.int64()), ("data", pa.binary())])
_RECORD = "archive string, record long, chunk long, data binary, last boolean, digest_so_far string, bytes_so_far long, record_id string, page_id long, url string, record_type string, refers_to long, refers_to_id string, payload_digest string, payload_bytes long, error string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_RECORD_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in _RECORD.split(", "))])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(s: str) -> str:
    """A header value on one line: anything else is percent-encoded, reversibly."""
    return "".join(c if " " < c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in s)


def _unline(s: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), s.encode()).decode()


def _uri(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", uri or "")
    return int(found[1]) if found else None


def _head(page: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines += [f"WARC-Target-URI: {_line(url)}", "X-Escaped: WARC-Target-URI"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    length = len(_HTTP) + (size if kind == "response" else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + _HTTP


def _stream(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | memoryview]]:
    """Each archive's name with its bytes, piece by piece. A task that is run again gives the same names."""
    name, written, count, task = None, 0, 0, TaskContext.get().partitionId()
    for batch in source:
        columns = [batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "digest", "size")]
        html = batch.column("html").cast(pa.large_binary())
        for i in range(batch.num_rows):
            page, url, kind, refers_to, digest, size = (c[i].as_py() for c in columns)
            head = _head(page, url, kind, refers_to, digest, size)
            if name is None or written >= ARCHIVE:
                name, written, count = f"{task:06d}-{count:06d}-{hashlib.sha1(head).hexdigest()[:12]}", 0, count + 1
            yield name, head
            if kind == "response" and size:
                yield name, memoryview(html[i].as_buffer())
            yield name, b"\r\n\r\n"
            written += len(head) + (size if kind == "response" else 0) + 4


def _chunked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, number, held = None, 0, bytearray()

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([name]), pa.array([number], pa.int64()), pa.array([bytes(held)], pa.binary())], schema=_ARCHIVE_SCHEMA)

    for of, data in _stream(source):
        if of != name:
            if held:
                yield row()
            name, number, held = of, 0, bytearray()
        view = memoryview(data)
        while len(view):
            room = CHUNK - len(held)
            held += view[:room]
            view = view[room:]
            if len(held) == CHUNK:
                yield row()
                number, held = number + 1, bytearray()
    if held:
        yield row()


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, size, digest (base32), record_type and refers_to of every page."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha1(html)).alias("sha"))
    firsts = whole.where(F.col("size") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    repeated = staged(firsts.where("n > 1 and first is not null"), "warc-repeated")
    # only repeated payloads are looked up, by page; unique pages go straight to their archive
    narrow = staged(whole.select("page_id", "sha", "size"), "warc-digests")
    total = narrow.count()
    revisits = join_counted(narrow.where(F.col("size") >= least), repeated, "sha", total).where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    revisits = staged(revisits.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:  # 36 bytes each: payloads stay where they are read
        revisits = F.broadcast(revisits)
    joined = whole.join(revisits, whole["page_id"].eqNullSafe(revisits["_page"]) & (whole["sha"] == revisits["_sha"]), "left")
    return joined.select("page_id", "url", "html", "size", "sha", "refers_to", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"))


def write_archives(records: DataFrame) -> DataFrame:
    """The archives of decided() pages: archive, chunk, data, in the shared folder."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[pa.RecordBatch]:
            for b in source:
                digests = pa.array([_base32(x) for x in b.column("sha").to_pylist()], pa.string())
                yield b.append_column("digest", digests)

        yield from _chunked(named())

    light = records.withColumn("html", F.when(F.col("record_type") == "response", F.col("html")))
    return staged(light.mapInArrow(made, "archive string, chunk long, data binary"), "warc")


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            name = name.lower()
            out[name] = value
    return out


def _blank_line(data: bytes) -> tuple[int, int]:
    """Where a header ends and where what follows begins; (-1, -1) if that isn't there yet."""
    found = [(at, at + len(end)) for end in (b"\r\n\r\n", b"\n\n") if (at := data.find(end)) >= 0]
    return min(found, default=(-1, -1))


class _Broken(Exception):
    """An archive that can't be read on."""


class _Inflater:
    """The bytes of gzip members, a chunk at a time."""

    def __init__(self) -> None:
        self._member = zlib.decompressobj(31)
        self._fresh = True

    def pieces(self, data: bytes) -> Iterator[bytes]:
        while data:
            if self._member.eof:
                self._member, self._fresh = zlib.decompressobj(31), True
            try:
                out = self._member.decompress(data, CHUNK)
            except zlib.error as error:
                raise _Broken(f"a gzip member is broken: {error}") from error
            self._fresh = False
            data = self._member.unused_data if self._member.eof else self._member.unconsumed_tail
            if out:
                yield out

    @property
    def whole(self) -> bool:
        return self._fresh or self._member.eof


class _Reader:
    """Parses the chunks of one archive after another, holding a chunk at most besides a header."""

    def __init__(self) -> None:
        self.archive: str | None = None
        self._begin(None)

    def _begin(self, archive: str | None) -> None:
        self.archive, self.held, self.record, self.count, self.inflater, self.broken = archive, b"", None, 0, None, False

    def _header(self, raw: bytes) -> dict:
        version, _, rest = raw.partition(b"\n")
        h = _headers(rest)
        if not re.fullmatch(rb"WARC/\d+\.\d+\s*", version) or not h.get("content-length", "").isdigit():
            raise _Broken("no record where one should begin")
        url, digest = h.get("warc-target-uri"), h.get("warc-payload-digest", "")
        if url is not None:
            url = _unline(url) if h.get("x-escaped") == "WARC-Target-URI" else url.removeprefix("<").removesuffix(">")
        named = {"record_id": h.get("warc-record-id"), "page_id": _page(h.get("warc-record-id")), "url": url, "record_type": h.get("warc-type"), "refers_to": _page(h.get("warc-refers-to")), "refers_to_id": h.get("warc-refers-to")}
        size = h.get("x-payload-length", "")
        return named | {
            "payload_digest": digest[5:].upper() if digest.lower().startswith("sha1:") else None,
            "payload_bytes": int(size) if size.isdigit() else None,
            "record": self.count, "chunk": 0, "left": int(h["content-length"]), "http": h.get("content-type", "").lower().startswith("application/http"), "sha": hashlib.sha1(), "seen": 0,
        }

    def _row(self, data: bytes, last: bool, error: str | None = None) -> dict:
        r = self.record
        r["sha"].update(data)
        r["seen"] += len(data)
        row = {k: r[k] for k in ("record", "chunk", "record_id", "page_id", "url", "record_type", "refers_to", "refers_to_id", "payload_digest", "payload_bytes")}
        r["chunk"] += 1
        return row | {"archive": self.archive, "data": data, "last": last, "digest_so_far": _base32(r["sha"].digest()), "bytes_so_far": r["seen"], "error": error}

    def _failed(self, why: str) -> dict:
        self.broken = True
        if self.record is not None:
            row, self.record = self._row(b"", True, why), None
            return row
        return dict.fromkeys(_RECORD_SCHEMA.names) | {"archive": self.archive, "record": self.count, "chunk": 0, "last": True, "error": why}

    def feed(self, archive: str, data: bytes) -> Iterator[dict]:
        if archive != self.archive:
            yield from self.close()
            self._begin(archive)
            if data[:2] == b"\x1f\x8b":
                self.inflater = _Inflater()
        if self.broken:
            return
        try:
            for piece in self.inflater.pieces(data) if self.inflater else (data,):
                self.held = self.held + piece if self.held else piece
                yield from self._parsed()
        except _Broken as error:
            yield self._failed(str(error))

    def _parsed(self) -> Iterator[dict]:
        while True:
            if self.record is None:
                self.held = self.held.lstrip(b"\r\n")
                end, after = _blank_line(self.held)
                if end < 0:
                    if len(self.held) > _HEAD_LIMIT:
                        raise _Broken("a record's header doesn't end")
                    return
                self.record = self._header(self.held[:end])
                self.held = self.held[after:]
                self.count += 1
            r = self.record
            if r["http"]:
                block = self.held[: r["left"]]
                end, after = _blank_line(block)
                if end < 0 and len(block) < min(r["left"], _HEAD_LIMIT):
                    return
                r["http"] = False
                if end >= 0:
                    r["left"], self.held = r["left"] - after, self.held[after:]
            if r["left"] > len(self.held):
                if self.held:
                    r["left"] -= len(self.held)
                    part, self.held = self.held, b""
                    yield self._row(part, False)
                return
            part, self.held = self.held[: r["left"]], self.held[r["left"] :]
            yield self._row(part, True)
            self.record = None

    def close(self) -> Iterator[dict]:
        """A row if the archive ends too early."""
        if self.archive is not None and not self.broken and (self.record is not None or self.held.strip(b"\r\n") or (self.inflater and not self.inflater.whole)):
            yield self._failed("the archive ends within a record")


def read_archives(archives: DataFrame) -> DataFrame:
    """Each record's payload as chunk rows with the digest and length so far."""

    def parsed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in source:
            names, data = batch.column("archive"), batch.column("data")
            for i in range(batch.num_rows):
                if rows := list(reader.feed(names[i].as_py(), data[i].as_py())):
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)
        if rows := list(reader.close()):
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)

    ordered = archives.select("archive", "chunk", "data").repartition(F.col("archive")).sortWithinPartitions("archive", "chunk")
    return ordered.mapInArrow(parsed, _RECORD)


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each record and each error; a payload's digest and length are those of the bytes read, except for revisits."""
    last = read_archives(archives).where("last").drop("data")
    full = (F.col("record_type") != "revisit") & F.col("error").isNull()
    return last.select(
        "archive",
        "record",
        "record_id",
        "page_id",
        "url",
        F.when(full, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "refers_to_id",
        F.when(full, F.col("payload_digest") == F.col("digest_so_far")).alias("digest_ok"),
        "error",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    found = read_records(write_archives(decided(table(spark, sf_dir, "pages"), 0)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "error")


_ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
t AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> (5 * (3 - j))) & 31 AS BIGINT) + 1, 1), '' ORDER BY i, j) AS digest
      FROM (SELECT DISTINCT h FROM p), (SELECT unnest(range(8)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
  CASE WHEN page_id = first THEN true END AS digest_ok, CAST(NULL AS VARCHAR) AS error
FROM p JOIN f USING (h) JOIN t USING (h)
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": _ORACLE}
