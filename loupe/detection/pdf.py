"""PDF: cross references, object streams and the Info dictionary, within budgets; a lexical reader where these fail."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

from loupe.detection.markup import protected
from loupe.detection.model import Artifact, Incomplete, Observation, Options

# The keys reported, and budgets of a document.
INFO = ("Author", "Creator", "Producer", "CreationDate", "ModDate", "Title", "Subject", "Keywords")
MAX_OBJECTS, MAX_INFLATED, MAX_STREAM, MAX_SECTIONS, MAX_DEPTH, MAX_TOKENS = 50_000, 64 << 20, 16 << 20, 64, 32, 2_000_000

_SPACE = rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*"
_TOKEN = re.compile(_SPACE + rb"(?:(?P<open><<|\[)|(?P<close>>>|\])|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<string>\()|<(?P<hex>[^>]*)>|(?P<ref>\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+))")
_HEADER = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_LITERAL = re.compile(rb"[^()\\]+|\\.|[()]", re.S)
_ENTRY = re.compile(rb"\s*(\d{10})\s+(\d{5})\s+([nf])")


class Broken(ValueError):
    """A document that can't be read as an object graph, or not within its budgets."""


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    head: dict[str, Any]
    raw: bytes


class Pdf:
    """A document's objects, read when they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.tokens, self.objects, self.inflated = data, 0, 0, 0
        self.places: dict[int, tuple[bool, int, int]] = {}  # in a stream or not, where, which
        self.trailer: dict[str, Any] = {}
        self._known: dict[int, Any] = {}
        self._held: dict[int, list[Any]] = {}
        self._sections()

    # -- values

    def value(self, data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
        """The value that begins at a place, and where it ends. A closing bracket is itself."""
        self.tokens += 1
        if depth > MAX_DEPTH or self.tokens > MAX_TOKENS:
            raise Broken("too deep or too long")
        m = _TOKEN.match(data, at)
        if m is None:
            raise Broken("no value")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "name":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), text).decode("latin-1")), m.end()
        if kind == "string":
            return self._literal(data, m.end())
        if kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", text)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), m.end()
        if kind == "ref":
            return Ref(int(text.split()[0])), m.end()
        if kind == "open":
            return self._group(data, m.end(), text, depth)
        if kind == "close":
            return text, m.end()
        if text in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[text], m.end()
        try:
            return int(text) if text.isdigit() else float(text), m.end()
        except ValueError:
            raise Broken("no number") from None

    def _group(self, data: bytes, at: int, opening: bytes, depth: int) -> tuple[Any, int]:
        items: list[Any] = []
        close = b">>" if opening == b"<<" else b"]"
        while True:
            m = re.compile(_SPACE + rb"(>>|\])").match(data, at)
            if m and m[1] == close:
                at = m.end()
                break
            if m:
                raise Broken("brackets cross")
            item, at = self.value(data, at, depth + 1)
            items.append(item)
        if close == b"]":
            return items, at
        if len(items) % 2 or not all(isinstance(k, Name) for k in items[::2]):
            raise Broken("no dictionary")
        return dict(zip(items[::2], items[1::2], strict=True)), at

    def _literal(self, data: bytes, at: int) -> tuple[bytes, int]:
        out, depth = bytearray(), 1
        for m in _LITERAL.finditer(data, at):
            piece = m[0]
            depth += (piece == b"(") - (piece == b")")
            if not depth:
                return bytes(out), m.end()
            out += piece[1:] if piece[:1] == b"\\" else piece
            if len(out) > MAX_STREAM:
                break
        raise Broken("a string doesn't end")

    # -- objects

    def _object(self, at: int) -> Any:
        head = _HEADER.search(self.data, at, at + 64)
        if head is None:
            raise Broken("no object")
        value, end = self.value(self.data, head.end())
        m = re.compile(_SPACE + rb"stream(\r\n|\n|\r)?").match(self.data, end)
        if m is None or not isinstance(value, dict):
            return value
        size = self.resolved(value.get("Length"))
        end = m.end() + size if isinstance(size, int) and 0 <= size <= len(self.data) - m.end() else self.data.find(b"endstream", m.end())
        if end < 0 or end - m.end() > MAX_STREAM:
            raise Broken("a stream doesn't end within the budget")
        return Stream(value, self.data[m.end() : end])

    def resolved(self, value: Any) -> Any:
        seen: set[int] = set()
        while isinstance(value, Ref):
            if value.number in seen or len(seen) > MAX_DEPTH:
                raise Broken("references run in a circle")
            seen.add(value.number)
            value = self._fetched(value.number)
        return value

    def _fetched(self, number: int) -> Any:
        if number in self._known or number not in self.places:
            return self._known.get(number)
        self.objects += 1
        if self.objects > MAX_OBJECTS:
            raise Broken("too many objects")
        packed, where, which = self.places[number]
        if packed:
            held = self._packed(where)
            value = held[which] if which < len(held) else None
        else:
            value = self._object(where)
        self._known[number] = value
        return value

    def _packed(self, container: int) -> list[Any]:
        if container not in self._held:
            self._held[container] = []
            stream = self._fetched(container)
            if isinstance(stream, Stream):
                data = self.decoded(stream)
                count, first = (self.resolved(stream.head.get(k)) for k in ("N", "First"))
                numbers = data[:first].split() if isinstance(first, int) else []
                if not isinstance(count, int) or count > MAX_OBJECTS or len(numbers) < 2 * count:
                    raise Broken("an object stream without a usable head")
                self._held[container] = [self.value(data, first + int(numbers[2 * i + 1]))[0] for i in range(count)]
        return self._held[container]

    def decoded(self, stream: Stream) -> bytes:
        """A stream's bytes; only filters that lose nothing are undone, others are refused."""
        data, filters = stream.raw, self.resolved(stream.head.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters is not None else []:
            if name in ("FlateDecode", "Fl"):
                try:
                    data = zlib.decompressobj().decompress(data, MAX_STREAM + 1)
                except zlib.error as error:
                    raise Broken(str(error)) from error
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise Broken(f"filter {name}")
            self.inflated += len(data)
            if len(data) > MAX_STREAM or self.inflated > MAX_INFLATED:
                raise Broken("streams inflate beyond the budget")
        return self._unpredicted(data, self.resolved(stream.head.get("DecodeParms")))

    def _unpredicted(self, data: bytes, how: Any) -> bytes:
        kind = self.resolved(how.get("Predictor")) if isinstance(how, dict) else None
        if not isinstance(kind, int) or kind < 10:
            return data
        columns, colours, bits = (self.resolved(how.get(k)) or d for k, d in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8)))
        width = (columns * colours * bits + 7) // 8
        if not 0 < width <= MAX_STREAM:
            raise Broken("a predictor's row")
        out, above = bytearray(), bytes(width)
        for at in range(0, len(data) - width, width + 1):
            row = data[at + 1 : at + 1 + width]
            if data[at] == 2:
                row = bytes((x + y) & 255 for x, y in zip(row, above, strict=True))
            elif data[at]:
                raise Broken("a predictor")
            out += row
            above = row
        return bytes(out)

    # -- cross references

    def _sections(self) -> None:
        """All sections from the last one back; what a newer one says stands."""
        tail = self.data[-2048:]
        m = re.compile(rb"startxref\s*(\d+)").search(tail, max(tail.rfind(b"startxref"), 0))
        if m is None:
            raise Broken("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if not at or at in seen:
                continue
            if len(seen) >= MAX_SECTIONS or at >= len(self.data):
                break
            seen.add(at)
            try:
                said = self._table(at) if re.compile(_SPACE + rb"xref").match(self.data, at) else self._table_stream(at)
            except Broken:
                if not self.trailer:
                    raise
                break
            for key, value in said.items():
                self.trailer.setdefault(key, value)
            todo += [x for x in (said.get("XRefStm"), said.get("Prev")) if isinstance(x, int)]

    def _table(self, at: int) -> dict[str, Any]:
        at = self.data.index(b"xref", at) + 4
        while m := re.compile(rb"\s*(\d+)\s+(\d+)\s*").match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            if count > MAX_OBJECTS:
                raise Broken("a table of too many objects")
            for i in range(count):
                entry = _ENTRY.match(self.data, at)
                if entry is None:
                    raise Broken("a table's entry")
                if entry[3] == b"n":
                    self.places.setdefault(first + i, (False, int(entry[1]), 0))
                at += 20
        at = self.data.find(b"trailer", at)
        said = self.value(self.data, at + 7)[0] if at >= 0 else None
        if not isinstance(said, dict):
            raise Broken("no trailer")
        return said

    def _table_stream(self, at: int) -> dict[str, Any]:
        stream = self._object(at)
        if not isinstance(stream, Stream) or stream.head.get("Type") != "XRef":
            raise Broken("no cross-reference stream")
        widths, index = stream.head.get("W"), stream.head.get("Index") or [0, stream.head.get("Size")]
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and w >= 0 for w in widths) or not all(isinstance(i, int) for i in index):
            raise Broken("a cross-reference stream's fields")
        data, at, row = self.decoded(stream), 0, sum(widths[:3])
        for first, count in zip(index[::2], index[1::2], strict=False):
            if not row or count > MAX_OBJECTS or at + row * count > len(data):
                raise Broken("a cross-reference stream's length")
            for i in range(count):
                fields = []
                for w in widths[:3]:
                    fields.append(int.from_bytes(data[at : at + w]))
                    at += w
                kind = fields[0] if widths[0] else 1
                if kind in (1, 2):
                    self.places.setdefault(first + i, (kind == 2, fields[1], fields[2]))
        return stream.head


def text_of(value: Any) -> str:
    if isinstance(value, bytes):
        return value.decode("utf-16" if value[:2] in (b"\xfe\xff", b"\xff\xfe") else "utf-8", "replace").strip()
    return str(value)


_PAIR = re.compile(rb"/(" + "|".join(INFO).encode() + rb")\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]+>)")


def _last_object(data: bytes, ref: re.Match[bytes] | None, before: int) -> tuple[bytes, int]:
    """The body of the last object of a number before a place, and where it begins."""
    if ref is not None:
        found = list(re.finditer(rb"(?:^|[\r\n\t ])" + ref[1] + rb"\s+" + ref[2] + rb"\s+obj\b", data[:before], re.M))
        if found and (end := data.find(b"endobj", found[-1].end(), before)) >= 0:
            return data[found[-1].end() : end], found[-1].end()
    return b"", 0


def _trailer(data: bytes) -> tuple[bytes, int]:
    start = data.rfind(b"trailer")
    end = data.find(b"startxref", start)
    return (data[start : end if end >= 0 else len(data)], start) if start >= 0 else (b"", 0)


def lexical_info(data: bytes) -> Iterator[tuple[str, str, int]]:
    """Info of the last trailer by its text: in an object of its own, or in place."""
    trailer, start = _trailer(data)
    ref = re.search(rb"/Info\s+(\d+)\s+(\d+)\s+R\b", trailer)
    if ref:
        body, at = _last_object(data, ref, start)
    else:
        m = re.search(rb"/Info\s*<<", trailer)
        close = trailer.find(b">>", m.end()) if m else -1
        body, at = (trailer[m.end() : close], start + m.end()) if m and close >= 0 else (b"", 0)
    for m in _PAIR.finditer(body):
        raw = m[2]
        value = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode()).decode("utf-8", "replace") if raw[:1] == b"<" and len(re.sub(rb"\s", b"", raw)) % 2 == 0 else re.sub(rb"\\([()\\])", rb"\1", raw[1:-1]).decode("utf-8", "replace")
        yield m[1].decode(), value, at + m.start()


def linked_xmp(data: bytes) -> tuple[bytes, int] | None:
    """The XMP packet of the metadata stream that the catalogue names."""
    trailer, start = _trailer(data)
    root, _ = _last_object(data, re.search(rb"/Root\s+(\d+)\s+(\d+)\s+R\b", trailer), start)
    body, at = _last_object(data, re.search(rb"/Metadata\s+(\d+)\s+(\d+)\s+R\b", root), start)
    head = body.split(b"stream", 1)[0]
    if b"stream" in body and re.search(rb"/Type\s*/Metadata\b", head) and re.search(rb"/Subtype\s*/XML\b", head):
        begin = body.find(b"<?xpacket")
        end = body.find(b"</x:xmpmeta>", begin)
        if 0 <= begin < end <= begin + (2 << 20):
            return body[begin : end + 12], at + begin
    return None


class PdfDetector:
    id, experimental = "documents.pdf-forensics.v1", False
    types = frozenset(("pdf",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        data = artifact.data
        if not data.startswith(b"%PDF-") or b"%%EOF" not in data[-4096:]:
            raise Incomplete("the signature or the end-of-file marker is missing", "corrupt_artifact")
        try:
            pdf = Pdf(data)
            info = pdf.resolved(pdf.trailer.get("Info"))
            entries = [(k, text_of(info[k]), 0) for k in INFO if k in info] if isinstance(info, dict) else []
            reader = "object-graph"
        except (Broken, ValueError, IndexError, RecursionError):
            entries, reader = [], "lexical"
        if not entries:
            entries, reader = list(lexical_info(data)), "lexical"
        for field, value, at in entries:
            category = "personal_metadata" if field == "Author" else "generator_metadata" if field in ("Creator", "Producer") else "document_metadata"
            safe = not protected(value)
            yield Observation(category, f"Info: {field}", {"field": field, "value": value, "reader": reader}, {"byte_offset": at}, "low" if category == "document_metadata" else "medium", evidence_type="metadata", remediation="pdf.remove-metadata-field" if safe else None, provenance="metadata" if safe else "provenance_metadata", tags=("pdf", "info-dictionary", field.casefold()))
        if found := linked_xmp(data):
            packet, at = found
            safe = not protected(packet.decode("utf-8", "replace"))
            yield Observation("document_metadata", "linked XMP packet", {"length": len(packet), "protected_provenance_marker": not safe}, {"byte_offset": at}, "low", evidence_type="metadata", remediation="pdf.remove-xmp" if safe else None, provenance="metadata" if safe else "provenance_metadata", tags=("pdf", "xmp", "metadata"))
        if b"/EmbeddedFile" in data or b"/Filespec" in data:
            yield Observation("structural_signal", "embedded file marker", {"embedded_file_marker": b"/EmbeddedFile" in data}, None, "medium", tags=("pdf", "embedded-file", "raw-marker", "passive-scan"))
        if b"/Annots" in data:
            yield Observation("structural_signal", "annotation marker", {"marker": "/Annots"}, tags=("pdf", "annotations", "raw-marker"))
