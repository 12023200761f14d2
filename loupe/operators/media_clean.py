"""Cleaning of files: only metadata goes, and what carries the content stays byte for byte."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import xml.parsers.expat
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators.detect_text import PROTECTED_MARKERS
from loupe.plans.made import made_files
from loupe.registry import query

_SCHEMA = pa.schema([("artifact_path", pa.string()), ("status", pa.string()), ("clean", pa.binary()), ("material_before", pa.string()), ("material_after", pa.string()), ("removed", pa.list_(pa.string()))])
# Properties that may go, editors' names, and EXIF tags that rendering needs.
OOXML_FIELDS = {"docProps/core.xml": frozenset(("creator", "lastModifiedBy", "title", "subject", "keywords", "description", "category", "contentStatus", "created", "modified", "revision")), "docProps/app.xml": frozenset(("Application", "AppVersion", "Company", "Manager", "Template")), "docProps/custom.xml": frozenset(("property",))}
ODF_FIELDS = frozenset(("generator", "initial-creator", "creator", "title", "subject", "description", "keyword", "date", "creation-date", "printed-by", "print-date", "language", "editing-cycles", "editing-duration", "user-defined"))
EDITORS, METADATA = ("inkscape", "sodipodi", "adobe", "serif", "sketch"), ("metadata", "rdf", "RDF", "xmpmeta")
RENDERING_TAGS = (0x0112, 0x011A, 0x011B, 0x0128, 0xA001)

#: What a cleaner gives: the cleaned bytes and the names of what went.
Cleaned = tuple[bytes, list[str]]


class Refused(Exception):
    """A file that can't be cleaned safely."""


def _chunks(b: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 8
    while at + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        yield kind, at, at + 12 + size
        at += 12 + size


def png_cleaned(b: bytes) -> Cleaned:
    """Without its text chunks."""
    chunks = list(_chunks(b))
    gone = [b[i + 8 : j - 4].split(b"\0")[0].decode("latin-1") for kind, i, j in chunks if kind in (b"tEXt", b"iTXt", b"zTXt")]
    return b[:8] + b"".join(b[i:j] for kind, i, j in chunks if kind not in (b"tEXt", b"iTXt", b"zTXt")), gone


def png_material(b: bytes) -> bytes:
    return b"".join(b[i:j] for kind, i, j in _chunks(b) if kind in (b"IHDR", b"PLTE", b"IDAT", b"tRNS", b"IEND"))


def _segments(b: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, begin, end) of a JPEG's segments; the last one is the scan and all behind it."""
    at = 2
    while at < len(b):
        if b[at] != 0xFF:
            raise Refused("a marker is missing")
        begin = at
        while at < len(b) and b[at] == 0xFF:
            at += 1
        if at >= len(b):
            raise Refused("the file ends in a marker")
        marker = b[at]
        at += 1
        if marker == 0xDA:
            yield marker, begin, len(b)
            return
        if marker in (0x01, 0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            yield marker, begin, at
            continue
        size = int.from_bytes(b[at : at + 2])
        if size < 2 or at + size > len(b):
            raise Refused("a segment is cut")
        yield marker, begin, at + size
        at += size
    raise Refused("there is no scan")


def _rendering_exif(tiff: bytes) -> bytes | None:
    """The directory with nothing but what rendering needs; None if nothing is left."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        raise Refused("EXIF without an order")
    at = struct.unpack(order + "I", tiff[4:8])[0]
    kept = []
    for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if tag in RENDERING_TAGS:
            size = count * {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 0)
            if not size:
                raise Refused("EXIF of an unknown type")
            where = struct.unpack(order + "I", entry[8:])[0]
            kept.append((entry[:8], entry[8:] if size <= 4 else None, tiff[where : where + size]))
    if not kept:
        return None
    place, tail = 8 + 2 + 12 * len(kept) + 4, b""
    head = tiff[:4] + struct.pack(order + "I", 8) + struct.pack(order + "H", len(kept))
    for first, inline, value in kept:
        head += first + (inline if inline is not None else struct.pack(order + "I", place + len(tail)))
        tail += b"" if inline is not None else value
    return head + struct.pack(order + "I", 0) + tail


def jpeg_cleaned(b: bytes) -> Cleaned:
    """Without comments, XMP and EXIF, but for the tags that rendering needs."""
    out, gone = bytearray(b[:2]), []
    for marker, i, j in _segments(b):
        at = i
        while b[at] == 0xFF:
            at += 1
        body = b[at + 3 : j]
        if marker == 0xFE:
            gone.append("comment")
        elif marker == 0xE1 and body.startswith((b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0")):
            gone.append("xmp")
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            left = _rendering_exif(body[6:])
            if left is not None:
                out += b"\xff\xe1" + struct.pack(">H", len(left) + 8) + b"Exif\0\0" + left
            if left is None or len(left) < len(body) - 6:
                gone.append("exif")
        else:
            out += b[i:j]
    return bytes(out), gone


def jpeg_material(b: bytes) -> bytes:
    """The scan, and the tables that decode it."""
    return b"".join(b[i:j] for marker, i, j in _segments(b) if marker == 0xDA or marker in (0xDB, 0xC4, 0xDD) or 0xC0 <= marker <= 0xCF)


def _riff_chunks(b: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 12
    while at + 8 <= len(b):
        size = struct.unpack("<I", b[at + 4 : at + 8])[0]
        yield b[at : at + 4], at, min(at + 8 + size + size % 2, len(b))
        at += 8 + size + size % 2


def wave_cleaned(b: bytes) -> Cleaned:
    """Without information lists and notes; the outer size follows."""
    goes = lambda kind, i: (kind == b"LIST" and b[i + 8 : i + 12] == b"INFO") or kind in (b"iXML", b"_PMX", b"XMP ")
    chunks = list(_riff_chunks(b))
    body = b"".join(b[i:j] for kind, i, j in chunks if not goes(kind, i))
    return b[:4] + struct.pack("<I", 4 + len(body)) + b[8:12] + body, [kind.decode("latin-1").strip() for kind, i, _ in chunks if goes(kind, i)]


def wave_material(b: bytes) -> bytes:
    return b"".join(b[i:j] for kind, i, j in _riff_chunks(b) if kind in (b"fmt ", b"data"))


def mp3_frames(b: bytes) -> bytes:
    start = 10 + sum(x << s for x, s in zip(b[6:10], (21, 14, 7, 0), strict=True)) if b[:3] == b"ID3" else 0
    return b[start : len(b) - 128 if b[-128:-125] == b"TAG" and len(b) - 128 >= start else len(b)]


def mp3_cleaned(b: bytes) -> Cleaned:
    """Without tags at either end."""
    return mp3_frames(b), [name for name, there in (("ID3", b[:3] == b"ID3"), ("TAG", b[-128:-125] == b"TAG")) if there]


def _flac_blocks(b: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    at, last, out = 4, False, []
    while not last and at + 4 <= len(b):
        last, kind, size = bool(b[at] & 0x80), b[at] & 0x7F, int.from_bytes(b[at + 1 : at + 4])
        out.append((kind, b[at + 4 : at + 4 + size]))
        at += 4 + size
    return out, b[at:]


def flac_cleaned(b: bytes) -> Cleaned:
    """With an empty comment block in the place of a filled one, and the last block marked anew."""
    blocks, frames = _flac_blocks(b)
    kept = [(k, struct.pack("<II", 0, 0) if k == 4 else body) for k, body in blocks if k != 2]
    gone = [name for k, name in ((4, "comments"), (2, "application")) if any(x == k for x, _ in blocks)]
    return b[:4] + b"".join(bytes([k | (0x80 if i == len(kept) - 1 else 0)]) + len(body).to_bytes(3) + body for i, (k, body) in enumerate(kept)) + frames, gone


def flac_material(b: bytes) -> bytes:
    blocks, frames = _flac_blocks(b)
    return b"".join(body for k, body in blocks if k == 0) + frames


# -- XML, by the places of what goes


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


class _Places:
    """Byte spans of elements, start tags and comments, with what the elements say."""

    def __init__(self, data: bytes) -> None:
        self.elements: list[list] = []  # name, attributes, begin, end of the start tag, end, depth, text
        self.comments: list[tuple[int, int, str]] = []
        self._open: list[int] = []
        self._data, self._comment = data, None
        p = self._p = xml.parsers.expat.ParserCreate()
        p.StartDoctypeDeclHandler = self._refuse
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.CommentHandler = self._start, self._end, self._text, self._note
        try:
            p.Parse(data, True)
        except xml.parsers.expat.ExpatError as error:
            raise Refused(str(error)) from error

    def _refuse(self, *_):
        raise Refused("a document type is declared")

    def _tag_end(self, at: int) -> int:
        """Behind the start tag that begins at a place: quotes hide what looks like its end."""
        m = re.compile(rb"""<(?:"[^"]*"|'[^']*'|[^'">])*>""").match(self._data, at)
        if m is None:
            raise Refused("a tag doesn't end")
        return m.end()

    def _start(self, name, attrs):
        at = self._p.CurrentByteIndex
        self._open.append(len(self.elements))
        self.elements.append([name, attrs, at, self._tag_end(at), None, len(self._open), []])

    def _end(self, _):
        e = self.elements[self._open.pop()]
        at = self._p.CurrentByteIndex
        e[4] = e[3] if self._data[e[3] - 2 : e[3]] == b"/>" else self._data.index(b">", at) + 1

    def _text(self, data):
        for i in self._open:
            self.elements[i][6].append(data)

    def _note(self, data):
        at = self._p.CurrentByteIndex
        self.comments.append((at, self._data.index(b"-->", at) + 3, data))


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = bytearray(), 0
    for a, b in sorted(spans):
        if a >= at:
            out += data[at:a]
            at = b
        at = max(at, b)
    return bytes(out + data[at:])


def _editors(e: list) -> list[str]:
    return [n for n in e[1] if any(x in n.casefold() for x in EDITORS) and not n.startswith("xmlns")]


def svg_cleaned(b: bytes) -> Cleaned:
    """Without metadata blocks, editors' attributes, and comments of generators."""
    p, spans, gone, blocked = _Places(b), [], [], 0
    for e in p.elements:
        if e[2] < blocked:
            continue
        if _local(e[0]) in METADATA:
            spans.append((e[2], e[4]))
            blocked = e[4]
            gone.append("metadata")
            continue
        for name in _editors(e):
            m = re.compile(rb"\s+" + re.escape(name.encode()) + rb"""\s*=\s*("[^"]*"|'[^']*')""").search(b, e[2], e[3])
            if m is None:
                raise Refused("an attribute isn't where it was")
            spans.append(m.span())
            gone.append(name)
    for at, end, data in p.comments:
        if re.search(r"(?i)\b(?:generator|created with|exported by|AI[- ]generated)\b", data):
            spans.append((at, end))
            gone.append("comment")
    return _without(b, spans), gone


def svg_material(b: bytes) -> bytes:
    """What can be seen: elements, attributes and texts outside metadata, in order."""
    p, blocked, seen = _Places(b), 0, []
    for e in p.elements:
        if e[2] < blocked:
            continue
        if _local(e[0]) in METADATA:
            blocked = e[4]
            continue
        own = set(_editors(e))
        seen.append((e[0], e[5], sorted((n, v) for n, v in e[1].items() if n not in own)))
    return repr(seen).encode()


def _fields_cut(data: bytes, fields: frozenset[str], part: str) -> Cleaned:
    p, spans, gone = _Places(data), [], []
    for e in p.elements[1:]:
        if _local(e[0]) in fields:
            spans.append((e[2], e[4]))
            gone.append(f"{part}:{next((v for n, v in e[1].items() if _local(n) == 'name'), _local(e[0]))}")
    return _without(data, spans), gone


def _package(b: bytes, parts: dict[str, frozenset[str]]) -> Cleaned:
    """The package with fields of some parts cut; all other parts, their order and how they are stored stay."""
    held, gone = io.BytesIO(), []
    with zipfile.ZipFile(io.BytesIO(b)) as old, zipfile.ZipFile(held, "w") as new:
        for info in old.infolist():
            data = old.read(info.filename)
            if info.filename in parts:
                data, cut = _fields_cut(data, parts[info.filename], info.filename)
                gone += cut
            new.writestr(info, data)
    return held.getvalue(), gone


def package_material(b: bytes, changed: tuple[str, ...]) -> bytes:
    """Every part but those that may change, in order, with how it is stored."""
    out = []
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for info in z.infolist():
            out.append((info.filename, info.compress_type, None if info.filename in changed else hashlib.sha256(z.read(info.filename)).hexdigest()))
    return repr(out).encode()


def office_cleaned(b: bytes) -> Cleaned:
    return _package(b, OOXML_FIELDS)


def office_material(b: bytes) -> bytes:
    return package_material(b, tuple(OOXML_FIELDS))


def odf_cleaned(b: bytes) -> Cleaned:
    """Without the fields of meta.xml; the type stays first and stored."""
    return _package(b, {"meta.xml": ODF_FIELDS})


def odf_material(b: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        first = z.infolist()[0]
        if first.filename != "mimetype" or first.compress_type != zipfile.ZIP_STORED or "content.xml" not in z.namelist():
            raise Refused("no OpenDocument package")
    return package_material(b, ("meta.xml",))


_KINDS: tuple[tuple[Callable[[bytes], bool], Callable[[bytes], Cleaned], Callable[[bytes], bytes]], ...] = (
    (lambda b: b.startswith(b"\x89PNG\r\n\x1a\n"), png_cleaned, png_material),
    (lambda b: b.startswith(b"\xff\xd8\xff"), jpeg_cleaned, jpeg_material),
    (lambda b: b[:4] == b"RIFF" and b[8:12] == b"WAVE", wave_cleaned, wave_material),
    (lambda b: b.startswith(b"fLaC"), flac_cleaned, flac_material),
    (lambda b: b[:3] == b"ID3" or b[-128:-125] == b"TAG", mp3_cleaned, mp3_frames),
    (lambda b: b.startswith(b"PK\x03\x04") and b[30:38] == b"mimetype", odf_cleaned, odf_material),
    (lambda b: b.startswith(b"PK\x03\x04"), office_cleaned, office_material),
    (lambda b: re.match(rb"\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<svg[\s>]", b[:4096], re.S) is not None, svg_cleaned, svg_material),
)


def _protected(b: bytes) -> bool:
    """Whether a marker stands in the bytes, or in a part of a package."""
    pieces = [b]
    if b.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            pieces = [z.read(n) for n in z.namelist()]
    return any(m.encode() in p.lower() for p in pieces for m in PROTECTED_MARKERS)


def cleaned_file(b: bytes) -> tuple[str, bytes | None, str | None, str | None, list[str] | None]:
    """Status, cleaned bytes, the content's digests before and after, and what went."""
    kind = next((k for k in _KINDS if k[0](b)), None)
    if kind is None:
        return "unsupported", None, None, None, None
    try:
        if _protected(b):
            return "protected", None, None, None, None
        clean, gone = kind[1](b)
        before, after = (hashlib.sha256(kind[2](x)).hexdigest() for x in (b, clean))
    except Refused:
        return "refused", None, None, None, None
    except (struct.error, IndexError, ValueError, zipfile.BadZipFile, KeyError):
        return "corrupt", None, None, None, None
    if before != after:
        return "content_changed", None, before, after, None
    return "cleaned", clean, before, after, gone


def media_cleaned(files: DataFrame) -> DataFrame:
    """Each file cleaned or refused, with digests of its content before and after and the names of what went.

    A file with a protected provenance marker is refused as a whole; one whose
    content would change is not published.
    """

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [(path, *cleaned_file(content or b"")) for path, content in zip(batch.column("artifact_path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return files.select("artifact_path", F.col("content").cast("binary").alias("content")).mapInArrow(made, "artifact_path string, status string, clean binary, material_before string, material_after string, removed array<string>")


def write_cleaned(cleaned: DataFrame, path: str) -> None:
    """The cleaned files and their integrity rows, beside the originals, never in their place."""
    cleaned.where("status = 'cleaned'").write.mode("errorifexists").parquet(path)


_FORMAT = "CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(("docx", "pptx", "xlsx", "odf", "pdf", "pdf", "png", "jpeg", "wav", "mp3", "flac", "svg"))) + " END"


@query(
    "media_cleaned",
    f"""SELECT concat('made/', c_custkey, '.', {_FORMAT}) AS artifact_path, CASE WHEN c_custkey % 12 IN (4, 5) THEN 'unsupported' ELSE 'cleaned' END AS status, CASE WHEN c_custkey % 12 NOT IN (4, 5) THEN true END AS same_content,
    CASE c_custkey % 12 WHEN 0 THEN 'docProps/core.xml:creator,docProps/core.xml:title,docProps/app.xml:Application,docProps/custom.xml:Tool' WHEN 1 THEN 'docProps/core.xml:creator,docProps/core.xml:title' WHEN 2 THEN 'docProps/core.xml:creator,docProps/core.xml:title' WHEN 3 THEN 'meta.xml:generator,meta.xml:initial-creator,meta.xml:Tool'
      WHEN 6 THEN 'Software,Author' WHEN 7 THEN 'exif,comment' WHEN 8 THEN 'LIST' WHEN 9 THEN 'ID3' WHEN 10 THEN 'comments' WHEN 11 THEN concat('inkscape:version,metadata', CASE WHEN c_custkey % 5 = 0 THEN ',comment' ELSE '' END) END AS removed FROM customer""",
)
def q_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_cleaned(made_files(spark, sf_dir)).select("artifact_path", "status", (F.col("material_before") == F.col("material_after")).alias("same_content"), F.array_join("removed", ",").alias("removed"))


@query("media_rescan", f"SELECT concat('made/', c_custkey, '.', {_FORMAT}) AS artifact_path, CASE c_custkey % 12 WHEN 7 THEN 1 WHEN 10 THEN 0 ELSE 0 END::BIGINT AS left_over FROM customer WHERE c_custkey % 12 = 7")
def q_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that cleaned media files still show: the orientation of photographs."""
    from loupe.detection.engine import findings, scan_rows

    clean = media_cleaned(made_files(spark, sf_dir)).where("status = 'cleaned'")
    suffix = F.regexp_extract("artifact_path", r"\.(\w+)$", 1)
    kind = F.when(suffix.isin("wav", "mp3", "flac"), "audio").otherwise(suffix)
    left = findings(scan_rows(clean.select("artifact_path", kind.alias("artifact_type"), F.col("clean").alias("content")))).where(F.col("detector_id").isin("design.raster-metadata.v1", "media.container-metadata.v1") & (F.get_json_object("evidence", "$.value") != ""))
    return left.groupBy("artifact_path").agg(F.count(F.lit(1)).alias("left_over"))
