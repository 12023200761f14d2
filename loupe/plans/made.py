"""Files made on the cluster from the customers: one of each format for every dozen, with metadata that their rows tell."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loupe.plans.fixtures import dealt

FORMATS = ("docx", "pptx", "xlsx", "odf", "pdf", "pdf", "png", "jpeg", "wav", "mp3", "flac", "svg")
_TYPES = {"wav": "audio", "mp3": "audio", "flac": "audio"}
#: A note that every fifth file carries.
NOTE = "generated by ChatGPT"


def _zip(*parts: tuple[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts:
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return held.getvalue()


def _core(name: str) -> tuple[str, str]:
    return "docProps/core.xml", f'<?xml version="1.0"?>\n<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>{name}</dc:creator><dc:title>T</dc:title></cp:coreProperties>'


def _docx(k: int, name: str) -> bytes:
    note = NOTE if k % 5 == 0 else "plain"
    return _zip(
        ("[Content_Types].xml", "<Types/>"),
        _core(name),
        ("docProps/app.xml", "<Properties><Application>Maker</Application></Properties>"),
        ("docProps/custom.xml", f'<Properties><property name="Tool"><v>{note}</v></property></Properties>'),
        ("word/document.xml", f'<w:document xmlns:w="w"><w:body>{"<w:ins/>" if k % 2 else ""}<w:p/></w:body></w:document>'),
        ("word/comments.xml", f'<w:comments xmlns:w="w"><w:comment w:author="{name}"><w:t>see</w:t></w:comment></w:comments>'),
        ("word/_rels/document.xml.rels", '<R><Relationship Target="http://x" TargetMode="External"/></R>'),
    )


def _pptx(k: int, name: str) -> bytes:
    slides = [(f"ppt/slides/slide{i}.xml", "<s/>") for i in range(1 + k % 3)]
    return _zip(_core(name), ("ppt/notesSlides/notesSlide1.xml", f"<n><t>{NOTE if k % 5 == 0 else 'speak'}</t></n>"), ("ppt/commentAuthors.xml", f'<l><cmAuthor name="{name}" initials="C"/></l>'), *slides)


def _xlsx(k: int, name: str) -> bytes:
    return _zip(
        _core(name),
        ("xl/workbook.xml", f'<w><sheets><sheet name="s1"/><sheet name="s2" state="{"veryHidden" if k % 2 else "hidden"}"/></sheets><definedNames><definedName name="n1">{NOTE if k % 5 == 0 else "A1"}</definedName></definedNames></w>'),
        ("xl/comments1.xml", f'<c><authors><author>{name}</author></authors><comment ref="A1"><t>hm</t></comment></c>'),
        ("xl/externalLinks/externalLink1.xml", "<x/>"),
    )


def _odf(k: int, name: str) -> bytes:
    return _zip(
        ("mimetype", "application/vnd.oasis.opendocument.text"),
        ("content.xml", "<office><text>body</text></office>"),
        ("meta.xml", f'<m xmlns:meta="m"><meta:generator>Maker</meta:generator><meta:initial-creator>{name}</meta:initial-creator><meta:user-defined meta:name="Tool">{NOTE if k % 5 == 0 else "plain"}</meta:user-defined></m>'),
        *((("Basic/a.xml", "<b/>"),) if k % 2 else ()),
    )


def _pdf(objects: list[bytes], trailer: str) -> bytes:
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (i, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + f"trailer\n<< /Size {len(objects) + 1} {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode()


def _plain_pdf(k: int, name: str) -> bytes:
    info = f"<< /Author ({name} \\(x\\)) /Producer <4D616B6572> >>".encode()
    return _pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 0 >>", info], "/Root 1 0 R /Info 3 0 R")


def _packed_pdf(k: int, name: str) -> bytes:
    """Info in an object stream, told by a cross-reference stream with a predictor."""
    inner = [b"<< /Type /Catalog >>", f"<< /Author ({name}) /Creator (Maker) >>".encode()]
    heads = b"1 0 2 %d " % (len(inner[0]) + 1)
    packed = zlib.compress(heads + inner[0] + b" " + inner[1])
    out = bytearray(b"%PDF-1.5\n")
    first = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(heads), len(packed)) + packed + b"\nendstream\nendobj\n"
    at = len(out)
    rows = [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, first, 0), (1, at, 0)]
    data, above = bytearray(), bytes(4)
    for kind, x, y in rows:
        row = bytes([kind]) + x.to_bytes(2) + bytes([y])
        data += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    table = zlib.compress(bytes(data))
    out += b"4 0 obj\n<< /Type /XRef /Size 5 /W [1 2 1] /Root 1 0 R /Info 2 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n" % len(table) + table + b"\nendstream\nendobj\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at


def _png(k: int, name: str) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"tEXt", b"Software\0Maker") + chunk(b"tEXt", b"Author\0" + name.encode()) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _tiff(entries: list[tuple[int, int, int, bytes]]) -> bytes:
    """A directory of (tag, type, count, value); values over four bytes follow it."""
    at = 8 + 2 + 12 * len(entries) + 4
    head, tail = b"II*\0" + struct.pack("<IH", 8, len(entries)), b""
    for tag, kind, count, value in entries:
        if len(value) <= 4:
            head += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, count, at + len(tail))
            tail += value + b"\0" * (len(value) % 2)
    return head + struct.pack("<I", 0) + tail


def _jpeg(k: int, name: str) -> bytes:
    artist = name.encode() + b"\0"
    exif = b"Exif\0\0" + _tiff([(0x0112, 3, 1, struct.pack("<H", 1 + k % 8)), (0x013B, 2, len(artist), artist)])
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE1, exif) + segment(0xFE, b"made by hand") + segment(0xDB, b"\0" * 65) + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + bytes([k % 250]) * 20 + b"\xff\xd9"


def _wav(k: int, name: str) -> bytes:
    item = lambda kind, text: kind + struct.pack("<I", len(text)) + text + b"\0" * (len(text) % 2)
    info = b"INFO" + item(b"ISFT", b"Maker") + item(b"IART", name.encode())
    body = b"WAVE" + item(b"fmt ", b"\0" * 16) + item(b"LIST", info) + item(b"data", bytes([k % 256]) * 8)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _mp3(k: int, name: str) -> bytes:
    frame = lambda kind, text: kind + struct.pack(">I", len(text) + 1) + b"\0\0\x03" + text
    frames = frame(b"TPE1", name.encode()) + frame(b"TSSE", NOTE.encode() if k % 5 == 0 else b"Maker")
    return b"ID3\x03\0\0" + bytes((len(frames) >> s) & 127 for s in (21, 14, 7, 0)) + frames + b"\xff\xfb\x90\0" + bytes([k % 256]) * 60


def _flac(k: int, name: str) -> bytes:
    comment = b"ARTIST=" + name.encode()
    vorbis = struct.pack("<I", 5) + b"Maker" + struct.pack("<II", 1, len(comment)) + comment
    return b"fLaC\0" + (34).to_bytes(3) + b"\0" * 34 + b"\x84" + len(vorbis).to_bytes(3) + vorbis + bytes([k % 256]) * 12


def _svg(k: int, name: str) -> bytes:
    note = "<!-- created with ChatGPT -->" if k % 5 == 0 else "<!-- nothing -->"
    return f'<?xml version="1.0"?>\n{note}<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://inkscape" viewBox="0 0 10 10" inkscape:version="{k}"><metadata><rdf>{name}</rdf></metadata><rect x="{k % 10}" width="1"/></svg>'.encode()


_MADE = (_docx, _pptx, _xlsx, _odf, _plain_pdf, _packed_pdf, _png, _jpeg, _wav, _mp3, _flac, _svg)


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_path, artifact_type, content): a file for each customer."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [(k, name, FORMATS[k % 12]) for k, name in zip(batch.column("c_custkey").to_pylist(), batch.column("c_name").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([f"made/{k}.{f}" for k, _, f in rows]), pa.array([_TYPES.get(f, f) for _, _, f in rows]), pa.array([_MADE[k % 12](k, name) for k, name, _ in rows], pa.binary())], names=["artifact_path", "artifact_type", "content"])

    rows = dealt(spark, sf_dir, "customer", "c_custkey").selectExpr("CAST(c_custkey AS BIGINT) AS c_custkey", "c_name")
    return rows.mapInArrow(made, "artifact_path string, artifact_type string, content binary")
