"""Structure of markup, style sheets, source comments and containers.

Parsing needs a state that SQL expressions don't hold, so each operator here is
a pass over Arrow batches that turns an artifact into rows; what is concluded
from those rows is DataFrame code again. Every parser works within budgets and
reports what stopped it as a row of its own instead of failing the task.
"""

from __future__ import annotations

import io
import re
import struct
import tokenize
import xml.parsers.expat
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.passes import parsed, problems  # noqa: F401
from loupe.operators.detect_text import COMMENT, HTML_COMMENT, METADATA, PROTECTED_MARKERS, RULES
from loupe.plans.fixtures import bound, dealt
from loupe.registry import query
from loupe.sources.artifacts import table

# Budgets, elements without content, and where containers keep what they tell.
MAX_EVENTS, MAX_DEPTH, MAX_PARTS, MAX_INFLATED, MAX_RATIO = 100_000, 512, 10_000, 64 << 20, 200
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RIFF_INFO = {"IART": "artist", "ICMT": "comment", "ICOP": "copyright", "ICRD": "creation_date", "IENG": "engineer", "IGNR": "genre", "INAM": "title", "IPRD": "product", "ISBJ": "subject", "ISFT": "software", "ISRC": "source"}
ID3V22 = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TCM": "TCOM", "TCR": "TCOP", "TEN": "TENC", "TSS": "TSSE", "COM": "COMM", "TXX": "TXXX"}
ATOMS = {"©nam": "title", "©ART": "artist", "aART": "album_artist", "©wrt": "composer", "©cmt": "comment", "©cpy": "copyright", "©day": "creation_date", "©too": "encoder_software"}
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
MAX_BOXES, MAX_VALUE, MAX_NESTING = 12, 256 << 10, 4096
EBML_MASTERS = frozenset((0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1254C367, 0x7373, 0x63C0))
EBML_TEXT = {0x4282: "document_type", 0x5741: "writing_application", 0x4D80: "muxing_application", 0x7BA9: "title"}
#: EXIF tags by name; others go by number. Pointers lead to further directories; what rendering needs may not go.
EXIF = {0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x000B: "ProcessingSoftware", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x02BC: "XMLPacket", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA001: "ColorSpace", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel"}
EXIF_POINTERS = {0x8769: "", 0x8825: "GPS", 0xA005: "Interop"}
RENDERING = ("Orientation", "XResolution", "YResolution", "ResolutionUnit", "ColorSpace")
PDF_INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


# -- HTML


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows: list[tuple] = []

    def _add(self, kind: str, tag: str | None, name: str | None, value: str | None) -> None:
        if len(self.rows) >= MAX_EVENTS:
            raise OverflowError("events")
        line, column = self.getpos()
        self.rows.append((kind, tag, name, value, line, column + 1))

    def handle_starttag(self, tag, attrs):
        self._add("start", tag, None, None)
        for key, value in attrs:
            self._add("attribute", tag, key.lower(), value or "")

    def handle_comment(self, data):
        self._add("comment", None, None, data)


MAX_UNCLOSED_WORK = 150_000_000


def _html_events(text: str | None) -> Iterator[tuple]:
    text = text or ""
    if sum(">" not in piece for piece in text.split("<")[1:]) * len(text) > MAX_UNCLOSED_WORK:
        raise OverflowError("unclosed tags")
    p = _Events()
    p.feed(text)
    p.close()
    return iter(p.rows)


def html_events(pages: DataFrame) -> DataFrame:
    """Start tags, attributes and comments with their place."""
    return parsed(pages, "text", _html_events, "kind string, tag string, name string, value string, line int, col int")


def _rule_hits(text_column: str, context: str):
    """Whether any rule of a context matches, and the provider of the first that does."""
    out = F.lit(None).cast("string")
    for _, provider, _, contexts, pattern in reversed(RULES):
        if context in contexts:
            out = F.when(F.col(text_column).rlike(f"(?i:{pattern})"), provider).otherwise(out)
    return out


def _alone(text_column: str, context: str):
    """Whether nothing but signs and white space stands beside an attribution of a context."""
    out = F.lit(False)
    for _, _, _, contexts, pattern in RULES:
        if context in contexts:
            whole = f"(?i:{pattern})"
            out = out | (F.col(text_column).rlike(whole) & ~F.regexp_replace(text_column, whole, "").rlike(r"[\p{L}\p{N}]"))
    return out


def html_findings(events: DataFrame) -> DataFrame:
    """Generator metadata, hidden elements with all their reasons, scripts, data URIs and attributed comments.

    Pages that couldn't be read are in ``problems`` of the same events.
    """
    e = events.where("error is null")
    starts = e.where("kind = 'start' AND tag = 'script'").select("artifact_path", "line", F.lit("security_issue").alias("category"), F.lit("script").alias("detail"), F.lit(False).alias("removable"))
    attrs = e.where("kind = 'attribute'")
    tidy = F.lower(F.replace("value", F.lit(" "), F.lit("")))
    styled = lambda sign: F.max((F.col("name") == "style") & tidy.contains(sign))
    reasons = F.array_compact(F.array(F.when(F.max(F.col("name") == "hidden"), "hidden attribute"), F.when(styled("display:none"), "display:none"), F.when(styled("visibility:hidden"), "visibility:hidden"), F.when(styled("opacity:0"), "zero opacity")))
    hidden = attrs.where("name IN ('hidden', 'style')").groupBy("artifact_path", "line", "col").agg(F.array_join(reasons, ", ").alias("detail")).where("detail <> ''")
    hidden = hidden.select("artifact_path", "line", F.lit("hidden_element").alias("category"), "detail", F.lit(False).alias("removable"))
    data = attrs.where(F.lower(F.ltrim("value")).startswith("data:")).select("artifact_path", "line", F.lit("structural_signal").alias("category"), F.lit("data uri").alias("detail"), F.lit(False).alias("removable"))
    meta = attrs.where("tag = 'meta'").groupBy("artifact_path", "line", "col").agg(F.max(F.when(F.col("name") == "name", F.lower("value"))).alias("n"), F.max(F.when(F.col("name") == "content", F.col("value"))).alias("c"))
    meta = meta.where("n = 'generator'").select("artifact_path", "line", F.lit("generator_metadata").alias("category"), F.coalesce("c", F.lit("")).alias("detail"), F.lit(True).alias("removable"))
    notes = e.where("kind = 'comment'").withColumn("detail", _rule_hits("value", HTML_COMMENT)).where("detail is not null").select("artifact_path", "line", F.lit("generated_comment").alias("category"), "detail", _alone("value", HTML_COMMENT).alias("removable"))
    return starts.unionByName(hidden).unionByName(data).unionByName(meta).unionByName(notes)


class _Topology(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # tag, children, had text
        self.n: Counter[str] = Counter()
        self.ids: Counter[str] = Counter()
        self.classes: Counter[str] = Counter()
        self.tags: Counter[str] = Counter()
        self.depths: Counter[int] = Counter()

    def handle_starttag(self, tag, attrs):
        self.n["elements"] += 1
        self.tags[tag] += 1
        if self.n["elements"] > MAX_EVENTS:
            raise OverflowError("elements")
        self.n["markup_characters"] += len(self.get_starttag_text() or "")
        if self.stack:
            self.stack[-1][1] += 1
        if tag in VOID:
            self.n["void_elements"] += 1
        else:
            self.stack.append([tag, 0, False])
            if len(self.stack) > MAX_DEPTH:
                raise OverflowError("depth")
            self.n["max_depth"] = max(self.n["max_depth"], len(self.stack))
            self.depths[len(self.stack)] += 1
        self.n["script_elements"] += tag == "script"
        self.n["style_elements"] += tag == "style"
        for key, value in attrs:
            key, value = key.lower(), value or ""
            self.n["attributes"] += 1
            self.n["inline_styles"] += key == "style"
            if key == "id" and value:
                self.ids[value] += 1
            elif key == "class":
                self.classes.update(value.split())
            elif key in ("src", "href", "srcset", "data") and value and not value.startswith(("#", "data:")):
                self.n["external_references"] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self._close()

    def handle_endtag(self, tag):
        self.n["markup_characters"] += len(tag) + 3
        if tag in VOID:
            return
        if all(s[0] != tag for s in self.stack):
            self.n["mismatched_closes"] += 1
            return
        while self.stack[-1][0] != tag:
            self.n["mismatched_closes"] += 1
            self._close()
        self._close()

    def _close(self):
        _, children, text = self.stack.pop()
        self.n["wrapper_only_elements"] += children == 1 and not text

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            self.n["markup_characters"] += len(data)
            return
        bare = data.strip()
        self.n["text_characters"] += len(bare)
        if bare and self.stack:
            self.stack[-1][2] = True

    def handle_comment(self, data):
        self.n["comments"] += 1
        self.n["markup_characters"] += len(data) + 7


TOPOLOGY = ("elements", "max_depth", "void_elements", "mismatched_closes", "unclosed_elements", "wrapper_only_elements", "comments", "inline_styles", "distinct_ids", "duplicate_ids", "class_tokens", "distinct_class_tokens", "attributes", "text_characters", "markup_characters", "script_elements", "style_elements", "external_references")


def _measured(text: str | None) -> tuple[_Topology, str | None]:
    p, stopped = _Topology(), None
    try:
        p.feed(text or "")
        p.close()
    except OverflowError as e:  # what was measured so far is a lower bound, and says so
        stopped = str(e)
    p.n |= Counter({"unclosed_elements": len(p.stack), "distinct_ids": len(p.ids), "duplicate_ids": sum(c > 1 for c in p.ids.values()), "class_tokens": sum(p.classes.values()), "distinct_class_tokens": len(p.classes)})
    return p, stopped


def topology_of(text: str | None) -> Iterator[tuple]:
    p, stopped = _measured(text)
    yield (*(p.n[k] for k in TOPOLOGY), stopped)


def histograms_of(text: str | None) -> Iterator[tuple]:
    """(histogram, value, n): elements by tag and by depth."""
    p, _ = _measured(text)
    yield from (("tag", tag, n) for tag, n in p.tags.items())
    yield from (("depth", str(depth), n) for depth, n in p.depths.items())


def measured_topology(text: str) -> dict[str, int | bool]:
    """The measurements that a finding carries."""
    p, stopped = _measured(text)
    told = ("elements", "max_depth", "wrapper_only_elements", "inline_styles", "duplicate_ids", "class_tokens", "distinct_class_tokens", "attributes", "text_characters", "markup_characters", "comments", "script_elements", "style_elements", "external_references", "unclosed_elements", "mismatched_closes")
    return {k: p.n[k] for k in told} | {"distinct_tags": len(p.tags), "complete": stopped is None}


def dom_histograms(pages: DataFrame) -> DataFrame:
    """Elements of each document by tag and by depth."""
    return parsed(pages, "text", histograms_of, "histogram string, value string, n int")


def dom_topology(pages: DataFrame) -> DataFrame:
    """The shape of each document, in one row."""
    return parsed(pages, "text", topology_of, ", ".join(f"{k} int" for k in TOPOLOGY) + ", truncated_by string")


# -- comments and style sheets


def comment_places(text: str, path: str) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, verified by a real tokenizer) of the comments of a source file."""
    if path.lower().endswith(".py"):
        try:
            starts = [0, *(m.end() for m in re.finditer("\n", text))]
            found = [(starts[t.start[0] - 1] + t.start[1], len(t.string)) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
            yield from ((at, at + n, True) for at, n in found)
            return
        except (SyntaxError, tokenize.TokenError):
            pass
    at = 0
    closes = {"//": "\n", "#": "\n", "/*": "*/", "<!--": "-->"}
    while closes and (m := re.compile("|".join(map(re.escape, closes))).search(text, at)):
        close = closes[m[0]]
        end = text.find(close, m.end())
        if end < 0 and close != "\n":  # never closed: no comment, nor is any later one of its kind
            at = m.end()
            del closes[m[0]]
            continue
        end = len(text) if end < 0 else end + (0 if close == "\n" else len(close))
        yield m.start(), end, False
        at = end


def comment_spans(text: str, path: str) -> Iterator[tuple[str, int, bool]]:
    """(comment, line, verified by a real tokenizer)."""
    line, seen = 1, 0
    for start, end, verified in comment_places(text, path):
        line += text.count("\n", seen, start)
        seen = start
        yield text[start:end], line, verified


def source_comments(sources: DataFrame) -> DataFrame:
    """Comments of source files. The text carries its path in the first line of the pair."""

    def parse(value: str | None) -> Iterator[tuple]:
        path, _, text = (value or "").partition("\0")
        return comment_spans(text, path)

    keyed = sources.select("artifact_path", F.concat("artifact_path", F.lit("\0"), "text").alias("text"))
    return parsed(keyed, "text", parse, "comment string, line int, verified boolean")


def comment_findings(comments: DataFrame) -> DataFrame:
    """Attributions inside comments; only those that a tokenizer has verified may be removed."""
    return comments.where("error is null").withColumn("provider", _rule_hits("comment", COMMENT)).where("provider is not null").select("artifact_path", "line", "provider", "verified", F.lit("generated_comment").alias("category"), F.when(F.col("verified"), 0.99).otherwise(0.65).alias("confidence"))


def _blocks(text: str) -> Iterator[tuple[str, str]]:
    """(selector, body) of the innermost rules; at-rules are entered, a block that doesn't close is none."""
    stack: list[tuple[int, int, int]] = []  # brace, where its selector starts, blocks opened so far
    begin = opened = 0
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            if len(stack) == MAX_NESTING:
                raise OverflowError("depth")
            opened += 1
            stack.append((m.start(), begin, opened))
        elif stack:
            brace, head, before = stack.pop()
            if opened == before:
                yield text[head:brace].strip(), text[brace + 1 : m.start()]
        begin = m.end()


def sheet_of(text: str | None) -> Iterator[tuple]:
    bare = re.sub(r"/\*.*?(?:\*/|\Z)", "", text or "", flags=re.S)
    n, stopped = Counter(), None
    try:
        for _, b in _blocks(bare):
            n.update(rules=1, declarations=b.count(":"), hiding=int(bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", b, re.I))), important=b.count("!important"))
    except OverflowError as e:  # what was counted so far is a lower bound, and says so
        stopped = str(e)
    yield n["rules"], n["declarations"], n["hiding"], len(re.findall(r"url\(\s*['\"]?data:", bare, re.I)), n["important"], stopped


def stylesheet_features(sheets: DataFrame) -> DataFrame:
    """Innermost rules, their declarations, hiding rules, data URIs and forced declarations of each sheet."""
    return parsed(sheets, "text", sheet_of, "rules int, declarations int, hiding_rules int, data_uris int, important int, truncated_by string")


SHEET_COUNTS = ("rules", "selectors", "declarations", "important_declarations", "vendor_prefixed_properties", "custom_properties", "max_selector_parts", "duplicate_selectors", "distinct_properties", "comments", "embedded_data_uris")


def _sheet_measures(text: str | None) -> Iterator[tuple]:
    from loupe.detection.text import sheet_features

    found = sheet_features(text or "", MAX_EVENTS)
    yield (*(found[k] for k in SHEET_COUNTS), found["truncated_by"])


def _sheet_histograms(text: str | None) -> Iterator[tuple]:
    from loupe.detection.text import sheet_features

    found = sheet_features(text or "", MAX_EVENTS)
    for name, counts in (("at_rule", "at_rules"), ("specificity", "specificity_histogram"), ("property", "property_histogram")):
        yield from ((name, value, n, rank) for rank, (value, n) in enumerate(found[counts].items(), 1))


def sheet_measures(sheets: DataFrame) -> DataFrame:
    """The shape of each sheet as rules at the top and inside at-rules make it."""
    return parsed(sheets, "text", _sheet_measures, ", ".join(f"{k} int" for k in SHEET_COUNTS) + ", truncated_by string")


def sheet_histograms(sheets: DataFrame) -> DataFrame:
    """At-rules, specificities and the 50 most frequent properties of each sheet, the most frequent first; ties as they stand."""
    return parsed(sheets, "text", _sheet_histograms, "histogram string, value string, n int, rank int")


# -- containers


def _safe_xml(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(element, attribute, value, kind) of an XML part; document types are refused."""
    out: list[tuple[str, str, str, str]] = []
    text: list[str] = []
    p = xml.parsers.expat.ParserCreate()

    def refuse(*_):
        raise ValueError("document type")

    def start(name, attrs):
        if len(out) > MAX_EVENTS:
            raise OverflowError("elements")
        text.clear()
        out.extend((name, k, v, "attribute") for k, v in attrs.items())

    def end(name):
        if value := "".join(text).strip():
            out.append((name, "", value, "text"))
        text.clear()

    p.StartDoctypeDeclHandler, p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = refuse, start, end, text.append
    p.Parse(data, True)
    return iter(out)


def package_of(content: bytes | None) -> Iterator[tuple]:
    """(part, kind, field, value) of an office package: properties, macros, embedded objects, outside links."""
    z = zipfile.ZipFile(io.BytesIO(content or b""))
    infos = z.infolist()
    names = [i.filename for i in infos]
    if len(infos) > MAX_PARTS or sum(i.file_size for i in infos) > MAX_INFLATED or any(i.file_size > 1024 and i.file_size > MAX_RATIO * max(i.compress_size, 1) for i in infos):
        raise OverflowError("package")
    if len(set(names)) < len(names) or any(n.startswith("/") or ".." in n.split("/") for n in names) or any(i.flag_bits & 1 for i in infos):
        raise ValueError("package")
    for name in names:
        low = name.lower()
        if low.endswith("vbaproject.bin"):
            yield name, "macro", "", ""
        elif "/embeddings/" in low:
            yield name, "embedded", "", ""
        elif low in ("docprops/core.xml", "docprops/app.xml", "docprops/custom.xml", "meta.xml"):
            for element, _, value, kind in _safe_xml(z.read(name)):
                if kind == "text":
                    yield name, "property", element.split(":")[-1], value
        elif low.endswith(".rels"):
            links = [(a, v) for _, a, v, kind in _safe_xml(z.read(name)) if kind == "attribute"]
            yield from ((name, "external", "Target", v) for (a, v), (b, w) in zip(links, links[1:] + [("", "")]) if a == "Target" and b == "TargetMode" and w == "External")
        elif low.endswith(("comments.xml", "document.xml", "workbook.xml")):
            for element, a, v, kind in _safe_xml(z.read(name)):
                if a.endswith("author"):
                    yield name, element.split(":")[-1], "author", v
                elif a == "state" and v in ("hidden", "veryHidden"):
                    yield name, "hidden_sheet", "state", v


def _text(raw: bytes, codec: str = "utf-8") -> str:
    """A value's text; one above the reference's size is an error, not a prefix."""
    if len(raw) > MAX_VALUE:
        raise OverflowError("value")
    return raw.decode(codec, "replace").strip("\0\ufeff \t\r\n")


def _exif(b: bytes, base: int) -> Iterator[tuple]:
    """Every tag of a TIFF structure's directories: the chain from the first, and those that tags point to."""
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if order is None:
        raise ValueError("exif")
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}
    todo, seen, events = [(struct.unpack(order + "I", b[4:8])[0], "")], set(), 0
    while todo:
        at, prefix = todo.pop()
        if not at or at in seen:
            continue
        seen.add(at)
        n = struct.unpack(order + "H", b[at : at + 2])[0]
        for i in range(at + 2, at + 2 + 12 * n, 12):
            events += 1
            if events > MAX_EVENTS:
                raise OverflowError("exif")
            tag, kind, count = struct.unpack(order + "HHI", b[i : i + 8])
            form = sizes.get(kind)
            if form is None:
                raise ValueError("exif type")
            size = count * struct.calcsize(order + form)
            where = i + 8 if size <= 4 else struct.unpack(order + "I", b[i + 8 : i + 12])[0]
            raw = b[where : where + size]
            if len(raw) < size:
                raise ValueError("exif value")
            if tag in EXIF_POINTERS and not prefix:
                todo.append((struct.unpack(order + "I", raw[:4])[0], EXIF_POINTERS[tag]))
                continue
            if len(raw) > MAX_VALUE:
                raise OverflowError("value")
            if 0x9C9B <= tag <= 0x9C9F:
                value = _text(raw, "utf-16-le")
            elif tag == 0x9286:
                value = _text(raw[8:], ("utf-16-le" if order == "<" else "utf-16-be") if raw.startswith(b"UNICODE") else "utf-8")
            elif form == "s":
                value = _text(raw)
            else:
                numbers = struct.unpack(f"{order}{count * len(form)}{form[0]}", raw)
                value = " ".join(map(str, numbers) if len(form) == 1 else (f"{x}/{y}" for x, y in zip(numbers[::2], numbers[1::2], strict=True)))
            yield "exif", prefix + str(tag) if prefix else EXIF.get(tag, str(tag)), value, base + where
        end = at + 2 + 12 * n
        if not prefix and end + 4 <= len(b):
            todo.append((struct.unpack(order + "I", b[end : end + 4])[0], prefix))


def _inflated(data: bytes, most: int) -> bytes:
    """All that a stream holds, in bounded pieces; more than ``most`` bytes are an error, and so is a stream without an end."""
    stream, out = zlib.decompressobj(), bytearray()
    while not stream.eof:
        piece = stream.decompress(data, 1 << 18)
        out += piece
        data = stream.unconsumed_tail
        if len(out) > most:
            raise OverflowError("inflated")
        if not piece and not data and not stream.eof:
            raise ValueError("inflated")
    return bytes(out)


def _png(b: bytes) -> Iterator[tuple]:
    at, left = 8, MAX_INFLATED
    while at + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + size]
        if kind in (b"tEXt", b"iTXt"):
            key, _, value = body.partition(b"\0")
            yield "png", key.decode("latin-1"), (value if kind == b"tEXt" else value.split(b"\0", 4)[-1]).decode("utf-8", "replace"), at
        elif kind == b"zTXt":
            key, _, value = body.partition(b"\0")
            value = _inflated(value[1:], left)
            left -= len(value)
            yield "png", key.decode("latin-1"), value.decode("latin-1"), at
        elif kind == b"eXIf":
            yield from _exif(body, at + 8)
        at += 12 + size


def _jpeg(b: bytes) -> Iterator[tuple]:
    at, extended = 2, {}
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] not in (0xDA, 0xD9):
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        body = b[at + 4 : at + 2 + size]
        if b[at + 1] == 0xFE:
            yield "jpeg", "comment", body.decode("utf-8", "replace"), at
        elif body.startswith(b"Exif\0") and b[at + 1] == 0xE1:
            yield from _exif(body[6:], at + 10)
        elif body.startswith(b"http://ns.adobe.com/xmp/extension/\0") and b[at + 1] == 0xE1:  # guid, whole length, place, piece
            extended.setdefault(body[35:67], []).append((struct.unpack(">I", body[71:75])[0], body[75:], at))
        elif b[at + 1] == 0xE1:
            yield "jpeg", "xmp", _text(body.removeprefix(b"http://ns.adobe.com/xap/1.0/\0")), at
        at += 2 + size
    for pieces in extended.values():
        yield "jpeg", "xmp", _text(b"".join(p for _, p, _ in sorted(pieces))), min(at for *_, at in pieces)


def _riff(b: bytes) -> Iterator[tuple]:
    order = ">" if b[:4] == b"RIFX" else "<"
    at = 12
    while at + 8 <= len(b):
        kind, size = b[at : at + 4], struct.unpack(order + "I", b[at + 4 : at + 8])[0]
        if kind == b"LIST" and b[at + 8 : at + 12] == b"INFO":
            i, end = at + 12, min(at + 8 + size, len(b))
            while i + 8 <= end:
                n = struct.unpack(order + "I", b[i + 4 : i + 8])[0]
                name = b[i : i + 4].decode("latin-1")
                yield "wave", RIFF_INFO.get(name, name), b[i + 8 : i + 8 + n].rstrip(b"\0").decode("utf-8", "replace"), i
                i += 8 + n + n % 2
        elif kind == b"bext":
            yield "wave", "originator", b[at + 8 + 256 : at + 8 + 288].rstrip(b"\0").decode("latin-1"), at
        elif kind in (b"iXML", b"_PMX", b"XMP "):
            yield "wave", kind.decode().strip(), str(size), at
        at += 8 + size + size % 2


def _id3_texts(body: bytes) -> list[str]:
    """The strings of a text frame, by its first byte's encoding."""
    codec = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
    return [p for p in (p.strip("\ufeff") for p in _text(body[1:], codec).split("\0")) if p]


def _id3(b: bytes) -> Iterator[tuple]:
    if b[:3] == b"ID3" and len(b) >= 10:
        if b[3] not in (2, 3, 4) or b[3] == 2 and b[5] & 0x40:
            raise ValueError("id3 version")
        safe = lambda raw: sum(x << s for x, s in zip(raw, (21, 14, 7, 0), strict=True))
        width, head = (3, 6) if b[3] == 2 else (4, 10)
        at, end = 10, min(10 + safe(b[6:10]), len(b))
        if b[3] > 2 and b[5] & 0x40:
            at += safe(b[10:14]) if b[3] == 4 else struct.unpack(">I", b[10:14])[0] + 4
        while at + head <= end and b[at]:
            raw = b[at + width : at + width + (3 if b[3] == 2 else 4)]
            n = safe(raw) if b[3] == 4 else int.from_bytes(raw)
            name, body = b[at : at + width].decode("latin-1"), b[at + head : at + head + n]
            name = ID3V22.get(name, name)
            if name == "COMM" and len(body) > 4:  # encoding, language, description, text
                yield "mp3", name, ": ".join(_id3_texts(body[:1] + body[4:])), at
            elif name[0] == "T" and body:
                yield "mp3", name, (": " if name == "TXXX" else "; ").join(_id3_texts(body)), at
            at += head + n
    if len(b) >= 128 and b[-128:-125] == b"TAG":
        for name, a, z in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("comment", 97, 127)):
            if value := b[len(b) - 128 + a : len(b) - 128 + z].rstrip(b"\0 ").decode("latin-1"):
                yield "mp3", name, value, len(b) - 128 + a


def _flac(b: bytes) -> Iterator[tuple]:
    at, last = 4, False
    while not last and at + 4 <= len(b):
        last, kind, size = bool(b[at] & 0x80), b[at] & 0x7F, int.from_bytes(b[at + 1 : at + 4])
        body = b[at + 4 : at + 4 + size]
        if kind == 4:
            n = struct.unpack("<I", body[:4])[0]
            yield "flac", "vendor", body[4 : 4 + n].decode("utf-8", "replace"), at
            i = 8 + n
            for k in range(struct.unpack("<I", body[4 + n : 8 + n])[0]):
                if k >= MAX_EVENTS:
                    raise OverflowError("comments")
                n = struct.unpack("<I", body[i : i + 4])[0]
                key, _, value = body[i + 4 : i + 4 + n].decode("utf-8", "replace").partition("=")
                yield "flac", key.lower(), value, at + 4 + i
                i += 4 + n
        at += 4 + size


def _boxes(b: bytes, start: int, end: int, depth: int) -> Iterator[tuple]:
    if depth > MAX_BOXES:
        raise OverflowError("depth")
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", b[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("box")
        name = kind.decode("latin-1")
        if name in ("moov", "udta", "trak", "mdia"):
            yield from _boxes(b, at + head, at + size, depth + 1)
        elif name == "meta":  # QuickTime's has no version before its boxes
            yield from _meta(b, at + head + (0 if b[at + head + 4 : at + head + 8] == b"hdlr" else 4), at + size, depth + 1)
        elif name == "XMP_" or name == "uuid" and b[at + head : at + head + 16] == XMP_UUID:
            yield "bmff", "xmp", _text(b[at + head + (16 if name == "uuid" else 0) : at + size]), at
        elif name in ATOMS and (values := _item_values(b, at + head, at + size)):
            yield from (("bmff", ATOMS[name], value, at) for _, value in values)
        elif name[0] == "©":
            n = struct.unpack(">H", b[at + head : at + head + 2])[0]
            yield "bmff", name, b[at + head + 4 : at + head + 4 + n].decode("utf-8", "replace"), at
        else:
            yield "bmff", "box", name, at
        at += size


def _spans(b: bytes, start: int, end: int) -> list[tuple[str, int, int]]:
    """(type, begin of the content, end) of the boxes between two places."""
    at, out = start, []
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        if size < 8 or at + size > end:
            raise ValueError("box")
        out.append((kind.decode("latin-1"), at + 8, at + size))
        at += size
    return out


def _item_values(b: bytes, start: int, end: int) -> list[tuple[str, str]]:
    """(name, value) of an item's data boxes; nothing if it holds a plain string instead."""
    try:
        boxes = _spans(b, start, end)
    except ValueError:
        return []
    name, out = "", []
    for kind, a, z in boxes:
        if kind == "name":
            name = _text(b[a + 4 : z])
        elif kind == "data" and z - a >= 8:
            code, raw = struct.unpack(">I", b[a : a + 4])[0], b[a + 8 : z]
            if code in (21, 22) and len(raw) <= 8:
                value = str(int.from_bytes(raw, signed=code == 21))
            elif code in (13, 14, 27):
                value = f"<{len(raw)} bytes, data type {code}>"
            else:
                try:
                    raw.decode("utf-16-be" if code == 2 else "utf-8")
                    value = _text(raw, "utf-16-be" if code == 2 else "utf-8")
                except UnicodeDecodeError:  # not a text, whatever its code says
                    value = f"<{len(raw)} bytes, data type {code}>"
            out.append((name, value))
    return out


def _meta(b: bytes, start: int, end: int, depth: int) -> Iterator[tuple]:
    """A meta box: names in keys, values in ilst; other boxes as anywhere."""
    boxes = _spans(b, start, end)
    keys: dict[int, str] = {}
    for kind, a, z in boxes:
        if kind == "keys":
            keys = {i: _text(b[x:y]) for i, (_, x, y) in enumerate(_spans(b, a + 8, z), 1)}
    for kind, a, z in boxes:
        if kind == "ilst":
            for item, x, y in _spans(b, a, z):
                field = keys.get(int.from_bytes(item.encode("latin-1"))) or ATOMS.get(item) or item
                yield from (("bmff", name or field, value, x - 8) for name, value in _item_values(b, x, y))
        elif kind != "keys":
            yield from _boxes(b, a - 8, z, depth)


def _vint(b: bytes, at: int, end: int, marked: bool) -> tuple[int, int]:
    """An EBML number and its width; identifiers keep their marker."""
    width = 9 - b[at].bit_length() if at < end else 9
    if width > (4 if marked else 8) or at + width > end:
        raise ValueError("ebml number")
    value = int.from_bytes(b[at : at + width])
    return value if marked else value & ((1 << 7 * width) - 1), width


def _elements(b: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, begin, end) of the elements between two places; what an element of unknown size holds follows it."""
    at, events = start, 0
    while at < end:
        events += 1
        if events > MAX_EVENTS:
            raise OverflowError("elements")
        kind, n = _vint(b, at, end, True)
        size, m = _vint(b, at + n, end, False)
        at += n + m
        if size == (1 << 7 * m) - 1:
            continue
        if at + size > end:
            raise ValueError("ebml size")
        yield kind, at, at + size
        at += size


def _simple_tag(b: bytes, start: int, end: int, depth: int) -> Iterator[tuple]:
    if depth > MAX_BOXES:
        raise OverflowError("depth")
    name = value = ""
    nested: list[tuple] = []
    at = start
    for kind, a, z in _elements(b, start, end):
        if kind == 0x45A3:
            name = _text(b[a:z]).casefold()
        elif kind == 0x4487:
            value, at = _text(b[a:z]), a
        elif kind == 0x67C8:
            nested += _simple_tag(b, a, z, depth + 1)
    if name and value:
        yield "ebml", name, value, at
    yield from nested


def _ebml_fields(b: bytes, start: int, end: int, depth: int) -> Iterator[tuple]:
    if depth > MAX_BOXES:
        raise OverflowError("depth")
    for kind, a, z in _elements(b, start, end):
        if kind == 0x67C8:
            yield from _simple_tag(b, a, z, depth + 1)
        elif kind in EBML_MASTERS:
            yield from _ebml_fields(b, a, z, depth + 1)
        elif kind in EBML_TEXT and (value := _text(b[a:z])):
            yield "ebml", EBML_TEXT[kind], value, a


def _ebml(b: bytes) -> Iterator[tuple]:
    rows = list(_ebml_fields(b, 0, len(b), 0))
    if next((v.casefold() for _, f, v, _ in rows if f == "document_type"), "") not in ("webm", "matroska"):
        raise ValueError("document type")
    return iter(rows)


def _pdf(b: bytes) -> Iterator[tuple]:
    if b"%%EOF" not in b[-1024:]:
        raise ValueError("no end of file")
    for key in PDF_INFO:
        for m in re.finditer(rb"/" + key.encode() + rb"\s*\(((?:[^()\\]|\\.)*)\)", b):
            yield "pdf", key, re.sub(rb"\\(.)", rb"\1", m[1]).decode("utf-8", "replace"), m.start()
    for marker in (b"/EmbeddedFile", b"/Filespec", b"/Annots"):
        if (at := b.find(marker)) >= 0:
            yield "pdf", "marker", marker.decode()[1:], at


def metadata_of(content: bytes | None) -> Iterator[tuple]:
    """(container, field, value, offset) by the content's signature; office packages come through package_of."""
    b = content or b""
    if b.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(b)
    if b.startswith(b"\xff\xd8"):
        return _jpeg(b)
    if b[:4] in (b"RIFF", b"RIFX") and b[8:12] == b"WAVE":
        return _riff(b)
    if b.startswith(b"fLaC"):
        return _flac(b)
    if b.startswith(b"%PDF-"):
        return _pdf(b)
    if b[4:8] == b"ftyp":
        return _boxes(b, 0, len(b), 0)
    if b.startswith(b"PK\x03\x04"):
        return (("package", f"{part}:{kind}:{name}", value, 0) for part, kind, name, value in package_of(b))
    if b.startswith(b"\x1aE\xdf\xa3"):
        return _ebml(b)
    frame = len(b) > 2 and b[0] == 0xFF and b[1] & 0xE6 > 0xE0 and b[2] & 0x0C < 0x0C
    if b and not frame and b[:3] != b"ID3" and b[-128:-125] != b"TAG":
        raise ValueError("signature")
    return _id3(b)


def container_metadata(files: DataFrame) -> DataFrame:
    """The metadata of images, audio, video, PDF and office files, as binaryFile reads them."""
    return parsed(files, "content", lambda c: ((k, f, v, o) for k, f, v, o in metadata_of(c)), "container string, field string, value string, byte_offset long")


def metadata_findings(entries: DataFrame) -> DataFrame:
    """What each field is, whether it may go, and which attribution it spells."""
    last = F.when(F.col("container") == "package", F.substring_index("field", ":", -1)).otherwise(F.col("field"))
    name = F.regexp_replace(F.lower(last), r"^com\.apple\.quicktime\.", "")
    category = (
        F.when(name.isin("author", "artist", "creator", "engineer", "originator", "lastmodifiedby", "tpe1", "©art", "album_artist", "composer", "copyright", "owner", "cameraownername", "xpauthor"), "personal_metadata")
        .when(name.isin("software", "producer", "application", "generator", "encoder", "vendor", "tsse", "tenc", "©too", "encoder_software", "writing_application", "muxing_application", "processingsoftware", "hostcomputer"), "generator_metadata")
        .when(F.col("container").isin("png", "jpeg", "exif"), "image_metadata")
        .when(F.col("container").isin("pdf", "package"), "document_metadata")
        .otherwise("media_metadata")
    )
    protected = F.lit(False)
    for marker in PROTECTED_MARKERS:
        protected = protected | F.lower("value").contains(marker)
    return entries.where("error is null and field <> 'box'").select("artifact_path", "container", "field", "value", F.when(protected, "c2pa_provenance").otherwise(category).alias("category"), (~protected & ~((F.col("container") == "exif") & F.col("field").isin(*RENDERING))).alias("removable"), _rule_hits("value", METADATA).alias("provider"))


#: Pages with planted traces.
def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    trace = F.concat(
        F.when(F.col("page_id") % 4 == 0, '<meta name="generator" content="Maker 1">').otherwise(""),
        F.when(F.col("page_id") % 5 == 0, '<div style="display: none">x</div>').otherwise(""),
        F.when(F.col("page_id") % 6 == 0, '<img src="data:image/png;base64,AA">').otherwise(""),
        F.when(F.col("page_id") % 7 == 0, "<!-- generated by ChatGPT -->").otherwise(""),
    )
    return p.select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("artifact_path"), "page_id", F.concat(F.coalesce("html", F.lit("")), trace).alias("text"))


#: The planted pages for DuckDB, piece by piece: what stands before each trace tells where it is.
_PLANTED_PAGES = """SELECT *, b || CASE WHEN page_id % 7 = 0 THEN '<!-- generated by ChatGPT -->' ELSE '' END AS text FROM (SELECT *, i || CASE WHEN page_id % 6 = 0 THEN '<img src="data:image/png;base64,AA">' ELSE '' END AS b FROM (SELECT *, m || CASE WHEN page_id % 5 = 0 THEN '<div style="display: none">x</div>' ELSE '' END AS i
  FROM (SELECT *, h || CASE WHEN page_id % 4 = 0 THEN '<meta name="generator" content="Maker 1">' ELSE '' END AS m FROM (SELECT concat('page/', page_id, '.html') AS artifact_path, page_id, coalesce(html, '') AS h FROM pages))))"""
_LINE = "CAST(length({p}) - length(replace({p}, chr(10), '')) + 1 AS INT) AS line"


@query(
    "html_findings",
    f"""WITH p AS ({_PLANTED_PAGES}), s AS (SELECT artifact_path, regexp_extract_all(text, '(?is)(.*?)<script[ >]', 1) AS before FROM p), t AS (SELECT artifact_path, array_to_string(before[1:i], '') AS head FROM (SELECT artifact_path, before, unnest(range(1, len(before) + 1)) AS i FROM s WHERE len(before) > 0))
    SELECT artifact_path, 'generator_metadata' AS category, 'Maker 1' AS detail, true AS removable, {_LINE.format(p="h")} FROM p WHERE page_id % 4 = 0 UNION ALL SELECT artifact_path, 'hidden_element', 'display:none', false, {_LINE.format(p="m")} FROM p WHERE page_id % 5 = 0
    UNION ALL SELECT artifact_path, 'structural_signal', 'data uri', false, {_LINE.format(p="i")} FROM p WHERE page_id % 6 = 0 UNION ALL SELECT artifact_path, 'generated_comment', 'openai', true, {_LINE.format(p="b")} FROM p WHERE page_id % 7 = 0
    UNION ALL SELECT artifact_path, 'security_issue', 'script', false, {_LINE.format(p="head")} FROM t""",
)
def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_findings(html_events(planted_pages(spark, sf_dir)))


#: Fragments whose shape their numbers tell: nested boxes, items, an image, an unclosed tag, one closed twice.
_FRAGMENTS = """SELECT concat('frag/', p_partkey) AS artifact_path, p_size % 7 AS a, p_partkey % 4 AS b, p_partkey % 3 AS c, p_partkey % 2 AS d,
  concat('<main id="m">', repeat('<div class="x y">', CAST(p_size % 7 AS INT)), 'text', repeat('</div>', CAST(p_size % 7 AS INT)), repeat('<p id="q" style="s">t</p>', CAST(p_partkey % 4 AS INT)), repeat('<img src="u.png">', CAST(p_partkey % 3 AS INT)), CASE WHEN p_partkey % 2 = 1 THEN '<b>open' ELSE '</i><!-- c -->' END) AS text FROM part"""


@query(
    "dom_topology",
    f"""WITH f AS ({_FRAGMENTS}) SELECT artifact_path, CAST(1 + a + b + c + d AS INT) AS elements, CAST(greatest(1 + a, CASE WHEN b + d > 0 THEN 2 ELSE 1 END) AS INT) AS max_depth, CAST(c AS INT) AS void_elements, CAST(1 - d AS INT) AS mismatched_closes, CAST(1 + d AS INT) AS unclosed_elements, CAST(greatest(a - 1, 0) AS INT) AS wrapper_only_elements, CAST(1 - d AS INT) AS comments,
    CAST(b AS INT) AS inline_styles, CAST(CASE WHEN b > 0 THEN 2 ELSE 1 END AS INT) AS distinct_ids, CAST(CASE WHEN b > 1 THEN 1 ELSE 0 END AS INT) AS duplicate_ids, CAST(2 * a AS INT) AS class_tokens, CAST(CASE WHEN a > 0 THEN 2 ELSE 0 END AS INT) AS distinct_class_tokens, CAST(1 + a + 2 * b + c AS INT) AS attributes, CAST(4 + b + 4 * d AS INT) AS text_characters,
    CAST(length(text) - 4 - b - 4 * d AS INT) AS markup_characters, 0::INT AS script_elements, 0::INT AS style_elements, CAST(c AS INT) AS external_references, CAST(NULL AS VARCHAR) AS truncated_by, CAST(NULL AS VARCHAR) AS error FROM f""",
)
def q_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_topology(bound(spark, sf_dir, _FRAGMENTS, part=dealt(spark, sf_dir, "part", "p_partkey")))


@query(
    "dom_histograms",
    f"""WITH f AS ({_FRAGMENTS}), t AS (SELECT artifact_path, 'tag' AS histogram, unnest(['main', 'div', 'p', 'img', 'b']) AS value, unnest([1, a, b, c, d]) AS n FROM f), e AS (SELECT artifact_path, unnest(range(1, 9)) AS depth, a, b, d FROM f)
    SELECT artifact_path, histogram, value, CAST(n AS INT) AS n FROM t WHERE n > 0 UNION ALL SELECT artifact_path, 'depth', CAST(depth AS VARCHAR), CAST(n AS INT) FROM (SELECT artifact_path, depth, CASE WHEN depth = 1 THEN 1 ELSE 0 END + CASE WHEN depth BETWEEN 2 AND a + 1 THEN 1 ELSE 0 END + CASE WHEN depth = 2 THEN b + d ELSE 0 END AS n FROM e) WHERE n > 0""",
)
def q_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_histograms(bound(spark, sf_dir, _FRAGMENTS, part=dealt(spark, sf_dir, "part", "p_partkey"))).select("artifact_path", "histogram", "value", "n")


#: Style sheets with numbers of rules, declarations and selectors that vary, inside and outside at-rules.
_SHEETS = """SELECT concat('css/', p_partkey) AS artifact_path, concat('/* a { */ @media x { .a { color: red } .b, p > q { margin: 1px; --v: 2 } } ', CASE WHEN p_size % 4 = 0 THEN '.c{display : none}' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN '.d { background: url( data:x) !important; -webkit-x: 1 }' ELSE '' END,
  repeat('.r { a: b; c: d !important }', CAST(p_partkey % 4 AS INT)), CASE WHEN p_partkey % 6 = 0 THEN ' .open { x: y' ELSE '' END) AS text FROM part"""


@query(
    "stylesheet_features",
    rf"""WITH s AS ({_SHEETS}), b AS (SELECT artifact_path, regexp_replace(text, '/\*.*?\*/', '', 'g') AS t FROM s), r AS (SELECT artifact_path, t, regexp_extract_all(t, '\{{([^{{}}]*)\}}', 1) AS bodies FROM b)
    SELECT artifact_path, CAST(len(bodies) AS INT) AS rules, CAST(len(list_filter(bodies, lambda x: regexp_matches(x, 'display\s*:\s*none'))) AS INT) AS hiding_rules, CAST(len(regexp_extract_all(t, 'url\(\s*data:')) AS INT) AS data_uris, CAST(coalesce(list_sum(list_transform(bodies, lambda x: length(x) - length(replace(x, ':', '')))), 0) AS INT) AS declarations, CAST(coalesce(list_sum(list_transform(bodies, lambda x: len(regexp_extract_all(x, '!important')))), 0) AS INT) AS important FROM r""",
)
def q_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylesheet_features(bound(spark, sf_dir, _SHEETS, part=dealt(spark, sf_dir, "part", "p_partkey"))).select("artifact_path", "rules", "hiding_rules", "data_uris", "declarations", "important")


_SHEET_SQL = rf"""s AS ({_SHEETS}), b AS (SELECT artifact_path, regexp_replace(text, '/\*.*?\*/', ' ', 'g') AS t, len(regexp_extract_all(text, '/\*.*?\*/')) AS comments FROM s), r AS (SELECT *, regexp_extract_all(t, '([^{{}}]*)\{{[^{{}}]*\}}', 1) AS heads, regexp_extract_all(t, '\{{([^{{}}]*)\}}', 1) AS bodies FROM b),
    sel AS (SELECT artifact_path, trim(x) AS selector FROM (SELECT artifact_path, unnest(flatten(list_transform(heads, lambda h: string_split(h, ',')))) AS x FROM r)), dec AS (SELECT artifact_path, lower(trim(split_part(x, ':', 1))) AS name, lower(x) AS x FROM (SELECT artifact_path, unnest(flatten(list_transform(bodies, lambda h: string_split(h, ';')))) AS x FROM r) WHERE contains(x, ':'))"""


@query(
    "sheet_measures",
    f"""WITH {_SHEET_SQL}, q AS (SELECT artifact_path, count(*) AS selectors, max(len(string_split(selector, ' '))) AS parts, count(*) - count(DISTINCT selector) AS extra FROM sel GROUP BY 1), u AS (SELECT artifact_path, count(*) AS n FROM (SELECT artifact_path, selector FROM sel GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
    e AS (SELECT artifact_path, count(*) AS declarations, count(*) FILTER (WHERE contains(x, '!important')) AS important, count(*) FILTER (WHERE starts_with(name, '-webkit-')) AS vendor, count(*) FILTER (WHERE starts_with(name, '--')) AS custom, count(DISTINCT name) AS properties, count(*) FILTER (WHERE contains(replace(x, ' ', ''), 'url(data:')) AS uris FROM dec GROUP BY 1)
    SELECT artifact_path, CAST(1 + len(bodies) AS INT) AS rules, CAST(selectors AS INT) AS selectors, CAST(declarations AS INT) AS declarations, CAST(important AS INT) AS important_declarations, CAST(vendor AS INT) AS vendor_prefixed_properties, CAST(custom AS INT) AS custom_properties, CAST(parts AS INT) AS max_selector_parts,
      CAST(coalesce(n, 0) AS INT) AS duplicate_selectors, CAST(properties AS INT) AS distinct_properties, CAST(comments AS INT) AS comments, CAST(uris AS INT) AS embedded_data_uris FROM r JOIN q USING (artifact_path) JOIN e USING (artifact_path) LEFT JOIN u USING (artifact_path)""",
)
def q_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_measures(bound(spark, sf_dir, _SHEETS, part=dealt(spark, sf_dir, "part", "p_partkey"))).select("artifact_path", *SHEET_COUNTS)


@query("sheet_properties", f"WITH {_SHEET_SQL} SELECT artifact_path, name AS value, CAST(count(*) AS INT) AS n FROM dec GROUP BY 1, 2")
def q_sheet_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_histograms(bound(spark, sf_dir, _SHEETS, part=dealt(spark, sf_dir, "part", "p_partkey"))).where("histogram = 'property'").select("artifact_path", "value", "n")


#: Source files whose comments begin on lines that vary.
_SOURCES = """SELECT concat('src/', conv_id, '-', turn, CASE WHEN turn % 2 = 0 THEN '.py' ELSE '.js' END) AS artifact_path, concat(repeat('\n', CAST(conv_id % 5 AS INT)), CASE WHEN turn % 2 = 0 THEN concat('x = 1 # n\ny = ''created with Codex # no comment''\n# ', CASE WHEN conv_id % 3 = 0 THEN 'generated by ChatGPT' WHEN conv_id % 3 = 1 THEN 'see written by Claude' ELSE 'plain' END, '\n')
  ELSE concat('let x = 1; // n\n/* ', CASE WHEN conv_id % 3 = 0 THEN 'generated by ChatGPT' WHEN conv_id % 3 = 1 THEN 'see written by Claude' ELSE 'plain' END, ' */\n') END) AS text FROM conversations"""


@query(
    "comment_findings",
    f"""SELECT concat('src/', conv_id, '-', turn, CASE WHEN turn % 2 = 0 THEN '.py' ELSE '.js' END) AS artifact_path, CAST(conv_id % 5 + CASE WHEN turn % 2 = 0 THEN 3 ELSE 2 END AS INT) AS line, CASE WHEN conv_id % 3 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, turn % 2 = 0 AS verified, 'generated_comment' AS category, CASE WHEN turn % 2 = 0 THEN 0.99 ELSE 0.65 END::DOUBLE AS confidence
    FROM conversations WHERE conv_id % 3 < 2""",
)
def q_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_findings(source_comments(bound(spark, sf_dir, _SOURCES).select("artifact_path", "text")))


def sample_files() -> dict[str, bytes]:
    """A small file of each container, with metadata to find."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Software\0generated by ChatGPT") + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xfe" + struct.pack(">H", 7) + b"hello" + b"\xff\xd9"
    info = b"INFOISFT" + struct.pack("<I", 6) + b"Maker\0" + b"IART" + struct.pack("<I", 4) + b"Anna"
    wave = b"RIFF" + struct.pack("<I", 4 + 8 + len(info)) + b"WAVELIST" + struct.pack("<I", len(info)) + info
    vorbis = struct.pack("<I", 3) + b"lib" + struct.pack("<I", 1) + struct.pack("<I", 11) + b"ARTIST=Anna"
    flac = b"fLaC\x84" + len(vorbis).to_bytes(3) + vorbis
    frame = b"TPE1" + struct.pack(">I", 5) + b"\0\0" + b"\x03Anna"
    mp3 = b"ID3\x03\0\0" + bytes([0, 0, 0, len(frame)]) + frame
    pdf = b"%PDF-1.4\n1 0 obj << /Author (Anna) /Producer (Maker) >> endobj\n%%EOF"
    bmff = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8 + 20) + b"moov" + struct.pack(">I", 20) + b"\xa9nam" + struct.pack(">HH", 8, 0) + b"A title!"
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    data = lambda text: box(b"data", struct.pack(">II", 1, 0) + text)
    keys = box(b"keys", struct.pack(">II", 0, 1) + box(b"mdta", b"com.apple.quicktime.software"))
    ilst = box(b"ilst", box(struct.pack(">I", 1), data(b"generated by ChatGPT")) + box(b"\xa9ART", data(b"Anna")))
    items = box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"udta", box(b"meta", b"\0" * 4 + box(b"hdlr", b"\0" * 25) + keys + ilst))) + box(b"uuid", XMP_UUID + b"<x>Anna</x>")
    element = lambda kind, body: bytes.fromhex(kind) + (0x4000 | len(body)).to_bytes(2) + body
    tags = element("1254c367", element("7373", element("67c8", element("45a3", b"ARTIST") + element("4487", b"Anna"))))
    webm = element("1a45dfa3", element("4282", b"webm")) + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + element("1549a966", element("5741", b"Maker")) + bytes.fromhex("1f43b675ff") + element("e7", b"\0") + tags
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + struct.pack("<HHII", 0x013B, 2, 5, 50) + struct.pack("<HHIHH", 0x0112, 3, 1, 1, 0) + struct.pack("<HHII", 0x8769, 4, 1, 55) + b"\0" * 4 + b"Anna\0" + struct.pack("<H", 1) + struct.pack("<HHII", 0x9286, 7, 28, 73) + b"\0" * 4 + b"ASCII\0\0\0generated by ChatGPT"
    photo = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xd9"
    old = b"TP1" + (5).to_bytes(3) + b"\0Anna" + b"COM" + (25).to_bytes(3) + b"\0eng\0generated by ChatGPT"
    note = b"COMM" + struct.pack(">I", 27) + b"\0\0" + b"\0engby\0generated by ChatGPT"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("docProps/core.xml", "<c:core xmlns:c='x' xmlns:d='y'><d:creator>Anna</d:creator></c:core>")
        z.writestr("word/vbaProject.bin", b"x")
        z.writestr("word/_rels/document.xml.rels", "<R><Relationship Target='http://x' TargetMode='External'/></R>")
    return {"a.png": png, "a.jpg": jpeg, "a.wav": wave, "a.flac": flac, "a.mp3": mp3, "a.pdf": pdf, "a.mp4": bmff, "a.docx": held.getvalue(), "items.m4a": items, "a.webm": webm, "photo.jpg": photo, "old.mp3": b"ID3\x02\0\0" + bytes([0, 0, 0, len(old)]) + old, "note.mp3": b"ID3\x03\0\0" + bytes([0, 0, 0, len(note)]) + note, "broken.pdf": b"%PDF-1.4"}


@query(
    "container_metadata",
    """WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer), r AS (
      SELECT k, 'png' AS f, 'png' AS container, 'Software' AS field, 'Maker' AS value, 'generator_metadata' AS category, true AS removable FROM c WHERE k % 12 = 6 UNION ALL SELECT k, 'png', 'png', 'Author', name, 'personal_metadata', true FROM c WHERE k % 12 = 6
      UNION ALL SELECT k, 'jpeg', 'exif', 'Orientation', CAST(1 + k % 8 AS VARCHAR), 'image_metadata', false FROM c WHERE k % 12 = 7 UNION ALL SELECT k, 'jpeg', 'exif', 'Artist', name, 'personal_metadata', true FROM c WHERE k % 12 = 7 UNION ALL SELECT k, 'jpeg', 'jpeg', 'comment', 'made by hand', 'image_metadata', true FROM c WHERE k % 12 = 7
      UNION ALL SELECT k, 'wav', 'wave', 'software', 'Maker', 'generator_metadata', true FROM c WHERE k % 12 = 8 UNION ALL SELECT k, 'wav', 'wave', 'artist', name, 'personal_metadata', true FROM c WHERE k % 12 = 8
      UNION ALL SELECT k, 'mp3', 'mp3', 'TPE1', name, 'personal_metadata', true FROM c WHERE k % 12 = 9 UNION ALL SELECT k, 'mp3', 'mp3', 'TSSE', CASE WHEN k % 5 = 0 THEN 'generated by ChatGPT' ELSE 'Maker' END, 'generator_metadata', true FROM c WHERE k % 12 = 9
      UNION ALL SELECT k, 'flac', 'flac', 'vendor', 'Maker', 'generator_metadata', true FROM c WHERE k % 12 = 10 UNION ALL SELECT k, 'flac', 'flac', 'artist', name, 'personal_metadata', true FROM c WHERE k % 12 = 10)
    SELECT concat('made/', k, '.', f) AS artifact_path, container, field, value, category, removable, CASE WHEN contains(value, 'ChatGPT') THEN 'openai' END AS provider FROM r""",
)
def q_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What images and audio files, made of the customers, tell."""
    from loupe.plans.made import made_files

    return metadata_findings(container_metadata(made_files(spark, sf_dir).where("artifact_type IN ('png', 'jpeg', 'audio')"))).select("artifact_path", "container", "field", "value", "category", "removable", "provider")
