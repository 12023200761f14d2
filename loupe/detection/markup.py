"""Detectors of HTML and SVG."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from loupe.detection.model import Artifact, Incomplete, Observation, Options, attributions, standalone
from loupe.operators.detect_text import HTML_COMMENT, PROTECTED_MARKERS
from loupe.operators.structure import MAX_DEPTH, MAX_UNCLOSED_WORK, measured_topology
from loupe.operators.vector import EDITORS, METADATA, PLACES, SHAPES

_DECLARED = re.compile(r"([\w-]+)\s*:\s*([^;]*)")
_LITERAL = {"evidence_type": "text", "severity": "medium"}


def protected(value: str) -> bool:
    low = value.casefold()
    return any(marker in low for marker in PROTECTED_MARKERS)


def unclosed_tags(text: str) -> int:
    """Opening brackets that no closing one follows before the next opening one."""
    return sum(">" not in piece for piece in text.split("<")[1:])


def guard(text: str) -> None:
    if (n := unclosed_tags(text)) * len(text) > MAX_UNCLOSED_WORK:
        raise Incomplete(f"{n} tags never close in {len(text)} characters")


def style_reasons(style: str) -> list[str]:
    """Why an inline style hides, by its text without blanks."""
    tight = style.replace(" ", "").casefold()
    return [reason for sign, reason in (("display:none", "display:none"), ("visibility:hidden", "visibility:hidden"), ("opacity:0", "zero opacity")) if sign in tight]


class _Events(HTMLParser):
    """(kind, line, column, tag, attributes, raw or comment) of start tags and comments, up to a number of them."""

    def __init__(self, most: int) -> None:
        super().__init__(convert_charrefs=True)
        self.most, self.seen = most, []

    def _add(self, kind: str, tag: str | None, attrs: list, raw: str) -> None:
        if len(self.seen) >= self.most:
            raise Incomplete("too many markup events")
        line, column = self.getpos()
        self.seen.append((kind, line, column, tag, attrs, raw))

    def handle_starttag(self, tag, attrs):
        self._add("tag", tag, attrs, self.get_starttag_text() or "")

    def handle_comment(self, data):
        self._add("comment", None, [], data)


class Html:
    id, experimental = "web.html-forensics.v1", False
    types = frozenset(("html",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        text = artifact.string
        guard(text)
        events = _Events(options.max_parser_events)
        events.feed(text)
        events.close()
        shape = measured_topology(text)
        if shape["elements"]:
            yield Observation("structural_signal", "document topology", shape, tags=("html", "topology", "measurement"))
        for kind, line, column, tag, attrs, raw in events.seen:
            at = artifact.line_start(line) + column
            where = {"line": line, "column": column + 1}
            if kind == "comment":
                yield from self._comment(text, raw, at, where)
            else:
                yield from self._element(tag, {k.casefold(): v or "" for k, v in attrs}, raw, at, where)

    def _comment(self, text: str, data: str, at: int, where: dict) -> Iterator[Observation]:
        close = text.find("-->", at)
        end = len(text) if close < 0 else close + 3
        for rule, provider, confidence, m in attributions(data, HTML_COMMENT):
            alone = standalone(data, m.start(), m.end())
            evidence = {"rule_id": rule, "match": m[0], "comment": data, "comment_start": at, "comment_end": end, "comment_raw": text[at:end]}
            yield Observation("generated_comment", "attribution in an HTML comment", evidence, where, confidence=confidence, provider=provider, provenance="attribution", remediation="html.remove-attribution-comment" if alone else None, tags=("html", "comment", "literal", provider), **_LITERAL)

    def _element(self, tag: str, attrs: dict[str, str], raw: str, at: int, where: dict) -> Iterator[Observation]:
        if tag == "meta" and attrs.get("name", "").casefold() == "generator":
            evidence = {"tag": "meta", "name": "generator", "content": attrs.get("content", ""), "tag_start": at, "tag_end": at + len(raw), "tag_raw": raw}
            yield Observation("generator_metadata", "generator metadata", evidence, where, "medium", evidence_type="metadata", remediation="html.remove-generator-metadata", provenance="metadata", tags=("html", "metadata", "generator"))
        if reasons := ["hidden attribute"] * ("hidden" in attrs) + style_reasons(attrs.get("style", "")):
            yield Observation("hidden_element", "hidden element", {"tag": tag, "reasons": reasons}, where, "low", tags=("html", "hidden", "not-provenance"))
        if tag == "script":
            yield Observation("security_issue", "embedded script", {"tag": "script", "src": attrs.get("src", "inline")}, where, "low", evidence_type="security", tags=("html", "script", "passive-scan"))
        for name, value in attrs.items():
            if value.lstrip().casefold().startswith("data:"):
                yield Observation("structural_signal", "embedded data URI", {"tag": tag, "attribute": name}, where, tags=("html", "data-uri"))


class _Tree:
    """The elements of an SVG file in document order: tag, attributes, depth, and whether a metadata block holds them."""

    def __init__(self, data: bytes) -> None:
        self.elements: list[tuple[str, dict[str, str], int, bool]] = []
        self.blocks: dict[int, tuple[list[str], list[str]]] = {}  # element: what it holds, by markup and by text
        self.nested: dict[int, set[str]] = {}
        self.comments: list[str] = []
        self._open: list[int] = []
        self._block: int | None = None
        p = xml.parsers.expat.ParserCreate(namespace_separator=" ")
        p.namespace_prefixes = False
        p.StartDoctypeDeclHandler = self._refuse
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.CommentHandler = self._start, self._end, self._text, self.comments.append
        p.Parse(data, True)

    def _refuse(self, *_):
        raise Incomplete("a document type is declared", "unsafe_artifact")

    def _start(self, name, attrs):
        tag, n = name.split(" ")[-1], len(self.elements)
        if len(self._open) >= MAX_DEPTH:
            raise Incomplete("elements nest too deep")
        self.elements.append((tag, attrs, len(self._open), self._block is not None))
        if self._block is not None:
            self.blocks[self._block][0].append(name + " " + " ".join(f"{k}={v}" for k, v in attrs.items()))
            if tag in METADATA:
                self.nested[self._block].add(tag)
        elif tag in METADATA:
            self._block, self.blocks[n], self.nested[n] = n, ([name + " " + " ".join(f"{k}={v}" for k, v in attrs.items())], []), set()
        self._open.append(n)

    def _end(self, _):
        if self._open.pop() == self._block:
            self._block = None

    def _text(self, data):
        if self._block is not None:
            self.blocks[self._block][0].append(data)
            self.blocks[self._block][1].append(data)


def _numbers(text: str) -> list[float] | None:
    try:
        return [float(x) for x in re.split(r"[\s,]+", text.strip())]
    except ValueError:
        return None


class Svg:
    id, experimental = "design.svg-forensics.v1", False
    types = frozenset(("svg",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        data = artifact.data
        if data.count(b"<") > options.max_parser_events:
            raise Incomplete("too many markup events")
        try:
            tree = _Tree(data)
        except xml.parsers.expat.ExpatError as error:
            raise Incomplete(str(error), "corrupt_artifact") from error
        if tree.elements[0][0] != "svg":
            raise Incomplete("the root is no svg element", "corrupt_artifact")
        yield from self._comments(tree.comments)
        box = _numbers(tree.elements[0][1].get("viewBox", ""))
        limit = max(10 * max(abs(box[0]), box[2]), 10 * max(abs(box[1]), box[3]), 1000.0) if box and len(box) == 4 and box[2] > 0 and box[3] > 0 else None
        shapes: Counter[str] = Counter()
        defined, used = set(), set()
        for n, (tag, attrs, _, _) in enumerate(tree.elements):
            if n in tree.blocks:
                markup, text = ("".join(x) for x in tree.blocks[n])
                safe = not protected(markup)
                evidence = {"element": tag, "nested_metadata_elements": sorted(tree.nested[n]), "text_excerpt": text[:160], "protected_provenance_marker": not safe}
                yield self._residue("metadata element", evidence, safe, "medium", "svg.remove-metadata-element", ("svg", "metadata", "design-residue"))
            if own := sorted("{" + k.replace(" ", "}", 1) if " " in k else k for k in attrs if any(e in k.casefold() for e in EDITORS)):
                values = [v for k, v in attrs.items() if any(e in k.casefold() for e in EDITORS)]
                yield self._residue("editor attributes", {"element": tag, "attributes": own}, not protected(" ".join([*own, *values])), "low", "svg.remove-editor-attributes", ("svg", "metadata", "editor-residue"))
            if reasons := self._hidden(attrs):
                yield Observation("hidden_element", "hidden element", {"element": tag, "id": attrs.get("id", ""), "reasons": reasons}, None, "low", tags=("svg", "hidden", "not-provenance"))
            if tag == "script":
                yield Observation("security_issue", "embedded script", {"element": "script"}, None, "high", evidence_type="security", tags=("svg", "script", "passive-scan"))
            for key, value in attrs.items():
                if value.lstrip().casefold().startswith("data:"):
                    yield Observation("structural_signal", "embedded data URI", {"element": tag, "attribute": key.split(" ")[-1]}, tags=("svg", "data-uri"))
                used.update(re.findall(r"#([A-Za-z_][\w:.-]*)", value))
            if "id" in attrs:
                defined.add(attrs["id"])
            if tag == "path" and attrs.get("d"):
                shapes[attrs["d"]] += 1
            if limit is not None and tag in SHAPES and any(abs(float(m[0])) > limit for p in PLACES if (m := re.match(r"[-+]?\d+(?:\.\d+)?", attrs.get(p, "")))):
                yield Observation("structural_signal", "far off the canvas", {"element": tag, "id": attrs.get("id", "")}, None, "low", 0.7, "heuristic", provenance="heuristic", tags=("svg", "off-canvas", "heuristic", "not-provenance"))
        if copies := [c for c in shapes.values() if c > 1]:
            yield Observation("structural_signal", "duplicated paths", {"duplicate_groups": len(copies), "largest_group": max(copies)}, tags=("svg", "geometry", "duplication", "not-provenance"))
        if (unused := sorted(defined - used)) and any(tag == "defs" and depth == 1 for tag, _, depth, _ in tree.elements):
            yield Observation("structural_signal", "unreferenced definitions", {"unreferenced_ids": unused[:100]}, None, "info", 0.7, "heuristic", provenance="heuristic", tags=("svg", "defs", "heuristic"))

    def _residue(self, title: str, evidence: dict, safe: bool, severity: str, remediation: str, tags: tuple[str, ...]) -> Observation:
        return Observation("generator_metadata", title, evidence, None, severity, evidence_type="metadata", remediation=remediation if safe else None, provenance="metadata" if safe else "provenance_metadata", tags=(*tags, *(() if safe else ("preserve", "provenance-marker"))))

    def _comments(self, comments: list[str]) -> Iterator[Observation]:
        for data in comments:
            content = f"<!--{data}-->"
            safe = not protected(content)
            if re.search(r"(?i)\b(?:generator|created with|exported by)\b", content):
                yield Observation("generator_metadata", "generator comment", {"comment": content[:300]}, None, "low", 0.95, evidence_type="metadata", remediation="svg.remove-generator-comment" if safe else None, provenance="metadata" if safe else "provenance_metadata", tags=("svg", "comment", "generator", *(() if safe else ("preserve", "provenance-marker"))))
            for rule, provider, confidence, m in attributions(content, HTML_COMMENT):
                may = safe and standalone(content, m.start(), m.end())
                yield Observation("explicit_ai_attribution", "attribution in an SVG comment", {"rule_id": rule, "match": m[0]}, None, confidence=confidence, provider=provider, remediation="svg.remove-attribution-comment" if may else None, provenance="attribution" if safe else "provenance_metadata", tags=("svg", "comment", "literal", provider), **_LITERAL)

    @staticmethod
    def _hidden(attrs: dict[str, str]) -> list[str]:
        """Why an element hides: presentation attributes count as declarations, and inline ones as well."""
        inline = {k.casefold(): v.strip().casefold() for k, v in _DECLARED.findall(attrs.get("style", ""))}
        said = lambda name: (attrs.get(name, "").casefold(), inline.get(name, "").replace(" ", ""))
        plain, styled = said("opacity")
        return [
            reason
            for reason, hides in (
                ("display:none", said("display")[0] == "none" or said("display")[1].startswith("none")),
                ("visibility:hidden", said("visibility")[0] == "hidden" or said("visibility")[1].startswith("hidden")),
                ("zero opacity", plain in ("0", "0.0", "0.00") or re.match(r"0(?:\.0+)?\Z", styled) is not None),
            )
            if hides
        ]
