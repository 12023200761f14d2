"""Detectors of plain text, source code and style sheets."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from loupe.detection.model import Artifact, Incomplete, Observation, Options, attributions, excerpt, standalone
from loupe.operators.detect_text import BIDI_CONTROLS, COMMENT, INVISIBLE_CLASSES, NAMED, PROTECTED_MARKERS, REMOVABLE, TEXT_CONTEXT, WHITESPACE

_USUAL = frozenset(map(chr, range(0x20, 0x7F))) | frozenset("\t\n\r")
_LITERAL = {"evidence_type": "text", "severity": "medium", "provenance": "attribution"}


@lru_cache(maxsize=1 << 14)
def _told(c: str) -> bool:
    return c == "\ufeff" or classified(c, 1) is not None


@lru_cache(maxsize=1 << 10)
def _any_of(chars: frozenset[str]) -> re.Pattern[str]:
    return re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]")


def unusual(text: str) -> Iterator[re.Match[str]]:
    """The characters that have a class, place by place; which of a text's have one is settled once for each that it uses."""
    chars = frozenset(c for c in set(text) - _USUAL if _told(c))
    return _any_of(chars).finditer(text) if chars else iter(())


def spaced(text: str) -> Iterator[tuple[str, re.Match[str]]]:
    """(pattern, match) of unusual white space; a text without eight blanks or four line breaks in a row is told by a search for them."""
    blank = text.replace("\t", " ")
    may = {"long-run": " " * 8 in blank, "blank-lines": "\n" * 4 in blank.replace(" ", "").replace("\r", "")}
    for name, pattern in WHITESPACE:
        if may[name]:
            yield from ((name, m) for m in re.finditer(pattern, text))


def classified(c: str, offset: int) -> tuple[str, str] | None:
    """(safety class, severity) of an unusual character, by the first rule that names it."""
    code = ord(c)
    if code == 0xFEFF and not offset:
        return "safe", "info"
    if code in BIDI_CONTROLS:
        return "control", "medium"
    if 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return "language_dependent", "info"
    if code in NAMED:
        return NAMED[code]
    kind = unicodedata.category(c)
    if kind in ("Cc", "Cf"):
        return ("control", "medium") if kind == "Cc" else ("suspicious", "low")
    return ("typographic", "info") if c.isspace() else None


class UnicodeForensics:
    id, experimental = "text.unicode-forensics.v1", False
    types = frozenset(("text", "markdown", "source_code", "html", "css", "svg"))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        text = artifact.string
        for m in unusual(text):
            kind, severity = classified(m[0], m.start())
            code, name = f"U+{ord(m[0]):04X}", unicodedata.name(m[0], "UNNAMED CHARACTER")
            yield Observation(
                "invisible_unicode" if kind in INVISIBLE_CLASSES else "suspicious_unicode",
                f"{name} ({code})",
                {"character": m[0], "code_point": code, "unicode_name": name, "safety_class": kind, "context": excerpt(text, m.start())},
                artifact.place(m.start(), m.end()),
                severity,
                evidence_type="text",
                remediation="text.remove-invisible" if ord(m[0]) in REMOVABLE else None,
                tags=("unicode", kind),
            )
        for name, m in spaced(text):
            shown = m[0].encode("unicode_escape").decode("ascii")
            yield Observation("suspicious_unicode", name, {"length": len(m[0]), "escaped": shown}, artifact.place(m.start(), m.end()), confidence=0.65, confidence_type="heuristic", tags=("whitespace", "heuristic"))


class ExplicitAttribution:
    id, experimental = "text.explicit-attribution.v1", False
    types = frozenset(("text", "markdown"))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        text = artifact.string
        for rule, provider, confidence, m in attributions(text, TEXT_CONTEXT):
            start, _ = artifact.line_span(m.start())
            stop = text.find("\n", m.end())
            end = len(text) if stop < 0 else stop + 1
            line = text[start:end].rstrip("\r\n")
            alone = standalone(line, m.start() - start, m.end() - start)
            evidence = {"rule_id": rule, "match": m[0], "line_text": line, "line_raw": text[start:end], "line_start": start, "line_end": end}
            yield Observation("explicit_ai_attribution", "explicit attribution", evidence, artifact.place(m.start(), m.end()), confidence=confidence, provider=provider, remediation="text.remove-attribution-line" if alone else None, tags=("attribution", "literal", provider), **_LITERAL)


class ProtectedMarker:
    """The first provenance marker in the bytes; it is only seen, never verified, and always kept."""

    id, experimental = "provenance.c2pa-marker.v1", False
    types = frozenset(("svg", "pdf", "png", "jpeg", "audio", "video"))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        low = artifact.data.lower()
        for marker in PROTECTED_MARKERS:
            if (at := low.find(marker.encode())) >= 0:
                yield Observation("c2pa_provenance", "provenance marker", {"marker": marker, "verification": "not_attempted", "authenticated": False}, {"byte_offset": at}, "medium", evidence_type="provenance", provenance="provenance_metadata", tags=("c2pa", "provenance", "preserve", "unverified-marker"))
                return


class CommentAttribution:
    id, experimental = "code.comment-attribution.v1", False
    types = frozenset(("source_code",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        from loupe.operators.structure import comment_places

        text = artifact.string
        for n, (start, end, verified) in enumerate(comment_places(text, artifact.path)):
            if n >= options.max_parser_events:
                raise Incomplete("too many comments")
            comment = text[start:end]
            for rule, provider, confidence, m in attributions(comment, COMMENT):
                safe = verified and standalone(comment, m.start(), m.end())
                evidence = {"rule_id": rule, "match": m[0], "comment": comment, "comment_start": start, "comment_end": end}
                yield Observation(
                    "generated_comment",
                    "attribution in a source comment",
                    evidence,
                    artifact.place(start + m.start(), start + m.end()),
                    confidence=confidence if verified else 0.65,
                    confidence_type="deterministic" if verified else "heuristic",
                    provider=provider,
                    remediation="text.remove-attribution-comment" if safe else None,
                    tags=("code", "comment", "literal", provider, "syntax-verified" if safe else "review-only"),
                    **_LITERAL,
                )


# -- style sheets

_TOKEN = re.compile(r"""\\.|/\*|"|'""", re.S)
_HIDES = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_DATA_URI = re.compile(r"url\(\s*['\"]?data:", re.I)
MAX_NESTING = 4096


def css_comments(text: str) -> Iterator[tuple[int, int]]:
    """Spans of block comments; what stands in quotes isn't one, and one that never closes runs to the end."""
    at = 0
    while m := _TOKEN.search(text, at):
        if m[0] == "/*":
            end = text.find("*/", m.end())
            end = len(text) if end < 0 else end + 2
            yield m.start(), end
            at = end
        elif m[0][0] == "\\":
            at = m.end()
        else:  # a string: to its quote, past what is escaped
            closing = re.compile(rf"(?:\\.|[^\\{m[0]}])*{m[0]}?", re.S).match(text, m.end())
            at = max(closing.end(), m.end())


def css_rules(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(begin of the selector, brace, end, innermost) of each block, as it closes; beyond 4,096 levels blocks aren't told apart."""
    stack: list[tuple[int, int, int]] = []
    begin = opened = 0
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            opened += 1
            if len(stack) < MAX_NESTING:
                stack.append((m.start(), begin, opened))
        elif stack:
            brace, head, before = stack.pop()
            yield head, brace, m.end(), opened == before
        begin = m.end()


# What counts toward a selector's specificity, and prefixes of vendors' own properties.
_ID_PART, _CLASS_PART, _TYPE_PART = re.compile(r"#[\w-]+"), re.compile(r"\.[\w-]+|\[[^\][\r\n]*\]|:[a-zA-Z-]+(?:\([^()\r\n]*\))?"), re.compile(r"(?:^|[\s>+~])([a-zA-Z][\w-]*)")
VENDORS = ("-webkit-", "-moz-", "-ms-", "-o-")


@lru_cache(maxsize=1 << 12)
def specificity(selector: str) -> tuple[int, int, int]:
    """Ids; classes, attributes and pseudo-classes; types. What one of them takes, the next doesn't see."""
    bare, ids = _ID_PART.subn(" ", selector)
    bare, classes = _CLASS_PART.subn(" ", bare)
    return ids, classes, len(_TYPE_PART.findall(bare))


def css_blocks(text: str) -> Iterator[tuple[str, str, bool]]:
    """(prelude, block, whether other blocks are in it) of rules at the top and inside at-rules, in order.

    A block at the top that never closes ends the sheet, and nothing in it counts.
    """
    blocks: list[list] = []  # prelude from, brace, end, parent, has children
    stack: list[int] = []
    begin, roots = 0, -1
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            if stack:
                blocks[stack[-1]][4] = True
            blocks.append([begin, m.start(), None, stack[-1] if stack else -1, False])
            stack.append(len(blocks) - 1)
            begin = m.end()
        elif stack:
            blocks[stack.pop()][2] = m.start()
            begin = m.end()
    entered = {roots}
    for i, (head, brace, end, parent, inner) in enumerate(blocks):
        if end is None and parent < 0:
            return
        if parent in entered and end is not None:
            prelude = text[head:brace].strip()
            if prelude.startswith("@") and inner:
                entered.add(i)
            yield prelude, text[brace + 1 : end], inner


def _uncommented(text: str) -> tuple[str, int]:
    """The sheet with a blank for each comment that closes, and their number; no later one closes if one doesn't."""
    pieces, at, n = [], 0, 0
    while (start := text.find("/*", at)) >= 0 and (end := text.find("*/", start + 2)) >= 0:
        pieces.append(text[at:start])
        at, n = end + 2, n + 1
    return " ".join([*pieces, text[at:]]), n


#: Characters of a sheet whose features are kept for its equals; a task keeps those of 1,024 sheets.
_SHORT = 4096


def sheet_features(text: str, most: int) -> dict:
    """Counts and distributions of a sheet; ``truncated_by`` says what stopped them, and they are lower bounds then.

    Don't change what this returns: short sheets that are equal share it.
    """
    return _shared_features(text, most) if len(text) <= _SHORT else _features(text, most)


@lru_cache(maxsize=1 << 10)
def _shared_features(text: str, most: int) -> dict:
    return _features(text, most)


def _features(text: str, most: int) -> dict:
    bare, comments = _uncommented(text)
    n: Counter[str] = Counter()
    at_rules, selectors, properties, shapes = Counter(re.findall(r"@([a-zA-Z-]+)", bare)), Counter(), Counter(), Counter()
    stopped = None
    for prelude, block, inner in css_blocks(bare):
        n["rules"] += 1
        if n["rules"] > most:
            stopped = "rules"
            break
        at = prelude.startswith("@")
        if at and inner:
            continue
        for one in filter(None, (" ".join(s.split()) for s in ("" if at else prelude).split(","))):
            n["selectors"] += 1
            selectors[one] += 1
            n["max_selector_parts"] = max(n["max_selector_parts"], one.count(" ") + 1)
            shapes["-".join(map(str, specificity(one)))] += 1
        for one in block.split(";"):
            name, colon, value = one.partition(":")
            name = name.strip().casefold()
            if colon and name and "{" not in one:
                n["declarations"] += 1
                properties[name] += 1
                low = value.casefold()
                n["important_declarations"] += "!important" in low
                n["vendor_prefixed_properties"] += name.startswith(VENDORS)
                n["custom_properties"] += name.startswith("--")
                n["embedded_data_uris"] += "url(data:" in low.replace(" ", "")
    return {
        **{k: n[k] for k in ("rules", "selectors", "declarations", "important_declarations", "vendor_prefixed_properties", "custom_properties", "max_selector_parts", "embedded_data_uris")},
        "at_rules": dict(at_rules.most_common()),
        "specificity_histogram": dict(shapes.most_common()),
        "duplicate_selectors": sum(c > 1 for c in selectors.values()),
        "distinct_properties": len(properties),
        "property_histogram": dict(properties.most_common(50)),
        "comments": comments,
        "complete": stopped is None,
        "truncated_by": stopped,
    }


class StyleSheet:
    id, experimental = "web.css-forensics.v1", False
    types = frozenset(("css",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        text = artifact.string
        features = sheet_features(text, options.max_parser_events)
        if features["rules"]:
            told = {k: v for k, v in features.items() if not isinstance(v, dict) and k != "truncated_by"}
            told |= {"at_rules": sum(features["at_rules"].values()), "distinct_at_rules": len(features["at_rules"])}
            yield Observation("structural_signal", "style sheet measurements", told, tags=("css", "features", "measurement"))
        for n, (start, end) in enumerate(css_comments(text)):
            if n >= options.max_parser_events:
                raise Incomplete("too many comments")
            comment = text[start:end]
            for rule, provider, confidence, m in attributions(comment, COMMENT):
                alone = standalone(comment, m.start(), m.end())
                evidence = {"rule_id": rule, "comment": comment, "comment_start": start, "comment_end": end}
                yield Observation("generated_comment", "attribution in a style sheet comment", evidence, artifact.place(start + m.start(), end), confidence=confidence, provider=provider, remediation="text.remove-attribution-comment" if alone else None, tags=("css", "comment", "literal", provider), **_LITERAL)
        for head, brace, end, inner in css_rules(text):
            if inner and (m := _HIDES.search(text, brace + 1, end - 1)):
                yield Observation("hidden_element", "rule that hides elements", {"selector": text[head:brace].strip(), "declaration": m[0]}, artifact.place(head, end), tags=("css", "hidden", "not-provenance"))
        for m in _DATA_URI.finditer(text):
            yield Observation("structural_signal", "embedded data URI", {"token": m[0]}, artifact.place(m.start(), m.end()), tags=("css", "data-uri"))
