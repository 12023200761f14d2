"""What detectors read and report, and the registry that says which detectors there are.

A detector is any object with ``id``, ``types`` and ``observe(artifact, options)``;
it yields observations and changes nothing. Whatever it raises becomes a
diagnostic, so one artifact can't stop a scan.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import Any, Protocol

import pyarrow as pa

from loupe.operators.detect_text import RULES


@dataclass(frozen=True)
class Options:
    """Budgets of a scan, and which detectors take part."""

    max_file_size: int = 25 << 20
    max_findings: int = 10_000
    max_parser_events: int = 50_000
    include_experimental: bool = False
    enabled: frozenset[str] | None = None
    disabled: frozenset[str] = frozenset()
    #: A scan of one artifact says so if nothing reads it.
    single_artifact: bool = False


class Incomplete(Exception):
    """Raised by a detector that can't read all of an artifact; ``code`` names the diagnostic."""

    def __init__(self, message: str, code: str = "scan_limit_exceeded") -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Artifact:
    """One artifact: its path, type and content, as text or bytes."""

    path: str
    kind: str
    text: str | None
    content: bytes | None

    @cached_property
    def data(self) -> bytes:
        return self.content if self.content is not None else (self.text or "").encode()

    @cached_property
    def string(self) -> str:
        if self.text is not None:
            return self.text
        data = self.content or b""
        codec = next((c for mark, c in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if data.startswith(mark)), "utf-8")
        try:
            return data.decode(codec)
        except UnicodeDecodeError as error:
            raise Incomplete(f"the content is no {codec} text", "corrupt_artifact") from error

    @property
    def size(self) -> int:
        return len(self.data)

    @cached_property
    def _starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.string))]

    def place(self, start: int, end: int | None = None) -> dict[str, int | None]:
        """Line, column and offsets of a span, by binary search over the lines."""
        line = bisect_right(self._starts, start)
        return {"line": line, "column": start - self._starts[line - 1] + 1, "offset": start, "end_offset": end}

    def line_start(self, line: int) -> int:
        return self._starts[line - 1]

    def line_span(self, offset: int) -> tuple[int, int]:
        """Where the line around an offset begins and ends, its line break included."""
        line = bisect_right(self._starts, offset)
        return self._starts[line - 1], self._starts[line] if line < len(self._starts) else len(self.string)


@dataclass
class Observation:
    """What one detector saw in one place."""

    category: str
    title: str
    evidence: dict[str, Any] = field(default_factory=dict)
    place: dict[str, Any] | None = None
    severity: str = "info"
    confidence: float = 1.0
    confidence_type: str = "deterministic"
    evidence_type: str = "structural"
    provider: str | None = None
    remediation: str | None = None
    provenance: str = "none"
    tags: tuple[str, ...] = ()


class Detector(Protocol):
    id: str
    types: frozenset[str]
    experimental: bool

    def observe(self, artifact: Artifact, options: Options) -> Iterable[Observation]: ...


#: The parts of a location, in the order in which an id covers them.
PLACE = ("byte_offset", "column", "end_offset", "json_pointer", "line", "offset", "package_part")


#: Evidence as text, its keys in order.
canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=True, default=str).encode


def _plain(v: int | str | None) -> str:
    return "null" if v is None else str(v) if type(v) is int else canonical(v)


def finding_id(path: str, detector: str, o: Observation, evidence: str | None = None) -> str:
    """A name that two scans of the same evidence give alike: a digest of all that tells it from others, as sorted JSON."""
    place = "null" if o.place is None else "{" + ", ".join([f'"{k}": {_plain(o.place.get(k))}' for k in PLACE]) + "}"
    covered = f'{{"artifact": {canonical(path)}, "category": "{o.category}", "detector": "{detector}", "evidence": {evidence or canonical(o.evidence)}, "location": {place}, "provider": {canonical(o.provider)}}}'
    return "fnd_" + hashlib.sha256(covered.encode()).hexdigest()[:20]


#: A row of a scan: a finding, a diagnostic, or a detector that ran.
FINDING, DIAGNOSTIC, RUN = "finding", "diagnostic", "run"
_COLUMNS = (
    "kind string, artifact_path string, detector_id string, position long, id string, category string, provider string, confidence double, confidence_type string, severity string, evidence_type string, title string, evidence string, "
    "line long, col long, offset long, end_offset long, byte_offset long, package_part string, removable boolean, remediation_id string, provenance_class string, tags array<string>, code string, message string"
)
ROWS = _COLUMNS
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split(" ") for c in _COLUMNS.split(", "))])


def finding_row(path: str, detector: str, position: int, o: Observation) -> dict[str, Any]:
    place = o.place or {}
    evidence = canonical(o.evidence)
    return {
        "kind": FINDING, "artifact_path": path, "detector_id": detector, "position": position, "id": finding_id(path, detector, o, evidence), "category": o.category, "provider": o.provider, "confidence": o.confidence, "confidence_type": o.confidence_type,
        "severity": o.severity, "evidence_type": o.evidence_type, "title": o.title, "evidence": evidence, "line": place.get("line"), "col": place.get("column"), "offset": place.get("offset"), "end_offset": place.get("end_offset"),
        "byte_offset": place.get("byte_offset"), "package_part": place.get("package_part"), "removable": o.remediation is not None, "remediation_id": o.remediation, "provenance_class": o.provenance, "tags": sorted(set(o.tags)),
    }


def diagnostic_row(path: str | None, code: str, message: str, severity: str = "high", detector: str | None = None, position: int = 0) -> dict[str, Any]:
    return {"kind": DIAGNOSTIC, "artifact_path": path, "detector_id": detector, "position": position, "severity": severity, "code": code, "message": message}


@dataclass(frozen=True)
class Registry:
    """Detectors in the order in which they run, and plugins that were refused."""

    detectors: tuple[Detector, ...]
    refused: tuple[tuple[str, str], ...] = ()

    def with_plugin(self, plugin: Any, allowed: frozenset[str]) -> Registry:
        """The registry with one more detector, if it is one, is allowed and has a name of its own."""
        name = getattr(plugin, "id", None)
        if not isinstance(name, str) or not re.match(r"[a-z][a-z0-9.-]{2,119}\Z", name):
            why = "it has no valid id"
        elif not isinstance(getattr(plugin, "types", None), frozenset) or not callable(getattr(plugin, "observe", None)):
            why = "it isn't a detector"
        elif name in {d.id for d in self.detectors}:
            why = "another detector has its id"
        elif name not in allowed:
            why = "it isn't on the list of allowed plugins"
        else:
            return Registry((*self.detectors, plugin), self.refused)
        return Registry(self.detectors, (*self.refused, (str(name), why)))

    def eligible(self, options: Options) -> list[Detector]:
        named = [d for d in self.detectors if options.enabled is None or d.id in options.enabled]
        return [d for d in named if d.id not in options.disabled and (options.include_experimental or not getattr(d, "experimental", False) or (options.enabled is not None and d.id in options.enabled))]


# -- attribution rules, as detectors apply them

COMPILED = tuple((rule, provider, confidence, contexts, re.compile(pattern, re.IGNORECASE)) for rule, provider, confidence, contexts, pattern in RULES)
#: A text that no rule can match holds none of these.
_HINTS = ("co-authored-by", "generated", "written", "created", "http://", "https://")
#: Letters beyond ASCII that a pattern takes for i, s or k where case doesn't count.
_ALIKE = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")


def hinted(text: str) -> bool:
    """Whether a text holds any of the hints, in whatever case."""
    low = text.lower() if text.isascii() else text.translate(_ALIKE).lower() if any(chr(c) in text for c in _ALIKE) else text.lower()
    return any(hint in low for hint in _HINTS)


def standalone(text: str, start: int, end: int) -> bool:
    """Whether nothing but signs and white space stands beside a match."""
    return re.search(r"[^\W_]", text[:start]) is None and re.search(r"[^\W_]", text[end:]) is None


def attributions(text: str, context: str) -> Iterator[tuple[str, str, float, re.Match[str]]]:
    """(rule, provider, confidence, match) of every rule of a context, rule by rule."""
    if hinted(text):
        for rule, provider, confidence, contexts, pattern in COMPILED:
            if context in contexts:
                yield from ((rule, provider, confidence, m) for m in pattern.finditer(text))


@lru_cache(maxsize=1 << 14)
def escaped(c: str) -> str:
    """A character as an excerpt shows it: what can't be seen is spelt out."""
    if c in "\n\r":
        return {"\n": "\\n", "\r": "\\r"}[c]
    return f"\\u{ord(c):04x}" if unicodedata.category(c) in ("Cf", "Cc") else c


def excerpt(text: str, offset: int, radius: int = 20) -> str:
    """The surroundings of one character, which is named by its code point."""
    before, after = text[max(0, offset - radius) : offset], text[offset + 1 : offset + radius + 1]
    return "".join(map(escaped, before)) + f"⟦U+{ord(text[offset]):04X}⟧" + "".join(map(escaped, after))
