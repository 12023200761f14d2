"""Detectors of office packages: Office Open XML and OpenDocument."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import xml.parsers.expat
import zipfile
from collections.abc import Iterable, Iterator

from loupe.detection.markup import protected
from loupe.detection.model import Artifact, Incomplete, Observation, Options, attributions, standalone
from loupe.operators.detect_text import METADATA
from loupe.operators.structure import MAX_INFLATED, MAX_PARTS, MAX_RATIO

# Parts and fields of the formats, and what each field is.
CORE, APP, CUSTOM, META = "docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "meta.xml"
CORE_FIELDS = frozenset(("creator", "lastModifiedBy", "title", "subject", "keywords", "description", "category", "contentStatus", "created", "modified", "revision"))
APP_FIELDS = frozenset(("Application", "AppVersion", "Company", "Manager", "Template"))
PERSONAL, GENERATOR = frozenset(("creator", "lastModifiedBy", "Company", "Manager")), frozenset(("Application", "AppVersion"))
ODF_FIELDS = {"generator": "generator_metadata", "initial-creator": "personal_metadata", "creator": "personal_metadata", "printed-by": "personal_metadata"} | dict.fromkeys(("title", "subject", "description", "keyword", "date", "creation-date", "print-date", "language", "editing-cycles", "editing-duration"), "document_metadata")
ODF_KINDS = {f"application/vnd.oasis.opendocument.{k}": k.replace("-", " ") for k in ("text", "spreadsheet", "presentation", "graphics", "formula", "text-template", "spreadsheet-template", "presentation-template")}
REVISIONS = frozenset(("ins", "del", "moveFrom", "moveTo"))
EXCERPT = 160


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


class Package:
    """A ZIP package whose directory was checked before anything is inflated."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise Incomplete(str(error), "corrupt_artifact") from error
        infos = self.zip.infolist()
        self.names = [i.filename for i in infos]
        unsafe = (
            "too many parts" if len(infos) > MAX_PARTS
            else "too large" if sum(i.file_size for i in infos) > MAX_INFLATED
            else "a part is compressed beyond the limit" if any(i.file_size > 1024 and i.file_size > MAX_RATIO * max(i.compress_size, 1) for i in infos)
            else "a part's name stands twice" if len(set(self.names)) < len(infos)
            else "a part's name leads outside" if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or ":" in n.split("/")[0] for n in self.names)
            else "a part is encrypted" if any(i.flag_bits & 1 for i in infos)
            else None
        )
        if unsafe:
            raise Incomplete(unsafe, "unsafe_artifact")

    def read(self, part: str) -> bytes:
        try:
            return self.zip.read(part)
        except (zipfile.BadZipFile, RuntimeError, EOFError, OSError) as error:
            raise Incomplete(f"{part}: {error}", "corrupt_artifact") from error

    def xml(self, part: str) -> ET.Element:
        return safe_xml(self.read(part), part)

    def under(self, prefix: str, suffix: str = ".xml") -> list[str]:
        return sorted(n for n in self.names if n.startswith(prefix) and n.endswith(suffix))


def safe_xml(data: bytes, part: str) -> ET.Element:
    """The tree of an XML part; document types and what they define are refused before they are read."""
    probe = xml.parsers.expat.ParserCreate()

    def refuse(*_):
        raise Incomplete(f"{part}: a document type is declared", "unsafe_artifact")

    probe.StartDoctypeDeclHandler = refuse
    try:
        probe.Parse(data, True)
        return ET.fromstring(data)
    except (xml.parsers.expat.ExpatError, ET.ParseError) as error:
        raise Incomplete(f"{part}: {error}", "corrupt_artifact") from error


def named(root: ET.Element, *tags: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if local(e.tag) in tags)


def whole(e: ET.Element) -> str:
    return "".join(e.itertext()).strip()


def attribute(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if local(k) == name), "")


class OfficeXml:
    """What the formats share: properties, custom parts, embedded objects, macros, relationships."""

    experimental = False
    id: str
    types: frozenset[str]
    tag: str
    prefix: str

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        p = Package(artifact.data)
        for part, fields in ((CORE, CORE_FIELDS), (APP, APP_FIELDS)):
            if part in p.names:
                yield from self._properties(p.xml(part), part, fields)
        if CUSTOM in p.names:
            for e in named(p.xml(CUSTOM), "property"):
                value = " ".join(t.strip() for child in e for t in child.itertext() if t.strip())
                yield from self._field(CUSTOM, e.attrib.get("name", "unnamed"), value, "document_metadata", "low", f"{self.tag}.remove-custom-property", ("metadata", "custom-property"))
        yield from self.content(p)
        yield from self._structure(p)
        for part in p.under("customXml/"):
            data = p.read(part)
            safe_xml(data, part)
            if protected(data.decode("utf-8", "replace")):
                yield Observation("c2pa_provenance", "provenance marker in custom XML", {"part": part, "authenticated": False}, {"package_part": part}, "medium", evidence_type="provenance", provenance="provenance_metadata", tags=(self.tag, "custom-xml", "c2pa", "unverified", "preserve"))
        for part in p.under("", ".rels"):
            yield from self._relationships(p.xml(part), part)

    def content(self, p: Package) -> Iterable[Observation]:
        return ()

    def _properties(self, root: ET.Element, part: str, fields: frozenset[str]) -> Iterator[Observation]:
        for e in root.iter():
            name, value = local(e.tag), (e.text or "").strip()
            if name in fields and value:
                category = "personal_metadata" if name in PERSONAL else "generator_metadata" if name in GENERATOR else "document_metadata"
                yield from self._field(part, name, value, category, "low" if category == "document_metadata" else "medium", f"{self.tag}.remove-metadata-field", ("metadata", name.casefold()))

    def _field(self, part: str, name: str, value: str, category: str, severity: str, remediation: str, tags: tuple[str, ...]) -> Iterator[Observation]:
        safe = not protected(value)
        marks = () if safe else ("preserve", "provenance-marker")
        yield Observation(category, f"property: {name}", {"part": part, "field": name, "value": value}, {"package_part": part}, severity, evidence_type="metadata", remediation=remediation if safe else None, provenance="metadata" if safe else "provenance_metadata", tags=(self.tag, *tags, *marks))
        yield from self.attributed(part, name, value, remediation)

    def attributed(self, part: str, name: str, value: str, remediation: str | None = None) -> Iterator[Observation]:
        for rule, provider, confidence, m in attributions(value, METADATA):
            safe = remediation is not None and not protected(value) and standalone(value, m.start(), m.end())
            evidence = {"part": part, "field": name, "rule_id": rule, "match": m[0], "value": value}
            yield Observation("explicit_ai_attribution", "attribution in metadata", evidence, {"package_part": part}, "medium", confidence, evidence_type="metadata", provider=provider, remediation=remediation if safe else None, provenance="attribution", tags=(self.tag, "metadata", "literal", provider))

    def _structure(self, p: Package) -> Iterator[Observation]:
        custom, embedded = p.under("customXml/"), p.under(f"{self.prefix}embeddings/", "")
        macros = sorted(n for n in p.names if "vbaproject" in n.casefold())
        if custom:
            yield Observation("document_metadata", "custom XML parts", {"parts": custom}, None, "low", provenance="metadata", tags=(self.tag, "custom-xml"))
        if embedded:
            yield Observation("security_issue", "embedded objects", {"parts": embedded}, None, "medium", evidence_type="security", tags=(self.tag, "embedded-object", "passive-scan"))
        if macros:
            yield Observation("security_issue", "macro project", {"parts": macros}, None, "high", evidence_type="security", tags=(self.tag, "macro", "passive-scan"))

    def _relationships(self, root: ET.Element, part: str) -> Iterator[Observation]:
        for e in named(root, "Relationship"):
            mode, kind = e.attrib.get("TargetMode", ""), e.attrib.get("Type", "")
            if mode.casefold() == "external" or any(x in kind.casefold() for x in ("oleobject", "attachedtemplate", "external")):
                evidence = {"part": part, "target": e.attrib.get("Target", ""), "target_mode": mode, "relationship_type": kind}
                yield Observation("security_issue", "external or active relationship", evidence, {"package_part": part}, "medium", evidence_type="security", tags=(self.tag, "relationship", "passive-scan"))

    def seen(self, category: str, title: str, part: str, evidence: dict, severity: str, *tags: str, provenance: str = "metadata", evidence_type: str = "metadata") -> Observation:
        return Observation(category, title, {"part": part, **evidence}, {"package_part": part}, severity, evidence_type=evidence_type, provenance=provenance, tags=(self.tag, *tags))


class Docx(OfficeXml):
    id, tag, prefix = "documents.docx-forensics.v1", "docx", "word/"
    types = frozenset(("docx",))

    def content(self, p: Package) -> Iterator[Observation]:
        part = "word/comments.xml"
        if part in p.names:
            for e in named(p.xml(part), "comment"):
                text = whole(e)
                yield self.seen("document_metadata", "comment", part, {"author": attribute(e, "author"), "text_excerpt": text[:EXCERPT]}, "low", "comment", "review")
                yield from self.attributed(part, "comment", text)
        part = "word/document.xml"
        if part in p.names and (kinds := sorted({local(e.tag) for e in named(p.xml(part), *REVISIONS)})):
            yield self.seen("structural_signal", "tracked changes", part, {"revision_types": kinds}, "medium", "tracked-changes", provenance="none", evidence_type="structural")


class Pptx(OfficeXml):
    id, tag, prefix = "documents.pptx-forensics.v1", "pptx", "ppt/"
    types = frozenset(("pptx",))

    def content(self, p: Package) -> Iterator[Observation]:
        for part in p.under("ppt/notesSlides/"):
            if text := " ".join(t for e in named(p.xml(part), "t") if (t := (e.text or "").strip())):
                yield self.seen("document_metadata", "speaker notes", part, {"text_excerpt": text[:EXCERPT]}, "low", "speaker-notes", "hidden-content")
                yield from self.attributed(part, "speaker-notes", text)
        for part in p.under("ppt/comments/"):
            for e in named(p.xml(part), "cm", "comment"):
                text = whole(e)
                yield self.seen("document_metadata", "comment", part, {"author_id": e.attrib.get("authorId", ""), "text_excerpt": text[:EXCERPT]}, "low", "comment", "review")
                yield from self.attributed(part, "comment", text)
        part = "ppt/commentAuthors.xml"
        if part in p.names:
            for e in named(p.xml(part), "cmAuthor"):
                if name := e.attrib.get("name", "").strip():
                    yield self.seen("personal_metadata", "comment author", part, {"field": "name", "value": name, "initials": e.attrib.get("initials", "")}, "medium", "comment", "author")
                    yield from self.attributed(part, "name", name)
        if slides := [n for n in p.under("ppt/slides/") if "/_rels/" not in n]:
            yield Observation("structural_signal", "slides", {"slide_count": len(slides), "parts": slides}, tags=("pptx", "structure"))


class Xlsx(OfficeXml):
    id, tag, prefix = "documents.xlsx-forensics.v1", "xlsx", "xl/"
    types = frozenset(("xlsx",))

    def content(self, p: Package) -> Iterator[Observation]:
        part = "xl/workbook.xml"
        if part in p.names:
            root = p.xml(part)
            for e in named(root, "sheet"):
                if (state := e.attrib.get("state", "visible")) in ("hidden", "veryHidden"):
                    yield self.seen("hidden_element", "hidden worksheet", part, {"sheet_name": e.attrib.get("name", ""), "state": state}, "medium", "hidden-sheet", "structure", provenance="none", evidence_type="structural")
            for e in named(root, "definedName"):
                if name := e.attrib.get("name", ""):
                    value = (e.text or "").strip()
                    yield self.seen("tooling_residue", "defined name", part, {"field": name, "value": value}, "low", "defined-name", "tooling", provenance="none", evidence_type="structural")
                    yield from self.attributed(part, name, value)
        for part in p.under("xl/comments"):
            root = p.xml(part)
            for e in named(root, "author"):
                if author := (e.text or "").strip():
                    yield self.seen("personal_metadata", "comment author", part, {"field": "author", "value": author}, "medium", "comment", "author")
                    yield from self.attributed(part, "author", author)
            for e in named(root, "comment"):
                text = whole(e)
                yield self.seen("document_metadata", "cell comment", part, {"cell": e.attrib.get("ref", ""), "text_excerpt": text[:EXCERPT]}, "low", "comment", "review")
                yield from self.attributed(part, "comment", text)
        for part in p.under("xl/threadedComments/"):
            for e in named(p.xml(part), "threadedComment"):
                text = whole(e)
                yield self.seen("document_metadata", "threaded comment", part, {"cell": e.attrib.get("ref", ""), "person_id": e.attrib.get("personId", ""), "text_excerpt": text[:EXCERPT]}, "low", "comment", "threaded")
                yield from self.attributed(part, "threadedComment", text)
        part = "xl/persons/person.xml"
        if part in p.names:
            for e in named(p.xml(part), "person"):
                if name := e.attrib.get("displayName", "").strip():
                    yield self.seen("personal_metadata", "comment participant", part, {"field": "displayName", "value": name, "user_id": e.attrib.get("userId", ""), "provider_id": e.attrib.get("providerId", "")}, "medium", "identity", "threaded")
                    yield from self.attributed(part, "displayName", name)
        if links := [n for n in p.under("xl/externalLinks/") if "/_rels/" not in n]:
            yield Observation("security_issue", "external workbook links", {"parts": links}, None, "medium", evidence_type="security", tags=("xlsx", "external-link", "passive-scan"))


class Odf:
    id, experimental = "documents.odf-forensics.v1", False
    types = frozenset(("odf",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        p = Package(artifact.data)
        mime = p.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in p.names else ""
        kind = ODF_KINDS.get(mime, mime or "unknown")
        if "content.xml" not in p.names:
            raise Incomplete("there is no content.xml", "corrupt_artifact")
        if META in p.names:
            for e in p.xml(META).iter():
                name, value = local(e.tag), (e.text or "").strip()
                category = "document_metadata" if name == "user-defined" else ODF_FIELDS.get(name)
                if value and category:
                    own = f"user-defined:{attribute(e, 'name') or 'user-defined'}" if name == "user-defined" else name
                    safe = not protected(value)
                    yield Observation(category, f"property: {own}", {"part": META, "field": own, "value": value, "document_kind": kind}, None, "low" if category == "document_metadata" else "medium", evidence_type="metadata", remediation="odf.remove-metadata-field" if safe else None, provenance="metadata" if safe else "provenance_metadata", tags=("odf", "metadata", own.casefold()))
        if macros := sorted(n for n in p.names if n.startswith(("Basic/", "Scripts/"))):
            yield Observation("structural_signal", "macro storage", {"entries": macros[:50], "entry_count": len(macros), "document_kind": kind}, None, "medium", tags=("odf", "macros", "structure"))
        if mime and mime not in ODF_KINDS:
            yield Observation("structural_signal", "unknown subtype", {"mimetype": mime}, tags=("odf", "structure"))
