"""Detectors of images, audio, video and repositories."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

from loupe.detection.markup import protected
from loupe.detection.model import Artifact, Incomplete, Observation, Options, attributions
from loupe.operators.detect_text import GIT_COMMIT, METADATA, TOOLING_NAMES, TOOLING_PREFIXES
from loupe.operators.structure import EXIF, RENDERING, metadata_of
from loupe.sources.files import COMMIT_LIMIT

# What fields tell of, and which containers' fields may be taken out.
IMAGE_GENERATOR, IMAGE_PERSONAL = frozenset(("software", "processingsoftware", "hostcomputer")), frozenset(("artist", "author", "copyright", "cameraownername", "xpauthor"))
MEDIA_GENERATOR = frozenset(("software", "encoder", "encoder software", "encoder settings", "encoded by", "encoding tool", "vendor", "writing application", "muxing application", "host computer"))
MEDIA_PERSONAL = frozenset(("artist", "album artist", "author", "composer", "copyright", "engineer", "originator", "owner"))
ID3_NAMES = {"TPE1": "artist", "TPE2": "album artist", "TCOM": "composer", "TCOP": "copyright", "TENC": "encoded by", "TSSE": "encoder settings", "TIT2": "title", "TALB": "album", "COMM": "comment", "TXXX": "user text", "©ART": "artist", "©too": "encoder software", "©nam": "title"}
CLEANABLE = frozenset(("wave", "mp3", "flac"))
MAX_FILES, MAX_PIXELS = 100_000, 100_000_000
_NUMBERS = {name: number for number, name in EXIF.items()}


def _entries(artifact: Artifact) -> list[tuple[str, str, str, int]]:
    try:
        return [e for e in metadata_of(artifact.data) if e[1] != "box"]
    except OverflowError as error:
        raise Incomplete(str(error)) from error
    except (ValueError, struct.error, IndexError) as error:
        raise Incomplete(str(error), "corrupt_artifact") from error


def shown(value: str, limit: int = 500) -> str:
    return value if len(value) <= limit else value[:limit] + "…"


def _severity(category: str) -> str:
    return "medium" if category in ("personal_metadata", "generator_metadata") else "low"


class Raster:
    id, experimental = "design.raster-metadata.v1", False
    types = frozenset(("png", "jpeg"))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        b = artifact.data
        if b.startswith(b"\x89PNG") and len(b) >= 24 and b[12:16] == b"IHDR":
            width, height = struct.unpack(">II", b[16:24])
            if width * height > MAX_PIXELS:
                raise Incomplete(f"the image has {width * height} pixels", "unsafe_artifact")
        for container, field, value, _ in sorted(_entries(artifact), key=lambda e: (e[0] == "exif", e[1].casefold() if e[0] != "exif" else "")):
            if not value:
                continue
            name = re.sub(r"[_ ]", "", field.casefold())
            category = "generator_metadata" if name in IMAGE_GENERATOR else "personal_metadata" if name in IMAGE_PERSONAL else "image_metadata"
            exif, safe = container == "exif", not protected(value)
            critical = exif and field in RENDERING
            evidence = {"container": "exif" if exif else artifact.kind, "field": field, "value": shown(value)}
            if exif:
                evidence |= {"tag_id": _NUMBERS.get(field, int(field) if field.isdigit() else None), "rendering_critical": critical}
            marks = (() if safe else ("preserve", "provenance-marker")) + (("preserve", "rendering-critical") if critical else ())
            yield Observation(category, f"image metadata: {field}", evidence, None, _severity(category), evidence_type="metadata", remediation="image.remove-metadata" if safe and not critical else None, provenance="metadata" if safe else "provenance_metadata", tags=("image", "exif" if exif else "metadata", field.casefold(), *marks))


class Media:
    id, experimental = "media.container-metadata.v1", False
    types = frozenset(("audio", "video"))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        for container, raw, value, at in _entries(artifact):
            field = ID3_NAMES.get(raw, raw)
            name = " ".join(re.sub(r"[_\-.]+", " ", re.sub(r"^com\.apple\.quicktime\.", "", field, flags=re.I)).casefold().split())
            category = "generator_metadata" if name in MEDIA_GENERATOR or any(x in name for x in ("encoder", "software", "muxing application")) else "personal_metadata" if name in MEDIA_PERSONAL else "media_metadata"
            safe = not protected(value)
            remediation = "media.remove-metadata-field" if safe and container in CLEANABLE else None
            evidence = {"container": container, "field": field, "raw_identifier": raw, "value": shown(value), "value_sha256": hashlib.sha256(value.encode()).hexdigest()}
            yield Observation(category, f"media metadata: {field}", evidence, {"byte_offset": at}, _severity(category), evidence_type="metadata", remediation=remediation, provenance="metadata" if safe else "provenance_metadata", tags=("media", "metadata", name, *(() if safe else ("preserve", "provenance-marker"))))
            for rule, provider, confidence, m in attributions(value, METADATA):
                yield Observation("explicit_ai_attribution", "attribution in media metadata", evidence | {"match": m[0], "rule_id": rule}, {"byte_offset": at}, "medium", confidence, evidence_type="metadata", provider=provider, remediation=remediation, provenance="attribution" if safe else "provenance_metadata", tags=("attribution", "literal", "media", provider))


def logged(log: str, limit: int) -> Iterator[tuple[str, str, str, str]]:
    """(hash, author, address, message) of a raw log's records, one more than the limit at most."""
    n = 0
    for record in log.split("\x1e"):
        parts = record.removesuffix("\0").strip("\r\n").split("\0", 3)
        if len(parts) == 4:
            yield tuple(parts)
            n += 1
            if n > limit:
                return


class GitCommits:
    """Commit messages of a repository, whose log is the artifact's text."""

    id, experimental = "git.commit-attribution.v1", False
    types = frozenset(("git_repository",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        commits = list(logged(artifact.text or "", COMMIT_LIMIT))
        for name, author, _, message in commits[:COMMIT_LIMIT]:
            for rule, provider, confidence, m in attributions(message, GIT_COMMIT):
                excerpt = message[max(0, m.start() - 80) : m.start() + 80].replace("\n", " ").strip()
                evidence = {"rule_id": rule, "commit": name, "commit_short": name[:12], "author_name": author, "match": m[0], "message_excerpt": excerpt}
                found = Observation("git_attribution", "attribution in the history", evidence, None, "medium", confidence, evidence_type="git", provider=provider, remediation="git.rewrite-history", provenance="attribution", tags=("git", "history", "destructive-remediation", provider))
                yield found
        if len(commits) > COMMIT_LIMIT:
            yield Observation("structural_signal", "the history is longer than the limit", {"commit_limit": COMMIT_LIMIT, "ref_scope": "all"}, None, "high", evidence_type="git", tags=("git", "coverage", "scan-incomplete"))


def tooling_provider(path: str) -> str | None:
    return TOOLING_NAMES.get(path) or next((p for prefix, p in TOOLING_PREFIXES.items() if path.startswith(prefix)), None)


class GitTooling:
    """Tracked paths of a repository, ended by U+0000 each, in the artifact's content."""

    id, experimental = "git.repository-context.v1", False
    types = frozenset(("git_repository",))

    def observe(self, artifact: Artifact, options: Options) -> Iterator[Observation]:
        paths = [p.decode("utf-8", "replace") for p in (artifact.content or b"").split(b"\0", MAX_FILES + 1)[: MAX_FILES + 1] if p]
        for path in paths[:MAX_FILES]:
            if provider := tooling_provider(path):
                yield Observation("tooling_residue", "tracked tool configuration", {"tracked_path": path}, None, evidence_type="git", provider=provider, provenance="metadata", tags=("git", "tooling-context", provider))
        if len(paths) > MAX_FILES:
            yield Observation("structural_signal", "more tracked files than the limit", {"file_limit": MAX_FILES}, None, "high", evidence_type="git", tags=("git", "coverage", "scan-incomplete"))
