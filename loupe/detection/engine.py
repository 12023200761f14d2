"""The scan as one Arrow pass: artifacts in, findings, diagnostics and runs out, as rows of one frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.detection import markup, media, packages, pdf, text
from loupe.detection.model import ARROW, DIAGNOSTIC, FINDING, ROWS, RUN, Artifact, Detector, Incomplete, Options, Registry, diagnostic_row, finding_row
from loupe.functions.staging import staged
from loupe.operators.scan import finding_budget

BUILTIN = Registry(
    tuple(
        sorted(
            (d() for d in (text.UnicodeForensics, text.ExplicitAttribution, text.ProtectedMarker, text.CommentAttribution, text.StyleSheet, markup.Html, markup.Svg, packages.Docx, packages.Pptx, packages.Xlsx, packages.Odf, pdf.PdfDetector, media.Raster, media.Media, media.GitCommits, media.GitTooling)),
            key=lambda d: d.id,
        )
    )
)
#: Findings that can't be cleaned, whatever their remediation is called.
_NEVER_REMOVED = "git.rewrite-history"
_ROWS_AT_ONCE = 4096


def inspected(artifact: Artifact, detectors: Iterable[Detector], options: Options) -> Iterator[dict]:
    """The rows of one artifact. A detector that fails, or finds more than it may, loses its findings there and says so."""
    if artifact.size > options.max_file_size:
        yield diagnostic_row(artifact.path, "artifact_too_large", f"{artifact.size} bytes; the limit is {options.max_file_size}")
        return
    supported = False
    for detector in detectors:
        if artifact.kind not in detector.types:
            continue
        supported = True
        yield {"kind": RUN, "artifact_path": artifact.path, "detector_id": detector.id, "position": 0}
        rows: list[dict] = []
        try:
            for n, o in enumerate(detector.observe(artifact, options), 1):
                if n > options.max_findings:
                    raise Incomplete(f"more than {options.max_findings} findings")
                row = finding_row(artifact.path, detector.id, n, o)
                row["removable"] = row["removable"] and o.remediation != _NEVER_REMOVED
                rows.append(row)
        except Incomplete as error:
            yield diagnostic_row(artifact.path, error.code, str(error), detector=detector.id)
            continue
        except Exception as error:  # the boundary between a detector and the scan
            yield diagnostic_row(artifact.path, "detector_failure", f"{type(error).__name__}: {error}", detector=detector.id)
            continue
        yield from rows
        if any("scan-incomplete" in row["tags"] for row in rows):
            yield diagnostic_row(artifact.path, "detector_scan_truncated", "the detector didn't see everything", detector=detector.id)
    if not supported and options.single_artifact:
        yield diagnostic_row(artifact.path, "unsupported_artifact", f"no enabled detector reads {artifact.kind}")


def scan_rows(artifacts: DataFrame, options: Options = Options(), registry: Registry = BUILTIN) -> DataFrame:
    """Every finding, diagnostic and run of a scan of (artifact_path, artifact_type, text or content).

    A column that isn't there is null. An artifact without a type is unknown, and nothing reads it. Plugins that were
    refused are diagnostics without an artifact.
    """
    detectors = tuple(sorted(registry.eligible(options), key=lambda d: d.id))

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in source:
            columns = [batch.column(c) for c in ("artifact_path", "artifact_type", "text", "content")]
            for i in range(batch.num_rows):
                path, kind, string, content = (c[i].as_py() for c in columns)
                rows += inspected(Artifact(path, kind or "unknown", string, content), detectors, options)
                if len(rows) >= _ROWS_AT_ONCE:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    have = set(artifacts.columns)
    found = artifacts.select(*(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("artifact_path", "string"), ("artifact_type", "string"), ("text", "string"), ("content", "binary")))).mapInArrow(made, ROWS)
    if not registry.refused:
        return found
    refused = artifacts.sparkSession.createDataFrame([diagnostic_row(None, "plugin_rejected", f"{name}: {why}", "medium") for name, why in registry.refused], found.schema)
    return found.unionByName(refused)


_FINDING = ("artifact_path", "id", "detector_id", "category", "provider", "confidence", "confidence_type", "severity", "evidence_type", "title", "evidence", "line", "col", "offset", "end_offset", "byte_offset", "package_part", "removable", "remediation_id", "provenance_class", "tags", "position")


def findings(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == FINDING).select(*_FINDING)


def diagnostics(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == DIAGNOSTIC).select("artifact_path", "detector_id", "code", "message", "severity")


def detectors_run(rows: DataFrame) -> DataFrame:
    """Each detector that ran, and on how many artifacts."""
    return rows.where(F.col("kind") == RUN).groupBy("detector_id").agg(F.count(F.lit(1)).alias("artifacts"))


def within_budget(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of a report of ``limit`` findings.

    Artifacts are charged in order of their paths. The one that holds the next finding keeps the first of its findings
    and gets a diagnostic; those behind it contribute nothing, neither findings nor diagnostics nor runs.

    The rows are counted, charged and cut in turn, so they are written once and not scanned for each of these.
    """
    rows = staged(rows, "scan")
    found = findings(rows).withColumn("emit_ord", F.struct("detector_id", "position"))
    charged = finding_budget(found, limit)
    cut = charged.where("artifact_truncated").select("artifact_path").distinct()  # one at most
    last = cut.select(F.struct(F.lower("artifact_path").alias("low"), F.col("artifact_path").alias("path")).alias("last"))
    seen = rows.join(F.broadcast(last), how="left").where(F.col("last").isNull() | F.col("artifact_path").isNull() | (F.struct(F.lower("artifact_path").alias("low"), F.col("artifact_path").alias("path")) <= F.col("last"))).drop("last")
    kept = seen.where(F.col("kind") == FINDING).join(charged.select("artifact_path", "id").distinct(), ["artifact_path", "id"], "left_semi")
    told = cut.select(F.lit(DIAGNOSTIC).alias("kind"), "artifact_path", F.lit("finding_limit_exceeded").alias("code"), F.lit(f"the budget of {limit} findings is used up").alias("message"), F.lit("high").alias("severity"))
    return seen.where(F.col("kind") != FINDING).unionByName(kept).unionByName(told, allowMissingColumns=True)


def report_summary(rows: DataFrame) -> DataFrame:
    """One row: artifacts seen, findings, diagnostics by gravity, detectors, and whether the scan is complete."""
    return rows.agg(
        F.count_distinct("artifact_path").alias("artifacts"),
        F.count_if(F.col("kind") == FINDING).alias("findings"),
        F.count_if(F.col("kind") == DIAGNOSTIC).alias("diagnostics"),
        F.count_if((F.col("kind") == DIAGNOSTIC) & F.col("severity").isin("high", "critical")).alias("grave"),
        F.count_distinct(F.when(F.col("kind") == RUN, F.col("detector_id"))).alias("detectors"),
    ).withColumn("complete", F.col("grave") == 0)
