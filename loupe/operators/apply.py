"""Plans applied: the spans that findings name are verified and cut, and the output is proved before it is published."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.registry import query
from loupe.sources.artifacts import PLANTED

_SCHEMA = pa.schema([("artifact_path", pa.string()), ("status", pa.string()), ("clean", pa.string()), ("before", pa.string()), ("after", pa.string()), ("removed", pa.int64()), ("labels", pa.list_(pa.string()))])


def _evidence(key: str) -> Column:
    return F.get_json_object("evidence", f"$.{key}")


def _span(start: Column, end: Column, expected: Column, label: str) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), expected.alias("expected"), F.lit(label).alias("label"))


#: The span that each remediation of a text cuts, from what the finding saw.
SPANS = {
    "text.remove-invisible": lambda: _span(F.col("offset"), F.col("offset") + F.length(_evidence("character")), _evidence("character"), "character"),
    "text.remove-attribution-line": lambda: _span(_evidence("line_start"), _evidence("line_end"), _evidence("line_raw"), "attribution line"),
    "text.remove-attribution-comment": lambda: _span(_evidence("comment_start"), _evidence("comment_end"), _evidence("comment"), "attribution comment"),
    "html.remove-attribution-comment": lambda: _span(_evidence("comment_start"), _evidence("comment_end"), _evidence("comment_raw"), "HTML attribution comment"),
    "html.remove-generator-metadata": lambda: _span(_evidence("tag_start"), _evidence("tag_end"), _evidence("tag_raw"), "HTML generator metadata"),
}


def cut(text: str, spans: list[tuple[int, int, str, str]]) -> tuple[str, str | None, list[str]]:
    """(status, text, labels): the widest span first, nested ones absorbed; anything that isn't as it was cuts nothing."""
    kept: list[tuple[int, int]] = []
    labels = []
    for start, end, expected, label in sorted(set(spans), key=lambda s: (s[0], -s[1], s[3])):
        if not 0 <= start < end <= len(text):
            return "invalid_span", None, []
        if text[start:end] != expected:
            return "changed", None, []
        labels.append(label)
        if kept and start < kept[-1][1]:
            if end <= kept[-1][1]:
                continue
            return "overlap", None, []
        kept.append((start, end))
    pieces, at = [], 0
    for start, end in kept:
        pieces.append(text[at:start])
        at = end
    return "applied", "".join([*pieces, text[at:]]), labels


def applied(artifacts: DataFrame, findings: DataFrame, plan: DataFrame, dry_run: bool = False) -> DataFrame:
    """Each artifact that a plan touches, cleaned and proved, or the reason why nothing of it was cut.

    ``findings`` are a scan's, ``plan`` has the ids and dispositions. An artifact with a planned remediation that isn't
    one of a text's is left to the cleaners of files. The spans of an artifact are no more than a scan may find in it.
    """
    planned = findings.join(plan.where("disposition = 'planned'").select("id"), "id", "left_semi")
    span = reduce(lambda out, kv: F.when(F.col("remediation_id") == kv[0], kv[1]()).otherwise(out), SPANS.items(), F.lit(None).cast("struct<start:bigint,end:bigint,expected:string,label:string>"))
    told = planned.select("artifact_path", span.alias("span")).groupBy("artifact_path").agg(F.collect_list("span").alias("spans"), F.bool_or(F.col("span").isNull()).alias("other"))
    joined = artifacts.select("artifact_path", "text").join(told, "artifact_path")

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for path, text, spans, other in zip(*(batch.column(c).to_pylist() for c in ("artifact_path", "text", "spans", "other")), strict=True):
                text = text or ""
                status, clean, labels = ("unsupported", None, []) if other else cut(text, [(s["start"], s["end"], s["expected"], s["label"]) for s in spans])
                before = hashlib.sha256(text.encode()).hexdigest()
                after = hashlib.sha256(clean.encode()).hexdigest() if clean is not None else None
                rows.append((path, status, None if dry_run else clean, before, after, len(text) - len(clean) if clean is not None else 0, sorted(labels)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return joined.mapInArrow(made, "artifact_path string, status string, clean string, before string, after string, removed long, labels array<string>")


def published(applied_rows: DataFrame, path: str) -> None:
    """Write what was applied and proved, with its integrity, to a new place."""
    applied_rows.where("status = 'applied' AND clean IS NOT NULL AND sha2(clean, 256) = after").write.mode("errorifexists").parquet(path)


def exact_transform(rows: DataFrame) -> DataFrame:
    """Whether each output is, byte for byte, the one that was planned: (artifact_path, after, output)."""
    return rows.select("artifact_path", F.when(F.sha2("output", 256) == F.col("after"), "pass").otherwise("fail").alias("integrity"))


_CLEAN_DOCS = """SELECT artifact_path, text, regexp_replace(replace(replace(text, chr(8203), ''), chr(8288), ''), '(?im)^(?:Generated with ChatGPT|https://chatgpt\\.com/share/abc-123|Co-Authored-By: Claude <noreply@example\\.org>)\\n', '', 'g') AS clean FROM d"""


def _applied_sql() -> str:
    from loupe.detection.queries import _CSS, _PAGES

    return f"""WITH d AS ({PLANTED}), p AS ({_PAGES}), c AS ({_CSS}), r AS ({_CLEAN_DOCS}
      UNION ALL SELECT artifact_path, text, h || substr(i, length(m) + 1) || substr(b, length(i) + 1) FROM p UNION ALL SELECT artifact_path, text, s || substr(c, length(b) + 1) || substr(text, length(c) + 1) FROM c)
    SELECT artifact_path, 'applied' AS status, sha256(text) AS before, sha256(clean) AS after, CAST(length(text) - length(clean) AS BIGINT) AS removed FROM r WHERE text <> clean"""


def register() -> None:
    """Called by the scan's queries, whose artifacts these are."""

    @query("applied_plan", _applied_sql())
    def q_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
        from loupe.detection.engine import findings, scan_rows
        from loupe.detection.queries import artifacts
        from loupe.functions.staging import staged
        from loupe.operators.policy import policy_decisions, remediation_plan

        found = staged(findings(scan_rows(artifacts(spark, sf_dir))), "findings")
        plan = remediation_plan(policy_decisions(found, "client-delivery").withColumn("action", F.when(F.col("category") == "invisible_unicode", "remove").otherwise(F.col("action"))))
        return applied(artifacts(spark, sf_dir), found, plan).select("artifact_path", "status", "before", "after", "removed")

    @query("applied_integrity", "SELECT artifact_path, CASE WHEN doc_id % 5 = 0 THEN 'fail' ELSE 'pass' END AS integrity FROM (SELECT concat('doc/', doc_id, '.txt') AS artifact_path, doc_id FROM documents WHERE doc_id % 7 = 0)")
    def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
        from loupe.detection.engine import findings, scan_rows
        from loupe.operators.policy import policy_decisions, remediation_plan
        from loupe.sources.artifacts import planted

        texts = planted(spark, sf_dir).where("doc_id % 7 = 0").select("doc_id", "artifact_path", F.lit("text").alias("artifact_type"), "text")
        found = findings(scan_rows(texts))
        rows = applied(texts, found, remediation_plan(policy_decisions(found, "client-delivery")))
        output = rows.join(texts.select("artifact_path", "doc_id"), "artifact_path").withColumn("output", F.when(F.col("doc_id") % 5 == 0, F.concat("clean", F.lit("!"))).otherwise(F.col("clean")))
        return exact_transform(output)
