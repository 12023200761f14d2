"""The scan over the tables: its findings, diagnostics, summary, budget and what a policy makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.detection.engine import detectors_run, diagnostics, findings, report_summary, scan_rows, within_budget
from loupe.detection.model import Options
from loupe.functions.staging import staged
from loupe.operators.apply import register
from loupe.operators.detect_text import TEXT_CONTEXT, attribution_sql, place_sql, unicode_sql
from loupe.operators.measure import SHEETS
from loupe.operators.policy import POLICIES, policy_decisions, remediation_plan
from loupe.operators.structure import planted_pages
from loupe.plans.fixtures import bound, dealt
from loupe.registry import query
from loupe.sources.artifacts import PLANTED, planted

#: Style sheets with an attribution, a rule that hides, and embedded data.
_SHEETS = f"""SELECT artifact_path, text, k FROM (SELECT concat('css/', p_partkey) AS artifact_path, p_partkey AS k, s.text AS text FROM part JOIN ({SHEETS}) AS s ON s.artifact_path = concat('css/', p_partkey))"""
_NOTE, _HIDES, _DATA = "/* generated by ChatGPT */", ".h { display: none }", ".d { background: url(data:x) }"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts, pages as HTML, parts as style sheets."""
    part = dealt(spark, sf_dir, "part", "p_partkey")
    part = part.select("p_partkey", "p_size").join(part.select("p_partkey"), "p_partkey")  # as the SQL joins the sheets to their parts, but without their texts
    sheets = bound(spark, sf_dir, SHEETS.replace("SELECT", "SELECT p_partkey AS k,", 1), part=part).select("artifact_path", F.concat("text", *(F.when(F.col("k") % m == 0, piece).otherwise("") for m, piece in ((5, _NOTE), (7, _HIDES), (11, _DATA)))).alias("text"))
    parts = (("text", planted(spark, sf_dir)), ("html", planted_pages(spark, sf_dir)), ("css", sheets))
    made = [df.select("artifact_path", F.lit(kind).alias("artifact_type"), "text") for kind, df in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


_META, _DIV, _IMG = '<meta name="generator" content="Maker 1">', '<div style="display: none">x</div>', '<img src="data:image/png;base64,AA">'
_PAGES = f"""SELECT *, b || CASE WHEN page_id % 7 = 0 THEN '<!-- generated by ChatGPT -->' ELSE '' END AS text FROM (SELECT *, i || CASE WHEN page_id % 6 = 0 THEN '{_IMG}' ELSE '' END AS b FROM (SELECT *, m || CASE WHEN page_id % 5 = 0 THEN '{_DIV}' ELSE '' END AS i
  FROM (SELECT *, h || CASE WHEN page_id % 4 = 0 THEN '{_META}' ELSE '' END AS m FROM (SELECT concat('page/', page_id, '.html') AS artifact_path, page_id, coalesce(html, '') AS h FROM pages))))"""
_CSS = f"SELECT *, c || CASE WHEN k % 11 = 0 THEN '{_DATA}' ELSE '' END AS text FROM (SELECT *, b || CASE WHEN k % 7 = 0 THEN '{_HIDES}' ELSE '' END AS c FROM (SELECT *, s || CASE WHEN k % 5 = 0 THEN '{_NOTE}' ELSE '' END AS b FROM (SELECT artifact_path, k, text AS s FROM ({_SHEETS}))))"
_COLUMNS = ("artifact_path", "detector_id", "category", "severity", "provider", "line", "col", "offset", "removable", "remediation_id", "provenance_class", "confidence")


def _seen(source: str, detector: str, category: str, severity: str, at: str | None, where: str, *, offset: bool = False, provider: str = "NULL", remediation: str = "NULL", provenance: str = "none", confidence: float = 1.0) -> str:
    line, col = place_sql("text", at) if at else ("CAST(NULL AS INT)", "CAST(NULL AS INT)")
    o = f"CAST({at} AS BIGINT)" if offset else "CAST(NULL AS BIGINT)"
    return f"""SELECT artifact_path, '{detector}' AS detector_id, '{category}' AS category, '{severity}' AS severity, CAST({provider} AS VARCHAR) AS provider, CAST({line} AS BIGINT) AS line, CAST({col} AS BIGINT) AS col, {o} AS "offset", {remediation} IS NOT NULL AS removable, CAST({remediation} AS VARCHAR) AS remediation_id, '{provenance}' AS provenance_class, CAST({confidence} AS DOUBLE) AS confidence FROM {source} WHERE {where}"""


def _unicode(source: str) -> str:
    return f"""SELECT artifact_path, 'text.unicode-forensics.v1', category, severity, CAST(NULL AS VARCHAR), CAST(line AS BIGINT), CAST(col AS BIGINT), CAST("offset" AS BIGINT), removable, CASE WHEN removable THEN 'text.remove-invisible' END, 'none', 1.0::DOUBLE FROM ({unicode_sql(source)})"""


_LONG, _BREAKS = "instr(text, 'left         right') + 3", "instr(text, 'above' || repeat(chr(10), 5)) + 4"
_HTML, _SHEET = "web.html-forensics.v1", "web.css-forensics.v1"
#: Every finding of the scan, computed from where the traces were put and from the texts.
SCANNED = " UNION ALL ".join(
    [
        _seen("p", _HTML, "structural_signal", "info", None, "regexp_matches(text, '<[a-zA-Z]')"),
        _seen("p", _HTML, "generator_metadata", "medium", "length(h)", "page_id % 4 = 0", remediation="'html.remove-generator-metadata'", provenance="metadata"),
        _seen("p", _HTML, "hidden_element", "low", "length(m)", "page_id % 5 = 0"),
        _seen("p", _HTML, "structural_signal", "info", "length(i)", "page_id % 6 = 0"),
        _seen("p", _HTML, "generated_comment", "medium", "length(b)", "page_id % 7 = 0", provider="'openai'", remediation="'html.remove-attribution-comment'", provenance="attribution", confidence=0.99),
        _seen("x", _HTML, "security_issue", "low", "o", "true"),
        _seen("c", _SHEET, "structural_signal", "info", None, "true"),
        _seen("c", _SHEET, "generated_comment", "medium", "(length(s) + 3)", "k % 5 = 0", offset=True, provider="'openai'", remediation="'text.remove-attribution-comment'", provenance="attribution", confidence=0.99),
        _seen("c", _SHEET, "structural_signal", "info", "(length(c) + 17)", "k % 11 = 0", offset=True),
        _seen("y", _SHEET, "hidden_element", "info", "o", "k % 7 = 0", offset=True),
        _unicode("SELECT artifact_path, text FROM d"),
        _unicode("SELECT artifact_path, text FROM p"),
        _unicode("SELECT artifact_path, text FROM c"),
        _seen("d", "text.unicode-forensics.v1", "suspicious_unicode", "info", f"({_LONG})", "contains(text, 'left         right')", offset=True, confidence=0.65),
        _seen("d", "text.unicode-forensics.v1", "suspicious_unicode", "info", f"({_BREAKS})", "contains(text, 'above' || repeat(chr(10), 5))", offset=True, confidence=0.65),
        f"""SELECT artifact_path, 'text.explicit-attribution.v1', 'explicit_ai_attribution', 'medium', provider, CAST(line AS BIGINT), CAST({place_sql("text", '"offset"')[1]} AS BIGINT), CAST("offset" AS BIGINT), standalone, CASE WHEN standalone THEN 'text.remove-attribution-line' END, 'attribution', confidence
        FROM ({attribution_sql("SELECT artifact_path, text FROM d", TEXT_CONTEXT).replace("standalone\n    FROM f", "standalone, text FROM f")})""",
    ]
)
_SCRIPTS = """SELECT artifact_path, text, CAST(list_sum(list_transform(b[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(h[1:i-1], lambda q: length(q))), 0) AS BIGINT) AS o FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT artifact_path, text, regexp_extract_all(text, '(?is)(.*?)(<script[ >])', 1) AS b, regexp_extract_all(text, '(?is)(.*?)(<script[ >])', 2) AS h FROM p) WHERE len(h) > 0)"""
#: Where the selector of the hiding rule begins: behind the last bracket before it.
_HIDING = "SELECT *, length(b) - CASE WHEN contains(b, '}') THEN instr(reverse(b), '}') - 1 ELSE length(b) END AS o FROM c"
_WITH = f"WITH d AS ({PLANTED}), p AS ({_PAGES}), c AS ({_CSS}), x AS ({_SCRIPTS}), y AS ({_HIDING}), f AS ({SCANNED})"


@query("scan_findings", f"{_WITH} SELECT * FROM f")
def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(scan_rows(artifacts(spark, sf_dir))).select(*_COLUMNS)


_TIGHT = Options(max_file_size=8000, max_findings=3)


@query(
    "scan_diagnostics",
    f"""{_WITH}, a AS (SELECT artifact_path, text FROM d UNION ALL SELECT artifact_path, text FROM p UNION ALL SELECT artifact_path, text FROM c)
    SELECT artifact_path, CAST(NULL AS VARCHAR) AS detector_id, 'artifact_too_large' AS code, 'high' AS severity FROM a WHERE strlen(text) > 8000
    UNION ALL SELECT artifact_path, detector_id, 'scan_limit_exceeded', 'high' FROM f JOIN a USING (artifact_path) WHERE strlen(text) <= 8000 GROUP BY 1, 2 HAVING count(*) > 3""",
)
def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(scan_rows(artifacts(spark, sf_dir), _TIGHT)).select("artifact_path", "detector_id", "code", "severity")


@query(
    "scan_detectors_run",
    """SELECT 'text.unicode-forensics.v1' AS detector_id, (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM part) AS artifacts UNION ALL SELECT 'text.explicit-attribution.v1', count(*) FROM documents
    UNION ALL SELECT 'web.html-forensics.v1', count(*) FROM pages UNION ALL SELECT 'web.css-forensics.v1', count(*) FROM part""",
)
def q_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors_run(scan_rows(artifacts(spark, sf_dir)))


@query("scan_summary", f"{_WITH} SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM part) AS artifacts, (SELECT count(*) FROM f) AS findings, CAST(0 AS BIGINT) AS diagnostics, CAST(0 AS BIGINT) AS grave, CAST(4 AS BIGINT) AS detectors, true AS complete")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_summary(scan_rows(artifacts(spark, sf_dir)))


@query(
    "scan_budget",
    f"""{_WITH}, n AS (SELECT artifact_path, count(*) AS n FROM f GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY lower(artifact_path), artifact_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
    SELECT artifact_path, CAST(least(n, 700 - before) AS BIGINT) AS kept, before + n > 700 AS truncated FROM r WHERE before < 700""",
)
def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = within_budget(scan_rows(artifacts(spark, sf_dir)), 700)
    counts = kept.groupBy("artifact_path").agg(F.count_if(F.col("kind") == "finding").alias("kept"), F.max(F.coalesce(F.col("code") == "finding_limit_exceeded", F.lit(False))).alias("truncated"))
    return counts.where("kept > 0 OR truncated")


_ACTION = "coalesce(CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POLICIES["client-delivery"][1].items()) + f" END, '{POLICIES['client-delivery'][0]}')"


@query(
    "scan_plan",
    f"""{_WITH}, q AS (SELECT *, CASE {_ACTION} WHEN 'preserve' THEN 'preserve' WHEN 'review' THEN 'review' WHEN 'error' THEN 'review' WHEN 'remove' THEN CASE WHEN remediation_id IS NOT NULL AND removable THEN 'planned' ELSE 'blocked' END END AS disposition FROM f)
    SELECT artifact_path, remediation_id, disposition, count(*) AS n FROM q WHERE disposition IS NOT NULL GROUP BY ALL""",
)
def q_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staged(findings(scan_rows(artifacts(spark, sf_dir))), "findings")  # a plan reads them twice
    return remediation_plan(policy_decisions(found, "client-delivery")).groupBy("artifact_path", "remediation_id", "disposition").agg(F.count(F.lit(1)).alias("n"))


def _made(suffix: str, detector: str, category: str, severity: str, remediation: str | None, title: str, value: str, where: str) -> str:
    gone = f"'{remediation}'" if remediation else "NULL"
    return f"SELECT concat('made/', c_custkey, '.{suffix}') AS artifact_path, '{detector}' AS detector_id, '{category}' AS category, '{severity}' AS severity, CAST({gone} AS VARCHAR) AS remediation_id, '{title}' AS title, CAST({value} AS VARCHAR) AS value FROM customer WHERE {where}"


_DOCX, _PPTX, _XLSX, _ODF, _PDF, _RASTER, _MEDIA, _SVG = "documents.docx-forensics.v1", "documents.pptx-forensics.v1", "documents.xlsx-forensics.v1", "documents.odf-forensics.v1", "documents.pdf-forensics.v1", "design.raster-metadata.v1", "media.container-metadata.v1", "design.svg-forensics.v1"
_AT = [f"c_custkey % 12 = {i}" for i in range(12)]
_FIFTH = "CASE WHEN c_custkey % 5 = 0 THEN 'generated by ChatGPT' ELSE '{}' END"
_FILES = " UNION ALL ".join(
    [
        *(
            part
            for i, suffix, d in ((0, "docx", _DOCX), (1, "pptx", _PPTX), (2, "xlsx", _XLSX))
            for part in (_made(suffix, d, "personal_metadata", "medium", f"{suffix}.remove-metadata-field", "property: creator", "c_name", _AT[i]), _made(suffix, d, "document_metadata", "low", f"{suffix}.remove-metadata-field", "property: title", "'T'", _AT[i]))
        ),
        _made("docx", _DOCX, "generator_metadata", "medium", "docx.remove-metadata-field", "property: Application", "'Maker'", _AT[0]),
        _made("docx", _DOCX, "document_metadata", "low", "docx.remove-custom-property", "property: Tool", _FIFTH.format("plain"), _AT[0]),
        _made("docx", _DOCX, "explicit_ai_attribution", "medium", "docx.remove-custom-property", "attribution in metadata", "'generated by ChatGPT'", f"{_AT[0]} AND c_custkey % 5 = 0"),
        _made("docx", _DOCX, "document_metadata", "low", None, "comment", "NULL", _AT[0]),
        _made("docx", _DOCX, "structural_signal", "medium", None, "tracked changes", "NULL", f"{_AT[0]} AND c_custkey % 2 = 1"),
        _made("docx", _DOCX, "security_issue", "medium", None, "external or active relationship", "NULL", _AT[0]),
        _made("pptx", _PPTX, "document_metadata", "low", None, "speaker notes", "NULL", _AT[1]),
        _made("pptx", _PPTX, "explicit_ai_attribution", "medium", None, "attribution in metadata", "'generated by ChatGPT'", f"{_AT[1]} AND c_custkey % 5 = 0"),
        _made("pptx", _PPTX, "personal_metadata", "medium", None, "comment author", "c_name", _AT[1]),
        _made("pptx", _PPTX, "structural_signal", "info", None, "slides", "NULL", _AT[1]),
        _made("xlsx", _XLSX, "hidden_element", "medium", None, "hidden worksheet", "NULL", _AT[2]),
        _made("xlsx", _XLSX, "tooling_residue", "low", None, "defined name", _FIFTH.format("A1"), _AT[2]),
        _made("xlsx", _XLSX, "explicit_ai_attribution", "medium", None, "attribution in metadata", "'generated by ChatGPT'", f"{_AT[2]} AND c_custkey % 5 = 0"),
        _made("xlsx", _XLSX, "personal_metadata", "medium", None, "comment author", "c_name", _AT[2]),
        _made("xlsx", _XLSX, "document_metadata", "low", None, "cell comment", "NULL", _AT[2]),
        _made("xlsx", _XLSX, "security_issue", "medium", None, "external workbook links", "NULL", _AT[2]),
        _made("odf", _ODF, "generator_metadata", "medium", "odf.remove-metadata-field", "property: generator", "'Maker'", _AT[3]),
        _made("odf", _ODF, "personal_metadata", "medium", "odf.remove-metadata-field", "property: initial-creator", "c_name", _AT[3]),
        _made("odf", _ODF, "document_metadata", "low", "odf.remove-metadata-field", "property: user-defined:Tool", _FIFTH.format("plain"), _AT[3]),
        _made("odf", _ODF, "structural_signal", "medium", None, "macro storage", "NULL", f"{_AT[3]} AND c_custkey % 2 = 1"),
        _made("pdf", _PDF, "personal_metadata", "medium", "pdf.remove-metadata-field", "Info: Author", "concat(c_name, ' (x)')", _AT[4]),
        _made("pdf", _PDF, "generator_metadata", "medium", "pdf.remove-metadata-field", "Info: Producer", "'Maker'", _AT[4]),
        _made("pdf", _PDF, "personal_metadata", "medium", "pdf.remove-metadata-field", "Info: Author", "c_name", _AT[5]),
        _made("pdf", _PDF, "generator_metadata", "medium", "pdf.remove-metadata-field", "Info: Creator", "'Maker'", _AT[5]),
        _made("png", _RASTER, "generator_metadata", "medium", "image.remove-metadata", "image metadata: Software", "'Maker'", _AT[6]),
        _made("png", _RASTER, "personal_metadata", "medium", "image.remove-metadata", "image metadata: Author", "c_name", _AT[6]),
        _made("jpeg", _RASTER, "image_metadata", "low", None, "image metadata: Orientation", "1 + c_custkey % 8", _AT[7]),
        _made("jpeg", _RASTER, "personal_metadata", "medium", "image.remove-metadata", "image metadata: Artist", "c_name", _AT[7]),
        _made("jpeg", _RASTER, "image_metadata", "low", "image.remove-metadata", "image metadata: comment", "'made by hand'", _AT[7]),
        _made("wav", _MEDIA, "generator_metadata", "medium", "media.remove-metadata-field", "media metadata: software", "'Maker'", _AT[8]),
        _made("wav", _MEDIA, "personal_metadata", "medium", "media.remove-metadata-field", "media metadata: artist", "c_name", _AT[8]),
        _made("mp3", _MEDIA, "personal_metadata", "medium", "media.remove-metadata-field", "media metadata: artist", "c_name", _AT[9]),
        _made("mp3", _MEDIA, "generator_metadata", "medium", "media.remove-metadata-field", "media metadata: encoder settings", _FIFTH.format("Maker"), _AT[9]),
        _made("mp3", _MEDIA, "explicit_ai_attribution", "medium", "media.remove-metadata-field", "attribution in media metadata", "'generated by ChatGPT'", f"{_AT[9]} AND c_custkey % 5 = 0"),
        _made("flac", _MEDIA, "generator_metadata", "medium", "media.remove-metadata-field", "media metadata: vendor", "'Maker'", _AT[10]),
        _made("flac", _MEDIA, "personal_metadata", "medium", "media.remove-metadata-field", "media metadata: artist", "c_name", _AT[10]),
        _made("svg", _SVG, "generator_metadata", "medium", "svg.remove-metadata-element", "metadata element", "NULL", _AT[11]),
        _made("svg", _SVG, "generator_metadata", "low", "svg.remove-editor-attributes", "editor attributes", "NULL", _AT[11]),
        _made("svg", _SVG, "generator_metadata", "low", "svg.remove-generator-comment", "generator comment", "NULL", f"{_AT[11]} AND c_custkey % 5 = 0"),
        _made("svg", _SVG, "explicit_ai_attribution", "medium", "svg.remove-attribution-comment", "attribution in an SVG comment", "NULL", f"{_AT[11]} AND c_custkey % 5 = 0"),
    ]
)


@query("scan_files", _FILES)
def q_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in office, PDF, image, audio and SVG files made of the customers."""
    from loupe.plans.made import made_files

    found = findings(scan_rows(made_files(spark, sf_dir)))
    return found.select("artifact_path", "detector_id", "category", "severity", "remediation_id", "title", F.get_json_object("evidence", "$.value").alias("value"))


register()
