"""Inputs for the operators, cut from the tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loupe.functions.spreading import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def bound(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """Run SQL over the tables of a folder, or over those that are given in their place."""
    used = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", plain), **used)


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A narrow table of which long texts or files are made, its rows dealt over many tasks."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


#: Findings of a scan: one for each line item.
FINDINGS = """
SELECT concat('fnd_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS id,
  concat('src/F', l_orderkey % 3000, '.txt') AS artifact_path,
  concat('detector.', l_suppkey % 5) AS detector_id,
  l_orderkey * 10 + l_linenumber AS emit_ord,
  CASE l_partkey % 9 WHEN 0 THEN 'invisible_unicode' WHEN 1 THEN 'suspicious_unicode' WHEN 2 THEN 'explicit_ai_attribution' WHEN 3 THEN 'generator_metadata'
    WHEN 4 THEN 'personal_metadata' WHEN 5 THEN 'c2pa_provenance' WHEN 6 THEN 'security_issue' WHEN 7 THEN 'stylistic_signal' ELSE 'document_metadata' END AS category,
  CASE l_partkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity,
  CASE l_suppkey % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'verified' WHEN 2 THEN 'probabilistic' ELSE 'heuristic' END AS confidence_type,
  CASE l_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'attribution' ELSE 'metadata' END AS provenance_class,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_partkey END AS "offset",
  l_linenumber % 2 = 1 AS removable,
  CASE l_partkey % 3 WHEN 0 THEN 'text.remove-invisible' WHEN 1 THEN 'pdf.remove-xmp' ELSE NULL END AS remediation_id,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 7 < 4 THEN 'suspicious' ELSE 'typographic' END AS safety_class
FROM lineitem
"""
FINDINGS_SPARK = FINDINGS.replace('"offset"', "`offset`")

#: Artifacts before and after a scan.
BEFORE = "SELECT concat('src/F', o_orderkey % 3000, '.txt') AS artifact_path, max(o_custkey) AS content FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1"
AFTER = "SELECT concat('src/F', o_orderkey % 3000, '.txt') AS artifact_path, max(o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS content FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1"

#: Scored predictions: documents with a label; one in twenty abstains.
PREDICTIONS = """
SELECT concat('doc-', l.doc_id) AS sample_id, max(l.quality) = 0 AS is_positive,
  CASE WHEN l.doc_id % 20 = 0 THEN NULL ELSE CASE WHEN max(l.quality) = 0 THEN 0.55 + (l.doc_id % 40) / 100.0 ELSE (l.doc_id % 61) / 100.0 END END AS score,
  max(d.lang) AS domain, max(d.source) AS subgroup
FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.doc_id
"""

#: A governed corpus: samples, consents and their policy.
SAMPLES = """
SELECT concat('s', o_orderkey) AS sample_id, concat('sha', o_orderkey % 997) AS content_sha256,
  CASE WHEN o_custkey % 23 = 5 THEN NULL ELSE CASE o_custkey % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'software' WHEN 2 THEN 'medical' ELSE 'news' END END AS domain,
  CASE o_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
  concat('source', o_custkey % 12) AS source, o_orderdate AS collected_at, concat('c', o_custkey) AS consent_id,
  CASE WHEN o_orderkey % 17 = 4 THEN NULL ELSE o_orderkey % 3 <> 0 END AS permits_training, CASE WHEN o_orderkey % 17 = 4 THEN NULL ELSE split(CASE o_orderkey % 3 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'training,evaluation' ELSE 'training' END, ',') END AS permits, o_orderkey AS ord
FROM orders
"""
CONSENTS = """
SELECT concat('c', c_custkey) AS consent_id, TIMESTAMP '1993-01-01 00:00:00' AS granted_at,
  CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1997-01-01 00:00:00' ELSE TIMESTAMP '2003-01-01 00:00:00' END ELSE NULL END AS expires_at,
  CASE WHEN c_custkey % 7 = 0 THEN 'withdrawn' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 13 = 6 THEN NULL WHEN c_custkey % 6 = 0 THEN 'research' ELSE 'training' END AS purpose
FROM customer WHERE c_custkey % 9 <> 0
"""

#: Writers and their documents: labelled embeddings, the first three dimensions and a constant.
STYLES = """
SELECT label AS writer, vec_id AS doc_id, vec_id % 400 AS day, round(CAST(embedding[{a}] AS DOUBLE), 6) AS f1, round(CAST(embedding[{b}] AS DOUBLE), 6) AS f2, round(CAST(embedding[{c}] AS DOUBLE), 6) AS f3, CAST(0.3 AS DOUBLE) AS f4, vec_id % 10 = 7 AS candidate
FROM embeddings
"""
#: Spark counts the elements of an array from 0 in brackets, DuckDB from 1.
STYLES_SPARK, STYLES_DUCK = STYLES.format(a=0, b=1, c=2), STYLES.format(a=1, b=2, c=3)

#: The same with every dimension.
VECTORS = "SELECT label AS writer, vec_id AS doc_id, vec_id % 400 AS day, CAST(embedding AS {doubles}) AS features, vec_id % 10 = 7 AS candidate FROM embeddings"
VECTORS_SPARK, VECTORS_DUCK = VECTORS.format(doubles="ARRAY<DOUBLE>"), VECTORS.format(doubles="DOUBLE[]")

#: A hash-chained ledger for each user; some entries are broken.
LEDGER = """
SELECT user_id AS log_id, event_id, ts AS recorded_at, event_type AS kind, concat('s', event_id) AS subject_id, concat(event_id, ':', event_type) AS payload, event_id % 97 = 0 AS tampered
FROM events
"""

#: Trust anchors with validity and succession.
ANCHORS = """
SELECT concat('a', s_suppkey) AS anchor_id, CAST(s_suppkey * 10 AS BIGINT) AS not_before, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey * 10 + 8 + s_suppkey % 5 AS BIGINT) END AS not_after,
  CASE WHEN s_suppkey % 6 = 1 THEN NULL ELSE concat('a', s_suppkey - 1) END AS replaces
FROM supplier
"""
REVOCATIONS = "SELECT concat('a', n_nationkey) AS anchor_id, CAST(n_nationkey * 12 AS BIGINT) AS revoked_at FROM nation WHERE n_nationkey % 2 = 0"
