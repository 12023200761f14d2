"""Collects the queries that the operator modules register."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe import registry

MODULES = ("operators.detect_text", "detection.queries", "operators.scan", "operators.policy", "operators.stats", "operators.corpus", "operators.style", "operators.trust", "operators.cache", "operators.measure", "operators.structure", "operators.vector", "operators.clean", "operators.gates", "operators.reports", "operators.media_clean", "operators.attest", "operators.contracts", "sources.files", "sources.discovery", "sources.loaders", "streaming.scan")

for _name in MODULES:
    import_module(f"loupe.{_name}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the documents: findings of two detectors, decided by a policy and counted."""
    from loupe.operators.detect_text import attribution_findings, unicode_findings
    from loupe.operators.policy import policy_decisions
    from loupe.sources.artifacts import planted

    docs = planted(spark, sf_dir)
    chars = unicode_findings(docs).select("artifact_path", "category", "severity")
    notes = attribution_findings(docs).select("artifact_path", F.lit("explicit_ai_attribution").alias("category"), F.lit("medium").alias("severity"))
    decided = policy_decisions(chars.unionByName(notes), "client-delivery")
    return decided.groupBy("category", "severity", "action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("artifact_path").alias("artifacts"))
