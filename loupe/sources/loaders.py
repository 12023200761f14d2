"""Loaders of what a scan or a signer wrote: findings, bundles, certificates, revocations, trust stores and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.staging import shared_dir
from loupe.operators.policy import MAX_CONTROLS, POLICIES, PROTECTED
from loupe.plans.fixtures import FINDINGS
from loupe.registry import query

#: What each kind of file holds; anything else in a line is an error, and so is a line that can't be read.
SCHEMAS = {
    "findings": "id string, artifact_path string, detector_id string, category string, severity string, confidence_type string, provenance_class string, offset long, removable boolean, remediation_id string",
    "controls": "selector_id string, kind string, category string, detector_id string, severity string, path_glob string, provider string, tags_all array<string>, action string, approved_by string, expires_at long",
    "certificates": "certificate_id string, not_before long, not_after long, signature string, subject_sha256 string",
    "revocations": "certificate_id string, revoked_at long, reason string",
    "anchors": "anchor_id string, kind string, material string, not_before long, not_after long, replaces string",
}
ACTIONS = ("ignore", "report", "review", "remove", "preserve", "error")
#: Lines of a compressed file, which is read by one task.
LINES_OF_A_FILE = 1_000_000
#: Bytes of a policy that is read.
MAX_POLICY = 1 << 20


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The rows of JSON lines of a kind; a line that isn't one fails the load instead of becoming nulls."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def load_controls(spark: SparkSession, path: str) -> DataFrame:
    """Controls of a bundle: no more than it may hold, each with an id, a constraint and an end."""
    found = load(spark, "controls", path)
    if found.limit(MAX_CONTROLS + 1).count() > MAX_CONTROLS:
        raise ValueError(f"a bundle holds at most {MAX_CONTROLS} controls")
    asks = F.coalesce("category", "detector_id", "severity", "path_glob", "provider", F.array_join("tags_all", ",")).isNotNull()
    fine = F.col("selector_id").rlike(r"^[a-z0-9][a-z0-9._-]{2,119}$") & F.col("expires_at").isNotNull() & F.col("approved_by").isNotNull() & asks
    return found.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("a control isn't one: "), F.coalesce("selector_id", F.lit("?"))))))


def policy_from_yaml(text: str) -> tuple[str, str, dict[str, str]]:
    """(name, default action, rules) of a policy's YAML; a policy that would remove protected provenance is refused."""
    import yaml

    if len(text.encode()) > MAX_POLICY:
        raise ValueError(f"a policy has at most {MAX_POLICY} bytes")
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("policy"), str) or not isinstance(raw.get("rules") or {}, dict):
        raise ValueError("a policy has a name and rules")
    default, rules = raw.get("default_action", "report"), {str(k): str(v) for k, v in (raw.get("rules") or {}).items()}
    if unknown := sorted({default, *rules.values()} - set(ACTIONS)):
        raise ValueError(f"unknown actions: {unknown}")
    for category in PROTECTED:
        if rules.get(category) == "remove" or default == "remove" and rules.get(category) != "preserve":
            raise ValueError(f"{category} may not be removed")
    return raw["policy"], default, rules


def policy_yaml(name: str) -> str:
    """A built-in policy as YAML."""
    default, rules = POLICIES[name]
    return f"policy: {name}\ndefault_action: {default}\nrules:\n" + "".join(f"  {k}: {v}\n" for k, v in rules.items())


def policy_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(policy, category, action) of some policies' YAML; the default stands under an empty category."""
    rows = [(name, category, action) for name, default, rules in map(policy_from_yaml, texts) for category, action in {"": default, **rules}.items()]
    return spark.createDataFrame(rows, "policy string, category string, action string")


@query("loaded_findings", f'WITH f AS ({FINDINGS}) SELECT id, artifact_path, category, "offset" FROM f')
def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from loupe.operators.reports import json_lines
    from loupe.operators.scan import findings_of

    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    json_lines(findings_of(spark, sf_dir)).select("json").write.option("compression", "gzip").option("maxRecordsPerFile", LINES_OF_A_FILE).text(path)
    return load(spark, "findings", path).select("id", "artifact_path", "category", "offset")


_RULES = " UNION ALL ".join(f"SELECT '{p}' AS policy, '{c}' AS category, '{a}' AS action" for p, (default, rules) in POLICIES.items() for c, a in {"": default, **rules}.items())


@query("loaded_policies", _RULES)
def q_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_table(spark, [policy_yaml(p) for p in POLICIES])
