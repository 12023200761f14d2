"""Policies, bundles, remediation plans and the verdicts that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.joins import bounded, glob_regex
from loupe.operators.scan import findings_of
from loupe.plans.fixtures import FINDINGS, FINDINGS_SPARK, bound
from loupe.registry import query

# The built-in policies, and how safe each remediation is.
POLICIES: dict[str, tuple[str, dict[str, str]]] = {
    "audit": ("report", {"c2pa_provenance": "preserve", "provider_watermark": "preserve"}),
    "client-delivery": ("report", {"invisible_unicode": "review", "suspicious_unicode": "review", "explicit_ai_attribution": "remove", "generated_comment": "remove", "generator_metadata": "remove", "document_metadata": "remove", "personal_metadata": "remove", "image_metadata": "remove", "media_metadata": "review", "git_attribution": "review", "tooling_residue": "review", "c2pa_provenance": "preserve", "provider_watermark": "preserve", "stylistic_signal": "report", "design_style_signal": "report", "security_issue": "review"}),
    "privacy": ("report", {"document_metadata": "remove", "personal_metadata": "remove", "image_metadata": "remove", "media_metadata": "review", "generator_metadata": "remove", "c2pa_provenance": "preserve", "provider_watermark": "preserve", "git_attribution": "review"}),
    "safe-clean": ("report", {"invisible_unicode": "review", "suspicious_unicode": "review", "explicit_ai_attribution": "remove", "generated_comment": "remove", "generator_metadata": "remove", "document_metadata": "review", "personal_metadata": "review", "image_metadata": "review", "media_metadata": "review", "git_attribution": "review", "c2pa_provenance": "preserve", "provider_watermark": "preserve", "stylistic_signal": "report", "design_style_signal": "report"}),
    "strict": ("review", {"explicit_ai_attribution": "error", "generated_comment": "error", "generator_metadata": "error", "git_attribution": "error", "document_metadata": "error", "personal_metadata": "error", "image_metadata": "error", "media_metadata": "error", "security_issue": "error", "c2pa_provenance": "preserve", "provider_watermark": "preserve", "stylistic_signal": "report", "design_style_signal": "report"}),
}
SAFE_METADATA = ("docx.remove-metadata-field", "docx.remove-custom-property", "pptx.remove-metadata-field", "pptx.remove-custom-property", "xlsx.remove-metadata-field", "xlsx.remove-custom-property", "odf.remove-metadata-field", "pdf.remove-metadata-field", "pdf.remove-xmp", "image.remove-metadata", "media.remove-metadata-field")
DESTRUCTIVE = ("git.rewrite-history",)
PROTECTED = ("c2pa_provenance", "provider_watermark")
INDICATORS = ("invisible_unicode", "suspicious_unicode", "explicit_ai_attribution", "generated_comment", "generator_metadata", "git_attribution", "tooling_residue", "document_metadata", "personal_metadata", "image_metadata")
UNICODE_INDICATORS = ("suspicious", "invisible", "control")
MAX_LIFETIME_DAYS = 366
#: How safe each remediation is; what isn't named changes content predictably.
REMEDIATION_SAFETY = dict.fromkeys(SAFE_METADATA, "safe_metadata") | dict.fromkeys(DESTRUCTIVE, "destructive")


def policy_rules(spark: SparkSession) -> DataFrame:
    """The rules of all policies: policy, category, action."""
    return spark.createDataFrame([(p, c, a) for p, (_, rules) in POLICIES.items() for c, a in rules.items()], "policy string, category string, action string")


def policy_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, d) for p, (d, _) in POLICIES.items()], "policy string, default_action string")


def policy_problems(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """Policies that would remove protected provenance, by a rule or by default."""
    by_rule = rules.where(F.col("category").isin(*PROTECTED) & (F.col("action") == "remove")).select("policy", "category")
    kept = rules.where(F.col("category").isin(*PROTECTED) & (F.col("action") == "preserve")).select("policy", "category")
    removing = defaults.where("default_action = 'remove'").select("policy", F.explode(F.array(*map(F.lit, PROTECTED))).alias("category"))
    return by_rule.unionByName(removing.join(kept, ["policy", "category"], "left_anti")).distinct()


def policy_decisions(findings: DataFrame, policy: str) -> DataFrame:
    """Each finding's action; the evidence itself stays as it is."""
    spark = findings.sparkSession
    rules = F.broadcast(policy_rules(spark).where(F.col("policy") == policy).select("category", "action"))
    return findings.join(rules, "category", "left").withColumn("action", F.coalesce("action", F.lit(POLICIES[policy][0])))


def policy_counts(decisions: DataFrame) -> DataFrame:
    """What needs review, and what violates the policy."""
    return decisions.agg(F.count_if(F.col("action").isin("review", "remove")).alias("review_count"), F.count_if(F.col("action") == "error").alias("violation_count"))


#: Controls that a bundle may hold.
MAX_CONTROLS = 10_000
_EQUAL = {"finding_id": "id", "category": "category", "detector_id": "detector_id", "severity": "severity", "provider": "provider"}


def matching_selectors(findings: DataFrame, selectors: DataFrame) -> DataFrame:
    """Findings (f) with each selector (s) they meet. What a selector leaves null, or doesn't have, it doesn't ask for.

    Paths are globs, told apart by case; a back-slash is a slash. A bundle holds at most MAX_CONTROLS selectors, so
    they are broadcast; more are refused.
    """
    have, known = set(selectors.columns), set(findings.columns)
    s = bounded(selectors.withColumn("_path", glob_regex(F.col("path_glob"))), MAX_CONTROLS, "policy controls").alias("s")
    meets = F.lit(True)
    for mine, theirs in _EQUAL.items():
        if mine in have and theirs in known:
            meets = meets & (F.col(f"s.{mine}").isNull() | (F.col(f"s.{mine}") == F.col(f"f.{theirs}")))
    if "tags_all" in have and "tags" in known:
        meets = meets & (F.size(F.array_except(F.coalesce("s.tags_all", F.array().cast("array<string>")), F.coalesce("f.tags", F.array().cast("array<string>")))) == 0)
    meets = meets & (F.col("s._path").isNull() | F.rlike(F.replace("f.artifact_path", F.lit("\\"), F.lit("/")), F.col("s._path")))
    return findings.alias("f").join(s, F.coalesce(meets, F.lit(False)))


def bundle_decisions(findings: DataFrame, selectors: DataFrame, baseline: DataFrame, policy: str, now: int) -> DataFrame:
    """Precedence: protected, active exception, active suppression, baseline, profile.

    Active exceptions that ask for different actions on one finding are a conflict: the decision is left open, and
    ``conflict`` names them. A caller that can't go on with open decisions calls ``refuse_conflicts``.
    """
    decided = policy_decisions(findings, policy)
    met = matching_selectors(decided, selectors.where(F.col("expires_at") > now))
    exceptions = F.array_sort(F.collect_list(F.when(F.col("s.kind") == "exception", F.struct("s.selector_id", "s.action"))))
    best = met.groupBy("f.id").agg(exceptions.alias("exceptions"), F.min(F.when(F.col("s.kind") == "suppression", F.col("s.selector_id"))).alias("suppression"))
    known = baseline.select("id").distinct().withColumn("in_baseline", F.lit(True))
    joined = decided.join(best, "id", "left").join(known, "id", "left")
    protected = F.col("category").isin(*PROTECTED)
    excepted = F.coalesce(F.size("exceptions"), F.lit(0)) > 0
    torn = excepted & ~protected & (F.size(F.array_distinct(F.col("exceptions.action"))) > 1)
    source = F.when(protected, "protected").when(torn, "conflict").when(excepted, "exception").when(F.col("suppression").isNotNull(), "suppression").when(F.col("in_baseline"), "baseline").otherwise("profile")
    action = F.when(source == "protected", "preserve").when(source == "conflict", None).when(source == "exception", F.get("exceptions.action", F.lit(0))).when(source.isin("suppression", "baseline"), "ignore").otherwise(F.col("action"))
    return joined.select("id", source.alias("decided_by"), action.alias("action"), F.when(torn, F.array_join(F.col("exceptions.selector_id"), ",")).alias("conflict"))


def refuse_conflicts(decisions: DataFrame) -> DataFrame:
    """The decisions, whose evaluation fails where exceptions conflict."""
    return decisions.withColumn("action", F.when(F.col("conflict").isNull(), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("conflicting exceptions match "), "id", F.lit(": "), "conflict"))))


def bundle_audit(findings: DataFrame, selectors: DataFrame, baseline: DataFrame, policy: str, now: int) -> DataFrame:
    """What overrode a decision, what could not as the finding is protected, and every expired control that matched."""
    decided = bundle_decisions(findings, selectors, baseline, policy, now)
    met = matching_selectors(findings, selectors).select(F.col("f.id").alias("id"), F.col("s.selector_id").alias("rule_id"), F.col("s.kind").alias("kind"), (F.col("s.expires_at") <= now).alias("expired"))
    known = baseline.select("id").distinct().withColumn("in_baseline", F.lit(True))
    active = met.where("not expired").groupBy("id").agg(F.min(F.when(F.col("kind") == "exception", F.col("rule_id"))).alias("exception"), F.min(F.when(F.col("kind") == "suppression", F.col("rule_id"))).alias("suppression"))
    # a protected finding names the first exception that matched, expired or not, else the first suppression
    any_rule = met.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("kind") == "exception", F.col("rule_id"))), F.min("rule_id")).alias("any_rule"))
    joined = decided.join(active, "id", "left").join(any_rule, "id", "left").join(known, "id", "left")
    rule = F.when(F.col("decided_by") == "protected", F.col("any_rule")).when(F.col("decided_by") == "exception", F.col("exception")).when(F.col("decided_by") == "suppression", F.col("suppression"))
    main = joined.where(F.col("decided_by").isin("exception", "suppression", "baseline") | ((F.col("decided_by") == "protected") & (F.col("any_rule").isNotNull() | F.col("in_baseline")))).select("id", F.col("decided_by").alias("source"), rule.alias("rule_id"), "action", F.lit(False).alias("expired"))
    late = met.where("expired").join(decided.select("id", "action"), "id").select("id", F.col("kind").alias("source"), "rule_id", "action", "expired")
    return main.unionByName(late)


def bundle_problems(bundles: DataFrame, now: int) -> DataFrame:
    """Why a bundle (bundle_id, issued_at, expires_at in days, signature_ok, content_digest, claimed_digest) can't be applied."""
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("content_digest") != F.col("claimed_digest"), F.lit(True)), "content"),
            F.when(F.col("signature_ok").isNull(), "unsigned").when(~F.col("signature_ok"), "signature"),
            F.when(F.col("issued_at") > now, "not_yet"),
            F.when(F.col("expires_at") <= now, "expired"),
            F.when(F.col("expires_at") - F.col("issued_at") > MAX_LIFETIME_DAYS, "lifetime"),
        )
    )
    return bundles.select("bundle_id", F.array_join(reasons, ",").alias("problems"), (F.size(reasons) == 0).alias("applicable"))


def remediation_plan(decisions: DataFrame) -> DataFrame:
    """What happens to each finding: preserve, review, planned or blocked. Others drop out.

    An artifact that holds protected provenance blocks every removal in it.
    """
    tainted = decisions.where(F.col("category").isin(*PROTECTED)).select("artifact_path").distinct().withColumn("tainted", F.lit(True))
    joined = decisions.join(tainted, "artifact_path", "left")
    plannable = F.col("removable") & F.col("remediation_id").isNotNull()
    state = (
        F.when(F.col("action") == "preserve", "preserve")
        .when(F.col("action").isin("review", "error"), "review")
        .when(F.col("action") == "remove", F.when(F.col("tainted"), "blocked_protected").when(plannable, "planned").otherwise("blocked"))
    )
    return joined.withColumn("disposition", state).where("disposition is not null").select("id", "artifact_path", "remediation_id", "disposition")


def plan_steps(plan: DataFrame) -> DataFrame:
    """One step for each artifact and remediation, named by what it covers."""
    ids = F.array_sort(F.collect_list("id"))
    steps = plan.where("disposition = 'planned'").groupBy("artifact_path", "remediation_id").agg(ids.alias("ids"))
    safety = F.when(F.col("remediation_id").isin(*SAFE_METADATA), "safe_metadata").when(F.col("remediation_id").isin(*DESTRUCTIVE), "destructive").otherwise("predictable_content")
    return steps.select("artifact_path", "remediation_id", F.size("ids").cast("long").alias("n"), F.sha2(F.concat_ws("|", "artifact_path", "remediation_id", F.array_join("ids", ",")), 256).alias("step_id"), safety.alias("safety"))


def remediation_safety(steps: DataFrame) -> DataFrame:
    """Steps with the safety of their remediation, by the catalogue."""
    catalogue = steps.sparkSession.createDataFrame(sorted(REMEDIATION_SAFETY.items()), "remediation_id string, safety string")
    return steps.join(F.broadcast(catalogue), "remediation_id", "left").withColumn("safety", F.coalesce("safety", F.lit("predictable_content")))


def recorded_decisions(findings: DataFrame, recorded: DataFrame, policy: str) -> DataFrame:
    """Each finding's recorded action; where none was recorded, the policy's."""
    told = recorded.groupBy("id").agg(F.min("action").alias("recorded"))
    return policy_decisions(findings, policy).join(told, "id", "left").withColumn("action", F.coalesce("recorded", "action")).drop("recorded")


def plan_violations(plan: DataFrame, findings: DataFrame, before: DataFrame, after: DataFrame, diagnostics: DataFrame, planned_policy: str, policy: str) -> DataFrame:
    """All that forbids applying a plan (id, artifact_path, remediation_id, disposition): (check, subject).

    The policy must be the one planned with, the scan complete, content as it was, every finding in the report as it
    was planned, each planned once, its action a removal, and no planned artifact may hold protected provenance.
    """
    spark = plan.sparkSession
    steps = plan.where("disposition = 'planned'").select("id", "artifact_path")
    told = lambda df, check, subject: df.select(F.lit(check).alias("check"), F.col(subject).alias("subject"))
    decided = policy_decisions(findings, policy)
    now = steps.join(decided.select("id", F.col("artifact_path").alias("at"), "action"), "id", "left")
    changed = before.join(after.withColumnRenamed("content", "now"), "artifact_path", "left").where(~F.col("content").eqNullSafe(F.col("now")))
    tainted = findings.where(F.col("category").isin(*PROTECTED)).select("artifact_path").distinct()
    out = told(spark.range(1).select(F.lit(planned_policy).alias("p")).where(F.lit(planned_policy != policy)), "policy", "p")
    for df, check, subject in (
        (diagnostics.where(F.col("severity").isin("high", "critical")), "incomplete", "artifact_path"),
        (changed.join(steps.select("artifact_path").distinct(), "artifact_path", "left_semi"), "content", "artifact_path"),
        (now.where("at is null"), "missing", "id"),
        (now.where("at <> artifact_path"), "mismatched", "id"),
        (steps.groupBy("id").count().where("count > 1"), "duplicate", "id"),
        (now.where("action <> 'remove'"), "action", "id"),
        (steps.join(tainted, "artifact_path", "left_semi").select("artifact_path").distinct(), "protected", "artifact_path"),
    ):
        out = out.unionByName(told(df, check, subject))
    return out


def plan_problems(steps: DataFrame, findings: DataFrame) -> DataFrame:
    """Planned ids that the report doesn't hold, holds differently, or that are planned twice."""
    counts = steps.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.first("artifact_path").alias("planned_path"))
    joined = counts.join(findings.select("id", "artifact_path"), "id", "left")
    problem = F.when(F.col("artifact_path").isNull(), "missing").when(F.col("artifact_path") != F.col("planned_path"), "mismatched").when(F.col("times") > 1, "duplicate")
    return joined.withColumn("problem", problem).where("problem is not null").select("id", "problem")


def indicator_scope(findings: DataFrame) -> DataFrame:
    """Findings that count against a delivery."""
    unicode_ok = ~F.col("category").isin("invisible_unicode", "suspicious_unicode") | F.coalesce(F.col("safety_class").isin(*UNICODE_INDICATORS), F.lit(False))
    return findings.where(F.col("category").isin(*INDICATORS) & unicode_ok)


def delivery_status(findings: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Incomplete if a diagnostic is high, else whether indicators remain."""
    left = indicator_scope(findings).agg(F.count(F.lit(1)).alias("indicators"))
    high = diagnostics.agg(F.count_if(F.col("severity").isin("high", "critical")).alias("high"))
    return left.join(F.broadcast(high)).select("indicators", "high", F.when(F.col("high") > 0, "incomplete").when(F.col("indicators") > 0, "indicators_remain").otherwise("clear").alias("status"))


# The caveat that goes with each kind of confidence and of provenance, by a short name.
CONFIDENCE_CAVEATS = {"deterministic": "trace_only", "verified": "mechanism_scope", "probabilistic": "measurement_only", "heuristic": "prompt_for_review"}
PROVENANCE_CAVEATS = {"attribution": "anyone_can_write_it", "metadata": "editable", "provenance_metadata": "read_not_checked", "authenticated_provenance": "as_strong_as_anchors", "provider_watermark": "observed_not_verified", "heuristic": "never_provenance"}


def _mapped(values: dict[str, str], column: str):
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(column))


def evidence_limits(findings: DataFrame) -> DataFrame:
    """The caveats that each finding carries."""
    limits = F.array_compact(F.array(_mapped(CONFIDENCE_CAVEATS, "confidence_type"), F.try_element_at(F.create_map(*(F.lit(x) for kv in PROVENANCE_CAVEATS.items() for x in kv)), F.col("provenance_class"))))
    return findings.select("id", F.array_join(limits, ",").alias("caveats"))


#: A hand-written bundle: an exception on a detector, one that conflicts with it, an expired one, and globs that hold
#: what LIKE would take for a wildcard.
SELECTORS = """
SELECT 'e1' AS selector_id, 'exception' AS kind, 'generator_metadata' AS category, CAST(NULL AS {s}) AS detector_id, CAST(NULL AS {s}) AS severity, CAST(NULL AS {s}) AS path_glob, CAST(NULL AS {s}) AS provider, CAST(NULL AS {s}) AS tags, 'remove' AS action, 200 AS expires_at
UNION ALL SELECT 'e2', 'exception', NULL, 'detector.2', 'high', NULL, NULL, NULL, 'review', 50
UNION ALL SELECT 'e3', 'exception', 'generator_metadata', 'detector.3', NULL, NULL, NULL, NULL, 'review', 200
UNION ALL SELECT 's1', 'suppression', 'invisible_unicode', NULL, NULL, 'src/a_b1*', NULL, NULL, 'ignore', 200
UNION ALL SELECT 's2', 'suppression', NULL, NULL, 'info', 'src/F?.txt', NULL, NULL, 'ignore', 200
UNION ALL SELECT 's3', 'suppression', NULL, NULL, NULL, 'src/50%[[]x]?[0-4].txt', NULL, NULL, 'ignore', 200
UNION ALL SELECT 's4', 'suppression', NULL, NULL, NULL, 'src/a_b[!1-8]*.TXT', NULL, NULL, 'ignore', 200
UNION ALL SELECT 's5', 'suppression', NULL, NULL, NULL, NULL, 'p1', 't0,t2', 'ignore', 200
UNION ALL SELECT 's6', 'suppression', 'c2pa_provenance', NULL, NULL, 'src*F1?.txt', NULL, NULL, 'ignore', 40
"""
#: The findings of that bundle: paths with signs that globs and LIKE know, providers and tags.
_F2 = f"""SELECT id, category, detector_id, severity, emit_ord, CASE emit_ord % 4 WHEN 0 THEN replace(artifact_path, 'F', 'a_b') WHEN 1 THEN replace(artifact_path, 'F', '50%[x]') WHEN 2 THEN replace(artifact_path, '/', '{{bs}}') ELSE artifact_path END AS artifact_path,
  CASE WHEN emit_ord % 3 = 0 THEN NULL ELSE concat('p', emit_ord % 2) END AS provider, split(concat('t', emit_ord % 3, ',t', emit_ord % 5), ',') AS tags FROM ({{f}})"""
_F2_SPARK, _F2_DUCK = _F2.format(f=FINDINGS_SPARK, bs="\\\\"), _F2.format(f=FINDINGS, bs="\\")
_MEETS = """(s.category IS NULL OR s.category = f.category) AND (s.detector_id IS NULL OR s.detector_id = f.detector_id) AND (s.severity IS NULL OR s.severity = f.severity) AND (s.provider IS NULL OR coalesce(s.provider = f.provider, false))
    AND (s.tags IS NULL OR list_has_all(f.tags, split(s.tags, ','))) AND (s.path_glob IS NULL OR replace(f.artifact_path, chr(92), '/') GLOB s.path_glob)"""
BASELINE = "SELECT id FROM f WHERE emit_ord % 23 = 0"


def _selectors(spark: SparkSession) -> DataFrame:
    return spark.sql(SELECTORS.format(s="STRING")).withColumn("tags_all", F.split("tags", ",")).drop("tags")


def _selectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, _F2_SPARK)


def _case(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _decided(policy: str) -> str:
    default, rules = POLICIES[policy]
    return f"SELECT *, coalesce({_case(rules, 'category')}, '{default}') AS action FROM f"


@query("policy_decisions", f"WITH f AS ({FINDINGS}) SELECT id, category, action FROM ({_decided('client-delivery')})")
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_decisions(findings_of(spark, sf_dir), "client-delivery").select("id", "category", "action")


@query("policy_counts", f"WITH f AS ({FINDINGS}) SELECT count(*) FILTER (WHERE action IN ('review', 'remove')) AS review_count, count(*) FILTER (WHERE action = 'error') AS violation_count FROM ({_decided('strict')})")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_counts(policy_decisions(findings_of(spark, sf_dir), "strict"))


#: Policies that customers wrote: some remove what is protected, by a rule or by default.
_WRITTEN = "SELECT concat('p', c_custkey) AS policy, CASE c_custkey % 4 WHEN 0 THEN 'c2pa_provenance' WHEN 1 THEN 'provider_watermark' ELSE 'document_metadata' END AS category, CASE c_custkey % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'preserve' ELSE 'review' END AS action FROM customer"
_DEFAULTS = "SELECT concat('p', c_custkey) AS policy, CASE WHEN c_custkey % 5 = 0 THEN 'remove' ELSE 'report' END AS default_action FROM customer"


@query(
    "policy_problems",
    f"""WITH r AS ({_WRITTEN}), d AS ({_DEFAULTS}), x AS (SELECT policy, category FROM d, (VALUES ('c2pa_provenance'), ('provider_watermark')) AS v(category) WHERE default_action = 'remove')
    SELECT policy, category FROM r WHERE category IN ('c2pa_provenance', 'provider_watermark') AND action = 'remove' UNION SELECT policy, category FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.policy = x.policy AND r.category = x.category AND action = 'preserve')""",
)
def q_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_problems(bound(spark, sf_dir, _WRITTEN), bound(spark, sf_dir, _DEFAULTS))


@query("plan_violations")
def q_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings_of(spark, sf_dir)
    plan = remediation_plan(policy_decisions(found, "client-delivery"))
    late = found.where("emit_ord % 19 <> 0")
    content = found.groupBy("artifact_path").agg(F.count(F.lit(1)).alias("content"))
    after = late.groupBy("artifact_path").agg(F.count(F.lit(1)).alias("content"))
    diagnostics = content.select("artifact_path", F.when(F.col("content") > 60, "high").otherwise("info").alias("severity"))
    return plan_violations(plan, late, content, after, diagnostics, "client-delivery", "privacy")


_BUNDLE = f"""f AS ({_F2_DUCK}), s AS ({SELECTORS.format(s="VARCHAR")}), d AS ({_decided("strict")}), met AS (SELECT f.id, s.selector_id, s.kind, s.action, s.expires_at <= 100 AS expired FROM f JOIN s ON {_MEETS}),
    m AS (SELECT id, min(CASE WHEN kind = 'exception' THEN selector_id END) AS e, count(DISTINCT CASE WHEN kind = 'exception' THEN action END) AS n, arg_min(action, selector_id) FILTER (WHERE kind = 'exception') AS ea, string_agg(selector_id, ',' ORDER BY selector_id) FILTER (WHERE kind = 'exception') AS es,
      min(CASE WHEN kind = 'suppression' THEN selector_id END) AS u FROM met WHERE NOT expired GROUP BY id),
    j AS (SELECT d.id, d.action, e, u, ea, es, CASE WHEN d.category IN ('c2pa_provenance', 'provider_watermark') THEN 'protected' WHEN n > 1 THEN 'conflict' WHEN e IS NOT NULL THEN 'exception' WHEN u IS NOT NULL THEN 'suppression' WHEN d.emit_ord % 23 = 0 THEN 'baseline' ELSE 'profile' END AS decided_by, d.emit_ord % 23 = 0 AS known FROM d LEFT JOIN m ON m.id = d.id),
    r AS (SELECT id, decided_by, CASE decided_by WHEN 'protected' THEN 'preserve' WHEN 'conflict' THEN NULL WHEN 'exception' THEN ea WHEN 'profile' THEN action ELSE 'ignore' END AS action, CASE WHEN decided_by = 'conflict' THEN es END AS conflict, e, u, known FROM j)"""


@query("selector_theta_join", f"WITH f AS ({_F2_DUCK}), s AS ({SELECTORS.format(s='VARCHAR')}) SELECT f.id, s.selector_id FROM f JOIN s ON {_MEETS}")
def q_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_selectors(_selectable(spark, sf_dir), _selectors(spark)).select("f.id", "s.selector_id")


@query("bundle_precedence", f"WITH {_BUNDLE} SELECT id, decided_by, action, conflict FROM r")
def q_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _selectable(spark, sf_dir)
    return bundle_decisions(found, _selectors(spark), found.where("emit_ord % 23 = 0"), "strict", 100)


@query(
    "bundle_audit",
    f"""WITH {_BUNDLE}, a AS (SELECT id, coalesce(min(CASE WHEN kind = 'exception' THEN selector_id END), min(selector_id)) AS any_rule FROM met GROUP BY id)
    SELECT r.id, decided_by AS source, CASE decided_by WHEN 'protected' THEN any_rule WHEN 'exception' THEN e WHEN 'suppression' THEN u END AS rule_id, action, false AS expired FROM r LEFT JOIN a USING (id) WHERE decided_by IN ('exception', 'suppression', 'baseline') OR (decided_by = 'protected' AND (any_rule IS NOT NULL OR known))
    UNION ALL SELECT r.id, kind, selector_id, r.action, true FROM met JOIN r USING (id) WHERE expired""",
)
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _selectable(spark, sf_dir)
    return bundle_audit(found, _selectors(spark), found.where("emit_ord % 23 = 0"), "strict", 100)


_BUNDLES = """SELECT concat('b', o_orderkey) AS bundle_id, CAST(o_custkey % 300 AS BIGINT) AS issued_at, CAST(o_custkey % 300 + 100 + o_orderkey % 350 AS BIGINT) AS expires_at, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS signature_ok,
  concat('d', o_orderkey % 9) AS content_digest, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('d', o_orderkey % 9 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) END AS claimed_digest FROM orders"""


@query(
    "bundle_problems",
    f"""WITH b AS ({_BUNDLES}), r AS (SELECT bundle_id, concat_ws(',', CASE WHEN content_digest IS DISTINCT FROM claimed_digest THEN 'content' END, CASE WHEN signature_ok IS NULL THEN 'unsigned' WHEN NOT signature_ok THEN 'signature' END, CASE WHEN issued_at > 200 THEN 'not_yet' END,
      CASE WHEN expires_at <= 200 THEN 'expired' END, CASE WHEN expires_at - issued_at > 366 THEN 'lifetime' END) AS problems FROM b) SELECT bundle_id, problems, problems = '' AS applicable FROM r""",
)
def q_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_problems(bound(spark, sf_dir, _BUNDLES), 200)


@query("remediation_safety", f"WITH f AS ({FINDINGS}) SELECT id, remediation_id, CASE WHEN remediation_id IN ({', '.join(repr(r) for r in SAFE_METADATA)}) THEN 'safe_metadata' WHEN remediation_id = 'git.rewrite-history' THEN 'destructive' ELSE 'predictable_content' END AS safety FROM f WHERE remediation_id IS NOT NULL")
def q_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation_safety(findings_of(spark, sf_dir).where("remediation_id is not null").select("id", "remediation_id"))


@query("recorded_decisions", f"WITH f AS ({FINDINGS}) SELECT id, CASE WHEN emit_ord % 5 = 0 THEN CASE WHEN emit_ord % 2 = 0 THEN 'ignore' ELSE 'remove' END ELSE action END AS action FROM ({_decided('privacy')})")
def q_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings_of(spark, sf_dir)
    recorded = found.where("emit_ord % 5 = 0").select("id", F.when(F.col("emit_ord") % 2 == 0, "ignore").otherwise("remove").alias("action"))
    return recorded_decisions(found, recorded, "privacy").select("id", "action")


_PLAN = f"""t AS (SELECT DISTINCT artifact_path FROM f WHERE category IN ('c2pa_provenance', 'provider_watermark')),
    p AS (SELECT id, artifact_path, remediation_id, CASE WHEN action = 'preserve' THEN 'preserve' WHEN action IN ('review', 'error') THEN 'review' WHEN action = 'remove' THEN
      CASE WHEN artifact_path IN (SELECT artifact_path FROM t) THEN 'blocked_protected' WHEN removable AND remediation_id IS NOT NULL THEN 'planned' ELSE 'blocked' END END AS disposition FROM ({_decided("client-delivery")}))"""


@query("remediation_plan", f"WITH f AS ({FINDINGS}), {_PLAN} SELECT id, artifact_path, remediation_id, disposition FROM p WHERE disposition IS NOT NULL")
def q_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation_plan(policy_decisions(findings_of(spark, sf_dir), "client-delivery"))


@query(
    "plan_steps",
    f"""WITH f AS ({FINDINGS}), {_PLAN} SELECT artifact_path, remediation_id, count(*) AS n, sha256(concat_ws('|', artifact_path, remediation_id, string_agg(id, ',' ORDER BY id))) AS step_id,
    CASE WHEN remediation_id = 'pdf.remove-xmp' THEN 'safe_metadata' ELSE 'predictable_content' END AS safety FROM p WHERE disposition = 'planned' GROUP BY 1, 2""",
)
def q_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_steps(remediation_plan(policy_decisions(findings_of(spark, sf_dir), "client-delivery")))


@query(
    "plan_problems",
    f"""WITH f AS ({FINDINGS}), s AS (SELECT CASE WHEN emit_ord % 31 = 0 THEN concat(id, 'x') ELSE id END AS id, CASE WHEN emit_ord % 37 = 0 THEN 'elsewhere' ELSE artifact_path END AS planned, emit_ord FROM f),
    c AS (SELECT id, count(*) + count(*) FILTER (WHERE emit_ord % 41 = 0) AS times, min(planned) AS planned FROM s GROUP BY 1),
    p AS (SELECT c.id, CASE WHEN f.id IS NULL THEN 'missing' WHEN planned <> artifact_path THEN 'mismatched' WHEN times > 1 THEN 'duplicate' END AS problem FROM c LEFT JOIN f ON f.id = c.id)
    SELECT id, problem FROM p WHERE problem IS NOT NULL""",
)
def q_plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings_of(spark, sf_dir)
    steps = found.select(F.expr("CASE WHEN emit_ord % 31 = 0 THEN concat(id, 'x') ELSE id END").alias("id"), F.expr("CASE WHEN emit_ord % 37 = 0 THEN 'elsewhere' ELSE artifact_path END").alias("artifact_path"), "emit_ord")
    twice = steps.where("emit_ord % 41 = 0")
    return plan_problems(steps.unionByName(twice), found)


@query(
    "indicator_scope",
    f"""WITH f AS ({FINDINGS}) SELECT category, count(*) AS n FROM f WHERE category IN ({", ".join(f"'{c}'" for c in INDICATORS)})
    AND (category NOT IN ('invisible_unicode', 'suspicious_unicode') OR coalesce(safety_class IN ('suspicious', 'invisible', 'control'), false)) GROUP BY 1""",
)
def q_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicator_scope(findings_of(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "delivery_status",
    f"""WITH f AS ({FINDINGS}), i AS (SELECT count(*) AS indicators FROM f WHERE category IN ({", ".join(f"'{c}'" for c in INDICATORS)}) AND (category NOT IN ('invisible_unicode', 'suspicious_unicode') OR coalesce(safety_class IN ('suspicious', 'invisible', 'control'), false))),
    d AS (SELECT count(*) FILTER (WHERE n > 60) AS high FROM (SELECT count(*) AS n FROM f GROUP BY artifact_path))
    SELECT indicators, high, CASE WHEN high > 0 THEN 'incomplete' WHEN indicators > 0 THEN 'indicators_remain' ELSE 'clear' END AS status FROM i, d""",
)
def q_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings_of(spark, sf_dir)
    diagnostics = found.groupBy("artifact_path").agg(F.when(F.count(F.lit(1)) > 60, "high").otherwise("info").alias("severity"))
    return delivery_status(found, diagnostics)


@query("evidence_limits", f"WITH f AS ({FINDINGS}) SELECT id, concat_ws(',', {_case(CONFIDENCE_CAVEATS, 'confidence_type')}, {_case(PROVENANCE_CAVEATS, 'provenance_class')}) AS caveats FROM f")
def q_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_limits(findings_of(spark, sf_dir))
