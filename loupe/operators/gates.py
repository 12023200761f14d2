"""Decisions at the edges: capabilities, network, versions, profiles, exposure and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.plans.fixtures import bound
from loupe.registry import query

# Profiles as dimension -> (weight, least level, least evidence, refused autonomy, required), and the least assurance.
PROFILES: dict[str, tuple[int, dict[str, tuple[float, int, int, tuple[str, ...], bool]]]] = {
    "research": (2, {"origination": (1.0, 2, 0, (), True), "framing": (0.7, 1, 0, (), False), "validation": (0.9, 3, 1, (), True), "execution": (0.3, 1, 0, (), False), "accountability": (0.8, 3, 0, (), True)}),
    "software-delivery": (3, {"framing": (0.8, 2, 0, (), True), "decision_control": (0.9, 3, 1, (), True), "validation": (1.0, 3, 1, (), True), "execution": (0.4, 1, 0, (), False), "integration": (0.6, 1, 0, (), False), "accountability": (0.9, 3, 0, (), True)}),
    "creative-work": (1, {"origination": (1.0, 2, 0, (), True), "decision_control": (0.9, 2, 0, (), True), "integration": (0.7, 1, 0, (), False), "accountability": (0.8, 3, 0, (), True)}),
    "education": (1, {"execution": (1.0, 3, 0, ("delegated_execution", "autonomous_with_review"), True), "validation": (0.8, 2, 0, (), True), "origination": (0.6, 1, 0, (), False), "accountability": (0.7, 3, 0, (), True)}),
    "regulated-enterprise": (4, {"accountability": (1.0, 4, 2, (), True), "decision_control": (0.9, 3, 1, (), True), "validation": (1.0, 3, 1, (), True), "execution": (0.2, 1, 0, (), False), "evidence_quality": (0.8, 1, 0, (), False)}),
}
EXIT_CODES = {"success": 0, "review": 1, "violation": 2, "unsupported": 3}


def capability_decisions(plugins: DataFrame, granted: tuple[str, ...], blocked: DataFrame, schema: str) -> DataFrame:
    """Whether a plugin may run: block list, manifest, contract, then what it asks for."""
    plugins = plugins.join(blocked.select("detector_id").distinct().withColumn("is_blocked", F.lit(True)), "detector_id", "left")
    denied = F.array_except("capabilities", F.array(*map(F.lit, granted)))
    reason = F.when(F.col("is_blocked"), "blocked").when(~F.col("declared"), "no_manifest").when(~F.array_contains("schemas", schema), "schema").when(F.size(denied) > 0, "denied").otherwise("granted")
    return plugins.select("detector_id", reason.alias("reason"), F.when(reason == "denied", F.array_join(F.array_sort(denied), ",")).otherwise("").alias("denied"))


def network_decisions(requests: DataFrame, consents: DataFrame, policy: str, allowed: tuple[str, ...]) -> DataFrame:
    """The first reason to refuse each request; all attempts are recorded."""
    joined = requests.join(consents.withColumnRenamed("purpose", "granted_for"), "endpoint_group", "left")
    reason = (
        F.when(F.lit(policy != "explicit_only"), "policy")
        .when(~F.col("endpoint").isin(*allowed), "endpoint")
        .when(F.col("endpoints").isNull(), "no_consent")
        .when(~F.array_contains("endpoints", F.col("endpoint")), "not_covered")
        .when(F.col("granted_for") != F.col("purpose"), "purpose")
        .when(~F.coalesce("transport", F.lit(False)) if "transport" in requests.columns else F.lit(False), "transport")
        .when(F.col("timeout") <= 0, "timeout")
    )
    return joined.select("request_id", F.coalesce(reason, F.lit("")).alias("refusal"), reason.isNull().alias("allowed"))


def version_key(version: Column) -> Column:
    """Dotted versions as an array that sorts by number."""
    return F.transform(F.split(F.replace(version, F.lit("-"), F.lit(".")), r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p))


def version_allowed(plugins: DataFrame) -> DataFrame:
    """Whether a version lies between two bounds; a missing bound asks for nothing."""
    v, low, high = (version_key(F.col(c)) for c in ("version", "least", "most"))
    return plugins.select("plugin_id", ((F.col("least").isNull() | (v >= low)) & (F.col("most").isNull() | (v <= high))).alias("allowed"))


def profile_outcomes(claims: DataFrame, levels: DataFrame, profile: str) -> DataFrame:
    """What of a profile a record doesn't meet, from its strongest claim in each dimension."""
    spark = claims.sparkSession
    least, wanted = PROFILES[profile]
    dimension = spark.createDataFrame([(d, lv, ev, list(refused), req) for d, (_, lv, ev, refused, req) in wanted.items()], "dimension string, least_level int, least_evidence int, refused array<string>, required boolean")
    best = claims.groupBy("record_id", "dimension").agg(F.max_by(F.struct("level", "evidence", "autonomy"), F.struct("evidence", "level", (-F.col("position")).alias("p"))).alias("c"))
    need = levels.select("record_id", "assurance").join(F.broadcast(dimension))
    joined = need.join(best, ["record_id", "dimension"], "left")
    problem = F.when(F.col("c").isNull(), F.when(F.col("required"), "unclaimed")).when(F.col("c.level") < F.col("least_level"), "level").when(F.col("c.evidence") < F.col("least_evidence"), "evidence").when(F.array_contains("refused", F.col("c.autonomy")), "autonomy")
    unmet = joined.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(problem.isNotNull(), F.concat_ws(":", "dimension", problem)))), ",").alias("unmet"), F.first("assurance").alias("assurance"))
    low = F.col("assurance") < least
    return unmet.select("record_id", "unmet", low.alias("assurance_too_low"), ((F.col("unmet") == "") & ~low).alias("met"))


def exposure(releases: DataFrame) -> DataFrame:
    """All reasons not to show a learned score."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("manifest_valid"), "manifest"),
            F.when(F.col("evaluated_model") != F.col("model"), "model"),
            F.when(F.col("evaluated_corpus") != F.col("corpus"), "corpus"),
            F.when(~F.array_contains("thresholds", F.col("evaluated_threshold")), "threshold"),
            F.when(F.col("evaluation_problems") > 0, "evaluation"),
            F.when(F.coalesce(~F.col("regression_passed"), F.lit(False)), "regression"),
        )
    )
    return releases.select("release_id", F.array_join(reasons, ",").alias("refusals"), (F.size(reasons) == 0).alias("may_expose"))


def exit_codes(reports: DataFrame) -> DataFrame:
    """One code for a report, the gravest condition first."""
    has = lambda *s: F.arrays_overlap("statuses", F.array(*map(F.lit, s)))
    code = (
        F.when(F.col("blocking") | has("verifier_unavailable", "unsupported_container"), EXIT_CODES["unsupported"])
        .when(has("invalid") | (F.col("violations") > 0), EXIT_CODES["violation"])
        .when(has("valid", "no_manifest") | (F.col("reviews") > 0), EXIT_CODES["review"])
        .otherwise(EXIT_CODES["success"])
    )
    return reports.select("report_id", code.alias("exit_code"))


@query(
    "capability_decisions",
    """SELECT p_partkey AS detector_id, CASE WHEN p_partkey % 11 = 0 THEN 'blocked' WHEN p_partkey % 7 = 0 THEN 'no_manifest' WHEN p_partkey % 5 = 0 THEN 'schema' WHEN p_size % 3 = 0 THEN 'denied' ELSE 'granted' END AS reason,
    CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_size % 3 = 0 THEN 'network' ELSE '' END AS denied FROM part""",
)
def q_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT p_partkey AS detector_id, p_partkey % 7 <> 0 AS declared, array(CASE WHEN p_partkey % 5 = 0 THEN '0.0' ELSE '0.1' END) AS schemas,
      CASE WHEN p_size % 3 = 0 THEN array('read', 'network') ELSE array('read') END AS capabilities FROM part"""
    blocked = bound(spark, sf_dir, "SELECT p_partkey AS detector_id FROM part WHERE p_partkey % 11 = 0")
    return capability_decisions(bound(spark, sf_dir, sql), ("read",), blocked, "0.1")


_REQUESTS = "SELECT o_orderkey AS request_id, concat('h', o_custkey % 5) AS endpoint, o_custkey % 7 AS endpoint_group, CASE WHEN o_orderkey % 2 = 0 THEN 'verify' ELSE 'score' END AS purpose, o_orderkey % 13 AS timeout FROM orders"


@query(
    "network_decisions",
    f"""WITH r AS ({_REQUESTS}), c AS (SELECT *, CASE WHEN endpoint NOT IN ('h0', 'h1', 'h2') THEN 'endpoint' WHEN endpoint_group > 4 THEN 'no_consent' WHEN endpoint = 'h2' THEN 'not_covered' WHEN purpose <> 'verify' THEN 'purpose' WHEN timeout <= 0 THEN 'timeout' ELSE '' END AS refusal FROM r)
    SELECT request_id, refusal, refusal = '' AS allowed FROM c""",
)
def q_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    consents = spark.range(5).select(F.col("id").alias("endpoint_group"), F.array(F.lit("h0"), F.lit("h1")).alias("endpoints"), F.lit("verify").alias("purpose"))
    return network_decisions(bound(spark, sf_dir, _REQUESTS), consents, "explicit_only", ("h0", "h1", "h2"))


@query("version_allowed", "SELECT p_partkey AS plugin_id, p_size % 20 BETWEEN 9 AND 12 AS allowed FROM part")
def q_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_allowed(bound(spark, sf_dir, "SELECT p_partkey AS plugin_id, concat('0.', p_size % 20) AS version, '0.9' AS least, '0.12' AS most FROM part"))


_CLAIMS = "SELECT o_custkey AS record_id, CASE o_orderkey % 4 WHEN 0 THEN 'execution' WHEN 1 THEN 'validation' WHEN 2 THEN 'origination' ELSE 'accountability' END AS dimension, CAST(o_orderkey % 5 AS INT) AS level, CAST(o_orderkey % 3 AS INT) AS evidence, CASE WHEN o_orderkey % 7 = 0 THEN 'delegated_execution' ELSE 'assisted' END AS autonomy, o_orderkey AS position FROM orders"


@query(
    "profile_outcomes",
    f"""WITH c AS ({_CLAIMS}), r AS (SELECT DISTINCT c_custkey AS record_id, CAST(c_custkey % 3 AS INT) AS assurance FROM customer),
    w(dimension, l, refused, required) AS (VALUES ('execution', 3, true, true), ('validation', 2, false, true), ('origination', 1, false, false), ('accountability', 3, false, true)),
    b AS (SELECT record_id, dimension, arg_max({{'level': level, 'autonomy': autonomy}}, evidence::BIGINT * 100000000 + level * 10000000 - position) AS best FROM c GROUP BY 1, 2),
    p AS (SELECT r.record_id, assurance, w.dimension, CASE WHEN best IS NULL THEN CASE WHEN required THEN 'unclaimed' END WHEN best.level < l THEN 'level' WHEN refused AND best.autonomy = 'delegated_execution' THEN 'autonomy' END AS problem FROM r CROSS JOIN w LEFT JOIN b ON b.record_id = r.record_id AND b.dimension = w.dimension),
    u AS (SELECT record_id, max(assurance) AS assurance, coalesce(string_agg(dimension || ':' || problem, ',' ORDER BY dimension) FILTER (WHERE problem IS NOT NULL), '') AS unmet FROM p GROUP BY 1)
    SELECT record_id, unmet, assurance < 1 AS assurance_too_low, unmet = '' AND assurance >= 1 AS met FROM u""",
)
def q_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = bound(spark, sf_dir, "SELECT DISTINCT c_custkey AS record_id, CAST(c_custkey % 3 AS INT) AS assurance FROM customer")
    return profile_outcomes(bound(spark, sf_dir, _CLAIMS), levels, "education")


@query(
    "exposure_gate",
    """SELECT p_partkey AS release_id, concat_ws(',', CASE WHEN p_partkey % 13 = 0 THEN 'manifest' END, CASE WHEN p_partkey % 7 = 0 THEN 'model' END, CASE WHEN p_partkey % 5 = 0 THEN 'corpus' END, CASE WHEN p_size % 4 > 1 THEN 'threshold' END, CASE WHEN p_size % 3 > 0 THEN 'evaluation' END, CASE WHEN p_size % 6 = 1 THEN 'regression' END) AS refusals,
    p_partkey % 13 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_size % 4 <= 1 AND p_size % 3 = 0 AND p_size % 6 <> 1 AS may_expose FROM part""",
)
def q_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT p_partkey AS release_id, p_partkey % 13 <> 0 AS manifest_valid, 'm' AS model, CASE WHEN p_partkey % 7 = 0 THEN 'n' ELSE 'm' END AS evaluated_model, 'c' AS corpus, CASE WHEN p_partkey % 5 = 0 THEN 'd' ELSE 'c' END AS evaluated_corpus,
      array(0, 1) AS thresholds, p_size % 4 AS evaluated_threshold, p_size % 3 AS evaluation_problems, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 <> 1 END AS regression_passed FROM part"""
    return exposure(bound(spark, sf_dir, sql).withColumn("thresholds", F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).withColumn("evaluated_threshold", F.col("evaluated_threshold").cast("bigint")))


@query(
    "exit_codes",
    """SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 17 = 0 OR o_custkey % 6 IN (4, 5) THEN 3 WHEN o_custkey % 6 = 2 OR o_orderkey % 5 = 0 THEN 2 WHEN o_custkey % 6 IN (1, 3) OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS exit_code FROM orders""",
)
def q_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT o_orderkey AS report_id, o_orderkey % 17 = 0 AS blocking, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS violations, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS reviews,
      array(CASE o_custkey % 6 WHEN 0 THEN 'trusted' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'no_manifest' WHEN 4 THEN 'unsupported_container' ELSE 'verifier_unavailable' END) AS statuses FROM orders"""
    return exit_codes(bound(spark, sf_dir, sql))
