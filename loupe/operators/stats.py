"""Statistics of a detector's evaluation, and the gates that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.plans.fixtures import PREDICTIONS, bound
from loupe.registry import query

# The interval's z, the group size that suffices, and the limits of a sound evaluation.
Z = 1.959963984540054
SUFFICIENT = 30
GAP, ECE, COVERAGE, SPREAD = 0.05, 0.10, 0.90, 0.10
BINS = 10


def rate(hits: Column, total: Column) -> Column:
    """hits / total; nothing measured is no rate."""
    return F.when(total > 0, hits / total)


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """The bounds of Wilson's interval, null without observations."""
    p, n = hits / total, total
    scale = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / scale
    margin = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / scale
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(total > 0, low), F.when(total > 0, high)


def group_results(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts for all samples, each domain and each subgroup, in one pass."""
    sets = predictions.groupingSets([["domain"], ["subgroup"], []], "domain", "subgroup")
    flagged = F.col("score") >= threshold
    answered = F.col("score").isNotNull()
    return sets.agg(
        F.count_if(answered).alias("answered"),
        F.count_if(~answered).alias("abstained"),
        F.count_if(answered & ~F.col("is_positive")).alias("negatives"),
        F.count_if(answered & F.col("is_positive")).alias("positives"),
        F.count_if(~F.col("is_positive") & flagged).alias("false_positives"),
        F.count_if(F.col("is_positive") & ~flagged).alias("false_negatives"),
        F.grouping_id().alias("g"),
    ).select(F.when(F.col("g") == 1, "domain").when(F.col("g") == 2, "subgroup").otherwise("all").alias("kind"), F.coalesce("domain", "subgroup", F.lit("")).alias("name"), "answered", "abstained", "negatives", "positives", "false_positives", "false_negatives")


def with_rates(groups: DataFrame) -> DataFrame:
    """False positive and negative rates with their intervals, and whether a group is large enough."""
    low, high = wilson(F.col("false_positives"), F.col("negatives"))
    return groups.select(
        "kind",
        "name",
        F.round(rate(F.col("false_positives"), F.col("negatives")), 9).alias("fp_rate"),
        F.round(low, 9).alias("fp_low"),
        F.round(high, 9).alias("fp_high"),
        F.round(rate(F.col("false_negatives"), F.col("positives")), 9).alias("fn_rate"),
        (F.col("negatives") >= SUFFICIENT).alias("sufficient"),
    )


def calibration(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """Mean score and observed rate of each bin of scores."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return predictions.where("score is not null").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.avg(F.col("is_positive").cast("double")), 9).alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """The expected calibration error and the worst bin's gap."""
    gap = F.abs(F.col("mean_score") - F.col("observed"))
    return bins.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("expected_error"), F.round(F.max(gap), 6).alias("worst_gap"))


def evaluation(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Coverage, spread over domains, worst subgroup and the problems that these make, in one row."""
    groups = group_results(predictions, threshold)
    fp = rate(F.col("false_positives"), F.col("negatives"))
    ok = F.col("negatives") >= SUFFICIENT
    facts = groups.agg(
        F.max(F.when(F.col("kind") == "all", F.col("answered") / (F.col("answered") + F.col("abstained")))).alias("coverage"),
        F.max(F.when(F.col("kind") == "all", fp)).alias("fp_rate"),
        (F.max(F.when((F.col("kind") == "domain") & ok, fp)) - F.min(F.when((F.col("kind") == "domain") & ok, fp))).alias("domain_spread"),
        F.count_if((F.col("kind") == "domain") & ok).alias("domains"),
        F.max(F.when((F.col("kind") == "subgroup") & ok, fp)).alias("worst_rate"),
        F.max_by("name", F.when((F.col("kind") == "subgroup") & ok, F.struct(fp.alias("r"), F.col("name").alias("m")))).alias("worst_subgroup"),
        F.count_if((F.col("kind") != "all") & ~ok).alias("undersized"),
        F.max(F.when(F.col("kind") == "all", F.col("negatives"))).alias("negatives"),
        F.max(F.when(F.col("kind") == "all", F.col("answered"))).alias("scored"),
    )
    facts = facts.withColumn("domain_spread", F.when(F.col("domains") >= 2, F.col("domain_spread")))
    error = calibration_error(calibration(predictions))
    joined = facts.join(F.broadcast(error))
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("negatives"), F.lit(0)) < SUFFICIENT, "few_negatives"),
            F.when(F.col("worst_rate") - F.col("fp_rate") > GAP, "subgroup_gap"),
            F.when(F.col("undersized") > 0, "undersized"),
            F.when(F.coalesce(F.col("scored"), F.lit(0)) < SUFFICIENT, "few_scored").when(F.col("expected_error") > ECE, "calibration"),
            F.when(F.col("coverage") < COVERAGE, "coverage"),
            F.when(F.col("domain_spread") > SPREAD, "domain_spread"),
        )
    )
    return joined.select(*(F.round(c, 6).alias(c) for c in ("coverage", "fp_rate", "domain_spread", "worst_rate", "expected_error")), "worst_subgroup", "undersized", F.array_join(problems, ",").alias("problems"))


def release_regression(before: DataFrame, after: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Why a candidate may not replace a baseline, from the evaluations of both."""
    b, a = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("fp_rate", "worst_rate", "coverage", "expected_error"))) for df, p in ((before, "b"), (after, "a")))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("b_fp_rate").isNull() | F.col("a_fp_rate").isNull(), "no_rate").when(F.col("a_fp_rate") - F.col("b_fp_rate") > tolerance, "false_positives"),
            F.when(F.col("b_worst_rate").isNotNull() & F.col("a_worst_rate").isNull(), "subgroup_dropped").when(F.col("a_worst_rate") - F.col("b_worst_rate") > tolerance, "worst_subgroup"),
            F.when(F.col("a_coverage") < F.col("b_coverage") - 0.05, "coverage"),
            F.when(F.col("a_expected_error") - F.col("b_expected_error") > 0.05, "calibration"),
        )
    )
    return b.join(F.broadcast(a)).select(F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def duplicate_samples(predictions: DataFrame) -> DataFrame:
    """Sample ids that are scored more than once, which an evaluation refuses."""
    return predictions.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_GROUPS = f"""p AS ({PREDICTIONS}),
  k AS (SELECT 'all' AS kind, '' AS name, score, is_positive FROM p UNION ALL SELECT 'domain', domain, score, is_positive FROM p UNION ALL SELECT 'subgroup', subgroup, score, is_positive FROM p),
  g AS (SELECT kind, name, count(score) AS answered, count(*) - count(score) AS abstained, count(*) FILTER (WHERE score IS NOT NULL AND NOT is_positive) AS negatives, count(*) FILTER (WHERE score IS NOT NULL AND is_positive) AS positives,
    count(*) FILTER (WHERE NOT is_positive AND score >= {{t}}) AS false_positives, count(*) FILTER (WHERE is_positive AND score < {{t}}) AS false_negatives FROM k GROUP BY 1, 2)"""
_CALIBRATION = f"c AS (SELECT CAST(least(9, floor(score * 10)) AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(CAST(is_positive AS DOUBLE)), 9) AS observed FROM ({PREDICTIONS}) WHERE score IS NOT NULL GROUP BY 1)"
_EVALUATION = f"""WITH {_GROUPS}, {_CALIBRATION}, r AS (SELECT *, CASE WHEN negatives > 0 THEN false_positives / negatives END AS fp FROM g),
  f AS (SELECT max(CASE WHEN kind = 'all' THEN answered / (answered + abstained) END) AS coverage, max(CASE WHEN kind = 'all' THEN fp END) AS fp_rate,
    CASE WHEN count(*) FILTER (WHERE kind = 'domain' AND negatives >= 30) >= 2 THEN max(CASE WHEN kind = 'domain' AND negatives >= 30 THEN fp END) - min(CASE WHEN kind = 'domain' AND negatives >= 30 THEN fp END) END AS domain_spread,
    max(CASE WHEN kind = 'subgroup' AND negatives >= 30 THEN fp END) AS worst_rate, count(*) FILTER (WHERE kind <> 'all' AND negatives < 30) AS undersized, max(CASE WHEN kind = 'all' THEN negatives END) AS negatives, max(CASE WHEN kind = 'all' THEN answered END) AS scored FROM r),
  w AS (SELECT max(name) AS worst_subgroup FROM r WHERE kind = 'subgroup' AND negatives >= 30 AND fp = (SELECT worst_rate FROM f)),
  e AS (SELECT round(sum(n * abs(mean_score - observed)) / sum(n), 6) AS expected_error FROM c)
  SELECT round(coverage, 6) AS coverage, round(fp_rate, 6) AS fp_rate, round(domain_spread, 6) AS domain_spread, round(worst_rate, 6) AS worst_rate, expected_error, worst_subgroup, undersized,
    concat_ws(',', CASE WHEN coalesce(negatives, 0) < 30 THEN 'few_negatives' END, CASE WHEN worst_rate - fp_rate > 0.05 THEN 'subgroup_gap' END, CASE WHEN undersized > 0 THEN 'undersized' END, CASE WHEN coalesce(scored, 0) < 30 THEN 'few_scored' WHEN expected_error > 0.1 THEN 'calibration' END,
      CASE WHEN coverage < 0.9 THEN 'coverage' END, CASE WHEN domain_spread > 0.1 THEN 'domain_spread' END) AS problems
  FROM f, w, e"""


def predictions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, PREDICTIONS).withColumn("score", F.col("score").cast("double"))


@query("group_results", f"WITH {_GROUPS.format(t=0.5)} SELECT * FROM g")
def q_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_results(predictions_of(spark, sf_dir))


@query(
    "wilson_rates",
    f"""WITH {_GROUPS.format(t=0.5)}, r AS (SELECT *, CASE WHEN negatives > 0 THEN false_positives / negatives END AS p, CAST(negatives AS DOUBLE) AS n, {Z} AS z FROM g)
    SELECT kind, name, round(p, 9) AS fp_rate, CASE WHEN n > 0 THEN round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) END AS fp_low,
      CASE WHEN n > 0 THEN round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) END AS fp_high,
      CASE WHEN positives > 0 THEN round(false_negatives / positives, 9) END AS fn_rate, negatives >= 30 AS sufficient FROM r""",
)
def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rates(group_results(predictions_of(spark, sf_dir)))


@query("calibration", f"WITH {_CALIBRATION} SELECT * FROM c")
def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration(predictions_of(spark, sf_dir))


@query("calibration_error", f"WITH {_CALIBRATION} SELECT round(sum(n * abs(mean_score - observed)) / sum(n), 6) AS expected_error, round(max(abs(mean_score - observed)), 6) AS worst_gap FROM c")
def q_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_error(calibration(predictions_of(spark, sf_dir)))


@query("evaluation_problems", _EVALUATION.format(t=0.5))
def q_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation(predictions_of(spark, sf_dir))


@query(
    "release_regression",
    f"""WITH b AS ({_EVALUATION.format(t=0.5)}), a AS ({_EVALUATION.format(t=0.45)}), r AS (SELECT concat_ws(',', CASE WHEN b.fp_rate IS NULL OR a.fp_rate IS NULL THEN 'no_rate' WHEN a.fp_rate - b.fp_rate > 0.01 THEN 'false_positives' END,
    CASE WHEN b.worst_rate IS NOT NULL AND a.worst_rate IS NULL THEN 'subgroup_dropped' WHEN a.worst_rate - b.worst_rate > 0.01 THEN 'worst_subgroup' END, CASE WHEN a.coverage < b.coverage - 0.05 THEN 'coverage' END, CASE WHEN a.expected_error - b.expected_error > 0.05 THEN 'calibration' END) AS reasons FROM a, b)
    SELECT reasons, reasons = '' AS passed FROM r""",
)
def q_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions_of(spark, sf_dir)
    return release_regression(evaluation(p, 0.5), evaluation(p, 0.45))


#: Samples of which every thirteenth is scored again under another's name.
_SCORED = "SELECT concat('doc-', CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 ELSE doc_id END) AS sample_id FROM documents"


@query("duplicate_samples", f"SELECT sample_id, count(*) AS n FROM ({_SCORED}) GROUP BY 1 HAVING count(*) > 1")
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_samples(bound(spark, sf_dir, _SCORED))
