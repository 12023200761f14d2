"""From findings to a report: budgets, order, summaries, views and inventory checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loupe.plans.fixtures import AFTER, BEFORE, FINDINGS, FINDINGS_SPARK, bound
from loupe.registry import query


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, FINDINGS_SPARK)


def finding_budget(findings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` findings, artifact by artifact, in order of emission.

    Only as many artifacts as the budget has findings can matter: their counts
    are summed up in order, and each finding's rank starts from there.
    """
    counts = findings.groupBy("artifact_path").agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.lower("artifact_path"), "artifact_path").limit(limit + 1)
    before = Window.orderBy(F.lower("artifact_path"), "artifact_path").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < limit)
    rank = F.row_number().over(Window.partitionBy("artifact_path").orderBy("emit_ord", "id"))
    kept = findings.join(F.broadcast(first) if limit <= 100_000 else first, "artifact_path").withColumn("position", (F.col("before") + rank).cast("long"))
    return kept.where(F.col("position") <= limit).select("artifact_path", "id", "position", (F.col("before") + F.col("n") > limit).alias("artifact_truncated"))


def detector_overflow(findings: DataFrame, limit: int) -> DataFrame:
    """A detector that finds more than ``limit`` in an artifact loses its output there: a diagnostic for each."""
    return findings.groupBy("artifact_path", "detector_id").agg(F.count(F.lit(1)).alias("lost")).where(F.col("lost") > limit).select("artifact_path", "detector_id", "lost", F.lit("detector_overflow").alias("code"), F.lit("high").alias("severity"))


def without_overflow(findings: DataFrame, limit: int) -> DataFrame:
    """The findings of detectors within their limit."""
    over = detector_overflow(findings, limit).select("artifact_path", "detector_id")
    return findings.join(over, ["artifact_path", "detector_id"], "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by confidence type, category and severity, and in all, in one pass."""
    sets = findings.groupingSets([["confidence_type"], ["category"], ["severity"], []], "confidence_type", "category", "severity")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 3, "confidence_type").when(F.col("g") == 5, "category").when(F.col("g") == 6, "severity").otherwise("total").alias("dimension"),
        F.coalesce("confidence_type", "category", "severity", F.lit("")).alias("value"),
        "n",
    )


def report_order(findings: DataFrame) -> DataFrame:
    """Findings as a report lists them: by path, offset, detector and id. Sorted over ranges, not in one task."""
    return findings.orderBy(F.lower("artifact_path"), F.coalesce("offset", F.lit(-1)), "detector_id", "id")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A rule for each detector, with what its findings say of it."""
    return findings.groupBy("detector_id").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.array_join(F.array_sort(F.collect_set("provenance_class")), ",").alias("provenance_classes"),
        F.array_join(F.array_sort(F.collect_set("confidence_type")), ",").alias("confidence_types"),
        F.count(F.lit(1)).alias("results"),
    )


def editor_diagnostics(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Diagnostics of each artifact, those without findings included."""
    counts = findings.groupBy("artifact_path").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("offset", F.lit(0))).alias("first"))
    return artifacts.select("artifact_path").join(counts, "artifact_path", "left").select("artifact_path", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit(0)).alias("first"))


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Artifacts that came, went or changed while a scan ran."""
    a, b = before.withColumnRenamed("content", "old"), after.withColumnRenamed("content", "new")
    joined = a.join(b, "artifact_path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.withColumn("change", change).where("change is not null").select("artifact_path", "change")


@query(
    "finding_budget",
    f"""
    WITH f AS ({FINDINGS}), r AS (SELECT artifact_path, id, row_number() OVER (ORDER BY lower(artifact_path), artifact_path, emit_ord, id) AS position, count(*) OVER (PARTITION BY artifact_path) AS n, row_number() OVER (PARTITION BY artifact_path ORDER BY emit_ord, id) AS k FROM f)
    SELECT artifact_path, id, position, position - k + n > 500 AS artifact_truncated FROM r WHERE position <= 500
    """,
)
def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_budget(findings_of(spark, sf_dir), 500)


@query(
    "detector_overflow",
    f"WITH f AS ({FINDINGS}) SELECT artifact_path, detector_id, count(*) AS lost, 'detector_overflow' AS code, 'high' AS severity FROM f GROUP BY 1, 2 HAVING count(*) > 6",
)
def q_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector_overflow(findings_of(spark, sf_dir), 6)


@query("kept_findings", f"WITH f AS ({FINDINGS}), c AS (SELECT *, count(*) OVER (PARTITION BY artifact_path, detector_id) AS n FROM f) SELECT id, artifact_path FROM c WHERE n <= 6")
def q_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_overflow(findings_of(spark, sf_dir), 6).select("id", "artifact_path")


@query(
    "summary_grouping_sets",
    f"""
    WITH f AS ({FINDINGS})
    SELECT 'confidence_type' AS dimension, confidence_type AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM f
    """,
)
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(findings_of(spark, sf_dir))


@query("summary_consistency", f"WITH f AS ({FINDINGS}) SELECT dimension, n = (SELECT count(*) FROM f) AS consistent FROM (SELECT 'category' AS dimension, count(category) AS n FROM f UNION ALL SELECT 'severity', count(severity) FROM f UNION ALL SELECT 'confidence_type', count(confidence_type) FROM f)")
def q_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(findings_of(spark, sf_dir))
    sums = s.groupBy("dimension").agg(F.sum("n").alias("n"))
    total = sums.where("dimension = 'total'").select(F.col("n").alias("total"))
    return sums.where("dimension <> 'total'").join(F.broadcast(total)).select("dimension", (F.col("n") == F.col("total")).alias("consistent"))


def positions(ordered: DataFrame) -> DataFrame:
    """Findings of a report with their place in it, numbered from 1 range by range of a global sort."""
    from loupe.functions.staging import staged

    sorted_ = staged(report_order(ordered).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "report")
    sizes = sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # one row for each range of the sort
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_at"))
    return sorted_.withColumn("_in", inside).join(F.broadcast(bases), "_range").withColumn("position", F.col("base") + F.col("_in")).drop("_range", "_at", "_in", "base")


@query("report_order", f'WITH f AS ({FINDINGS}) SELECT id, artifact_path, coalesce("offset", -1) AS at, detector_id, row_number() OVER (ORDER BY lower(artifact_path), coalesce("offset", -1), detector_id, id) AS position FROM f')
def q_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(findings_of(spark, sf_dir)).select("id", "artifact_path", F.coalesce("offset", F.lit(-1)).alias("at"), "detector_id", F.col("position").cast("long").alias("position"))


@query(
    "sarif_rules",
    f"""WITH f AS ({FINDINGS}) SELECT detector_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT provenance_class, ',' ORDER BY provenance_class) AS provenance_classes,
    string_agg(DISTINCT confidence_type, ',' ORDER BY confidence_type) AS confidence_types, count(*) AS results FROM f GROUP BY 1""",
)
def q_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_rules(findings_of(spark, sf_dir))


@query(
    "editor_diagnostics",
    f"""WITH f AS ({FINDINGS}), a AS (SELECT DISTINCT concat('src/F', o_orderkey % 4000, '.txt') AS artifact_path FROM orders)
    SELECT a.artifact_path, count(f.id) AS n, coalesce(min(CASE WHEN f.id IS NOT NULL THEN coalesce(f."offset", 0) END), 0) AS first FROM a LEFT JOIN f USING (artifact_path) GROUP BY 1""",
)
def q_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = bound(spark, sf_dir, "SELECT DISTINCT concat('src/F', o_orderkey % 4000, '.txt') AS artifact_path FROM orders")
    return editor_diagnostics(artifacts, findings_of(spark, sf_dir))


@query(
    "inventory_changes",
    f"""WITH a AS ({BEFORE}), b AS ({AFTER}) SELECT artifact_path, CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b USING (artifact_path) WHERE a.content IS DISTINCT FROM b.content""",
)
def q_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_changes(bound(spark, sf_dir, BEFORE), bound(spark, sf_dir, AFTER))
