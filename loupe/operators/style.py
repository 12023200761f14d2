"""Writing compared with a writer's own past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.plans.fixtures import STYLES_DUCK, STYLES_SPARK, VECTORS_DUCK, VECTORS_SPARK, bound
from loupe.registry import query

# What a baseline needs, and where bands begin.
MIN_DOCUMENTS, MIN_SPAN_DAYS = 8, 30
NOTABLE, MARKED = 2.0, 3.5
FEATURES = ("f1", "f2", "f3", "f4")


def baselines(documents: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Means and deviations of each writer, and why a baseline doesn't suffice. A constant feature deviates by exactly 0."""
    spread = lambda f: F.when((F.max(f) == F.min(f)) | (F.count(f) < 2), F.lit(0.0)).otherwise(F.stddev_samp(f))
    rows = documents.groupBy("writer").agg(F.count(F.lit(1)).alias("documents"), (F.max("day") - F.min("day")).alias("span_days"), *(F.avg(f).alias(f"mean_{f}") for f in features), *(spread(f).alias(f"dev_{f}") for f in features))
    flat = F.greatest(*(F.col(f"dev_{f}") for f in features)) == 0
    reasons = F.array_compact(F.array(F.when(F.col("documents") < MIN_DOCUMENTS, "documents"), F.when(F.col("span_days") < MIN_SPAN_DAYS, "span"), F.when(flat, "no_variability")))
    return rows.withColumn("insufficiency", F.array_join(reasons, ","))


def compared(candidates: DataFrame, bases: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Each document's distance from its writer's baseline, in that writer's own deviations, and its band."""
    joined = candidates.join(bases, "writer")
    z = F.array_compact(F.array(*(F.when(F.col(f"dev_{f}") != 0, (F.col(f) - F.col(f"mean_{f}")) / F.col(f"dev_{f}")) for f in features)))
    total = F.aggregate(F.transform(z, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    sigma = F.when(F.col("insufficiency") == "", F.sqrt(total / F.size(z)))
    band = F.when(sigma.isNull(), "undetermined").when(sigma >= MARKED, "marked").when(sigma >= NOTABLE, "notable").otherwise("within_variation")
    return joined.select("writer", "doc_id", F.round(sigma, 6).alias("sigma"), band.alias("band"))


def vector_baselines(documents: DataFrame) -> DataFrame:
    """The same of ``features`` arrays, a row for each writer and dimension: (writer, dimension, mean, dev, documents, span_days, insufficiency)."""
    whole = documents.groupBy("writer").agg(F.count(F.lit(1)).alias("documents"), (F.max("day") - F.min("day")).alias("span_days"))
    spread = F.when((F.max("x") == F.min("x")) | (F.count("x") < 2), F.lit(0.0)).otherwise(F.stddev_samp("x"))
    each = documents.select("writer", F.posexplode("features").alias("dimension", "x")).groupBy("writer", "dimension").agg(F.avg("x").alias("mean"), spread.alias("dev"))
    widest = each.groupBy("writer").agg(F.max("dev").alias("widest"))
    reasons = F.array_compact(F.array(F.when(F.col("documents") < MIN_DOCUMENTS, "documents"), F.when(F.col("span_days") < MIN_SPAN_DAYS, "span"), F.when(F.col("widest") == 0, "no_variability")))
    return each.join(whole.join(widest, "writer"), "writer").select("writer", "dimension", "mean", "dev", "documents", "span_days", F.array_join(reasons, ",").alias("insufficiency"))


def vectors_compared(candidates: DataFrame, bases: DataFrame) -> DataFrame:
    """``compared`` over every dimension of the ``features`` array."""
    held = bases.groupBy("writer").agg(F.first("insufficiency").alias("insufficiency"), F.array_sort(F.collect_list(F.struct("dimension", "mean", "dev"))).alias("base"))
    z = F.array_compact(F.zip_with("features", "base", lambda x, b: F.when(b["dev"] != 0, (x - b["mean"]) / b["dev"])))
    total = F.aggregate(F.transform(z, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    sigma = F.when((F.col("insufficiency") == "") & (F.size(z) > 0), F.sqrt(total / F.size(z)))
    band = F.when(F.col("sigma").isNull(), "undetermined").when(F.col("sigma") >= MARKED, "marked").when(F.col("sigma") >= NOTABLE, "notable").otherwise("within_variation")
    return candidates.join(held, "writer").select("writer", "doc_id", sigma.alias("sigma")).select("writer", "doc_id", F.round("sigma", 6).alias("sigma"), band.alias("band"))


def feature_problems(vectors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Vectors (map of feature to value) that lack a feature or hold another; nothing is filled in."""
    wanted = F.array(*map(F.lit, names))
    missing, extra = F.array_except(wanted, F.map_keys("features")), F.array_except(F.map_keys("features"), wanted)
    return vectors.select("doc_id", F.array_join(F.array_sort(missing), ",").alias("missing"), F.array_join(F.array_sort(extra), ",").alias("extra")).where("missing <> '' OR extra <> ''")


_BASE = f"""v AS ({STYLES_DUCK}), b AS (SELECT writer, count(*) AS documents, max(day) - min(day) AS span_days, {", ".join(f"avg({f}) AS mean_{f}, CASE WHEN max({f}) = min({f}) OR count({f}) < 2 THEN 0.0 ELSE stddev_samp({f}) END AS dev_{f}" for f in FEATURES)} FROM v WHERE NOT candidate GROUP BY 1),
  i AS (SELECT *, concat_ws(',', CASE WHEN documents < 8 THEN 'documents' END, CASE WHEN span_days < 30 THEN 'span' END, CASE WHEN greatest({", ".join(f"dev_{f}" for f in FEATURES)}) = 0 THEN 'no_variability' END) AS insufficiency FROM b)"""
_SIGMA = "CASE WHEN insufficiency = '' THEN sqrt(list_sum([x * x for x in [" + ", ".join(f"CASE WHEN dev_{f} <> 0 THEN ({f} - mean_{f}) / dev_{f} END" for f in FEATURES) + "] if x IS NOT NULL]) / len([x for x in [" + ", ".join(f"CASE WHEN dev_{f} <> 0 THEN 1 END" for f in FEATURES) + "] if x IS NOT NULL])) END"


@query("style_baseline", f"WITH {_BASE} SELECT writer, documents, span_days, {', '.join(f'round(mean_{f}, 6) AS mean_{f}, round(dev_{f}, 6) AS dev_{f}' for f in FEATURES)}, insufficiency FROM i")
def q_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baselines(bound(spark, sf_dir, STYLES_SPARK).where("NOT candidate"))
    return rows.select("writer", "documents", "span_days", *(F.round(f"{p}_{f}", 6).alias(f"{p}_{f}") for f in FEATURES for p in ("mean", "dev")), "insufficiency")


@query(
    "style_comparison",
    f"WITH {_BASE}, s AS (SELECT v.writer, doc_id, {_SIGMA} AS sigma FROM v JOIN i USING (writer) WHERE candidate) SELECT writer, doc_id, round(sigma, 6) AS sigma, CASE WHEN sigma IS NULL THEN 'undetermined' WHEN sigma >= 3.5 THEN 'marked' WHEN sigma >= 2 THEN 'notable' ELSE 'within_variation' END AS band FROM s",
)
def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bound(spark, sf_dir, STYLES_SPARK)
    return compared(v.where("candidate"), baselines(v.where("NOT candidate")))


_ALL = f"""v AS ({VECTORS_DUCK}), e AS (SELECT writer, doc_id, candidate, unnest(features) AS x, unnest(range(0, len(features))) AS dimension FROM v),
  w AS (SELECT writer, count(*) AS documents, max(day) - min(day) AS span_days FROM v WHERE NOT candidate GROUP BY 1),
  d AS (SELECT writer, dimension, avg(x) AS mean, CASE WHEN max(x) = min(x) OR count(x) < 2 THEN 0.0 ELSE stddev_samp(x) END AS dev FROM e WHERE NOT candidate GROUP BY 1, 2),
  b AS (SELECT d.*, documents, span_days, concat_ws(',', CASE WHEN documents < 8 THEN 'documents' END, CASE WHEN span_days < 30 THEN 'span' END, CASE WHEN max(dev) OVER (PARTITION BY d.writer) = 0 THEN 'no_variability' END) AS insufficiency FROM d JOIN w USING (writer))"""


@query("style_baseline_all", f"WITH {_ALL} SELECT writer, CAST(dimension AS INT) AS dimension, round(mean, 6) AS mean, round(dev, 6) AS dev, documents, span_days, insufficiency FROM b")
def q_baseline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_baselines(bound(spark, sf_dir, VECTORS_SPARK).where("NOT candidate"))
    return rows.withColumns({"mean": F.round("mean", 6), "dev": F.round("dev", 6)})


@query(
    "style_comparison_all",
    f"WITH {_ALL}, s AS (SELECT writer, doc_id, CASE WHEN max(insufficiency) = '' THEN sqrt(sum(((x - mean) / dev) ** 2) FILTER (WHERE dev <> 0) / count(x) FILTER (WHERE dev <> 0)) END AS sigma FROM e JOIN b USING (writer, dimension) WHERE candidate GROUP BY 1, 2) SELECT writer, doc_id, round(sigma, 6) AS sigma, CASE WHEN sigma IS NULL THEN 'undetermined' WHEN sigma >= 3.5 THEN 'marked' WHEN sigma >= 2 THEN 'notable' ELSE 'within_variation' END AS band FROM s",
)
def q_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bound(spark, sf_dir, VECTORS_SPARK)
    return vectors_compared(v.where("candidate"), vector_baselines(v.where("NOT candidate")))


@query("feature_contract", "SELECT vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN 'b' ELSE '' END AS missing, CASE WHEN vec_id % 5 = 0 THEN 'c' ELSE '' END AS extra FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0")
def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_compact(F.array(F.lit("a"), F.when(F.col("vec_id") % 3 != 0, "b"), F.when(F.col("vec_id") % 5 == 0, "c")))
    rows = bound(spark, sf_dir, "SELECT vec_id FROM embeddings").select(F.col("vec_id").alias("doc_id"), F.map_from_arrays(names, F.transform(names, lambda x: F.lit(1.0))).alias("features"))
    return feature_problems(rows, ("a", "b"))
