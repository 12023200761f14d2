"""The scan cache: hits, eviction and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loupe.plans.fixtures import bound
from loupe.registry import query

KEY = ("format", "package", "schema", "content_sha256", "artifact_path", "artifact_type", "detectors", "options_digest")


def cache_key(requests: DataFrame) -> DataFrame:
    """The key of each request: a digest of everything that a result depends on."""
    return requests.withColumn("key", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in KEY)), 256))


def cache_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Which requests a cache answers."""
    found = entries.select("key").distinct().withColumn("hit", F.lit(True))
    return cache_key(requests).join(found, "key", "left").select("artifact_path", F.coalesce("hit", F.lit(False)).alias("hit"))


#: Bytes of a stored result above which it isn't kept.
MAX_ENTRY = 4 << 20


def _ranked(entries: DataFrame) -> DataFrame:
    """Entries with their rank in the order of eviction: unreachable first, then untouched, old, and by key."""
    flag = lambda c: F.when(F.col(c), "1").otherwise("0") if c in entries.columns else F.lit("0")
    head = F.concat_ws("/", flag("reachable"), flag("touched"), F.lpad(F.col("generation").cast("string"), 8, "0"))
    return entries.withColumn("rank", F.concat_ws("/", head, "key")).withColumn("bucket", F.concat_ws("/", head, F.substr("key", F.lit(1), F.lit(2))))


def eviction(entries: DataFrame, budget: int) -> DataFrame:
    """Entries to evict, the least useful first, until what is left fits.

    Sizes are summed by ranges of the order first, so the running total over all
    entries is one over the ranges and one within each.
    """
    ordered = _ranked(entries)
    sums = ordered.groupBy("bucket").agg(F.sum("size_bytes").alias("s"))
    total = entries.agg(F.sum("size_bytes").alias("total"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("base") + F.coalesce(F.sum("size_bytes").over(inside), F.lit(0))
    return ordered.join(sums, "bucket").join(F.broadcast(total)).withColumn("gone", gone).where(F.col("total") - F.col("gone") > budget).select("key", "size_bytes")


def pruned(entries: DataFrame, unreachable_only: bool = False, older_than: int | None = None, to_fit: int | None = None) -> DataFrame:
    """Entries that explicit rules remove (key, size_bytes). No rule removes nothing; the size counts after the others."""
    chosen = F.lit(False)
    if unreachable_only:
        chosen = chosen | ~F.col("reachable")
    if older_than is not None:
        chosen = chosen | (F.col("generation") < older_than)
    marked = entries.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    out = marked.where("chosen").select("key", "size_bytes")
    return out if to_fit is None else out.unionByName(eviction(marked.where("not chosen").drop("chosen"), to_fit))


def inspected(entries: DataFrame) -> DataFrame:
    """What a cache holds, by generation."""
    return entries.groupBy("generation").agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("bytes"), F.count_if(~F.col("reachable")).alias("unreachable"))


def stored(results: DataFrame, path: str) -> None:
    """Append results (key, payload, generation) that are complete and small enough, by the first digits of their keys."""
    kept = results.where(F.coalesce(F.col("complete"), F.lit(False)) & (F.octet_length("payload") <= MAX_ENTRY))
    kept.drop("complete").withColumn("shard", F.substr("key", F.lit(1), F.lit(2))).write.mode("append").partitionBy("shard").parquet(path)


def statistics(lookups: DataFrame) -> DataFrame:
    """Lookups and hit rate; no lookups have rate 0."""
    counts = lookups.agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"))
    return counts.select("lookups", "hits", F.when(F.col("lookups") > 0, F.round(F.col("hits") / F.col("lookups"), 9)).otherwise(0.0).alias("hit_rate"))


_REQUESTS = "SELECT 1 AS format, '1.0' AS package, '0.1' AS schema, concat('sha', l_partkey) AS content_sha256, concat('src/F', l_orderkey, '-', l_linenumber, '-', l_partkey) AS artifact_path, 'text' AS artifact_type, 'a,b' AS detectors, CAST(l_suppkey % 3 AS {s}) AS options_digest, l_orderkey AS o FROM lineitem"
_ENTRIES = "SELECT DISTINCT concat('k', l_partkey % 251, '-', l_orderkey) AS key, CAST(floor(max(l_extendedprice)) AS BIGINT) AS size_bytes, CAST(max(l_suppkey) % 9 AS INT) AS generation, max(l_linenumber) % 5 <> 0 AS reachable, max(l_partkey) % 3 = 0 AS touched FROM lineitem GROUP BY 1"
_DUCK_KEY = "sha256(concat_ws('|', format, package, schema, content_sha256, artifact_path, artifact_type, detectors, options_digest))"


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = bound(spark, sf_dir, _REQUESTS.format(s="STRING"))
    return cache_lookup(requests, cache_key(requests.where("o % 4 = 0").withColumn("options_digest", F.when(F.col("o") % 3 == 0, "x").otherwise(F.col("options_digest")))))


_LOOKUP = f"r AS ({_REQUESTS.format(s='VARCHAR')}), e AS (SELECT DISTINCT {_DUCK_KEY} AS key FROM (SELECT * REPLACE (CASE WHEN o % 3 = 0 THEN 'x' ELSE options_digest END AS options_digest) FROM r WHERE o % 4 = 0)), l AS (SELECT artifact_path, {_DUCK_KEY} IN (SELECT key FROM e) AS hit FROM r)"


@query("cache_hits", f"WITH {_LOOKUP} SELECT * FROM l")
def q_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir)


@query("cache_statistics", f"WITH {_LOOKUP} SELECT count(*) AS lookups, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 9) AS hit_rate FROM l")
def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(_lookup(spark, sf_dir))


@query(
    "cache_eviction",
    f"""WITH e AS ({_ENTRIES}), r AS (SELECT *, concat_ws('/', CASE WHEN reachable THEN '1' ELSE '0' END, CASE WHEN touched THEN '1' ELSE '0' END, lpad(CAST(generation AS VARCHAR), 8, '0'), key) AS rank FROM e),
    s AS (SELECT key, size_bytes, coalesce(sum(size_bytes) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(size_bytes) OVER () AS total FROM r) SELECT key, size_bytes FROM s WHERE total - gone > 1000000""",
)
def q_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eviction(bound(spark, sf_dir, _ENTRIES), 1_000_000)


@query(
    "cache_prune",
    f"""WITH e AS ({_ENTRIES}), c AS (SELECT *, NOT reachable OR generation < 2 AS chosen FROM e), r AS (SELECT *, concat_ws('/', CASE WHEN reachable THEN '1' ELSE '0' END, CASE WHEN touched THEN '1' ELSE '0' END, lpad(CAST(generation AS VARCHAR), 8, '0'), key) AS rank FROM c WHERE NOT chosen),
    s AS (SELECT key, size_bytes, coalesce(sum(size_bytes) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(size_bytes) OVER () AS total FROM r) SELECT key, size_bytes FROM c WHERE chosen UNION ALL SELECT key, size_bytes FROM s WHERE total - gone > 1000000""",
)
def q_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned(bound(spark, sf_dir, _ENTRIES), True, 2, 1_000_000)


@query("cache_inspect", f"WITH e AS ({_ENTRIES}) SELECT generation, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE NOT reachable) AS unreachable FROM e GROUP BY 1")
def q_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspected(bound(spark, sf_dir, _ENTRIES))
