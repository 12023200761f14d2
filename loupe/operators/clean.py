"""Cleaning of text: what is removed, which spans may be, and whether the rest is untouched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loupe.operators.detect_text import REMOVABLE, RULES, TEXT_CONTEXT, attribution_findings, unicode_findings
from loupe.plans.fixtures import bound
from loupe.registry import query
from loupe.sources.artifacts import PLANTED, planted

_GONE = "".join(map(chr, REMOVABLE))


def _only_attribution(line: Column) -> Column:
    """Whether a line holds an attribution and nothing else that is a word."""
    rules = [f"(?i:{p})" for _, _, _, contexts, p in RULES if TEXT_CONTEXT in contexts]
    return reduce(lambda a, b: a | b, (line.rlike(p) & ~F.regexp_replace(line, p, "").rlike(r"[\p{L}\p{N}]") for p in rules))


def cleaned(artifacts: DataFrame) -> DataFrame:
    """Text without removable characters and attribution lines, with the digests of both."""
    bare = F.translate("text", _GONE, "")
    # most texts have no line to remove; theirs aren't taken apart
    hint = bare.rlike(r"(?i)co-authored-by|generated|written|created|https?://")
    lines = F.array_join(F.filter(F.split(bare, "\n", -1), lambda s: ~_only_attribution(s)), "\n")
    return artifacts.withColumn("clean", F.when(hint, lines).otherwise(bare)).select("artifact_path", "clean", F.sha2("text", 256).alias("before"), F.sha2("clean", 256).alias("after"))


def span_problems(spans: DataFrame) -> DataFrame:
    """Spans in order, the widest first: kept, absorbed by one before, or in conflict with it."""
    w = Window.partitionBy("artifact_path").orderBy("start", F.desc("end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    state = F.when(reach.isNull() | (F.col("start") >= reach), "kept").when(F.col("end") <= reach, "absorbed").otherwise("conflict")
    return spans.select("artifact_path", "id", state.alias("state"))


def rescan(artifacts: DataFrame) -> DataFrame:
    """What is still found after cleaning, of what cleaning is to remove."""
    after = cleaned(artifacts).select("artifact_path", F.col("clean").alias("text"))
    left = unicode_findings(after).where("removable").select("artifact_path")
    return left.unionByName(attribution_findings(after).where("standalone").select("artifact_path")).groupBy("artifact_path").agg(F.count(F.lit(1)).alias("left_over"))


_RULES_DUCK = " OR ".join(f"(regexp_matches(s, '(?i:{p.replace(chr(39), chr(39) * 2)})') AND NOT regexp_matches(regexp_replace(s, '(?i:{p.replace(chr(39), chr(39) * 2)})', '', 'g'), '[\\p{{L}}\\p{{N}}]'))" for _, _, _, c, p in RULES if TEXT_CONTEXT in c)


@query("clean_text", f"WITH a AS ({PLANTED}), c AS (SELECT artifact_path, text, array_to_string([s for s in string_split(replace(replace(text, chr(8203), ''), chr(8288), ''), chr(10)) if NOT ({_RULES_DUCK})], chr(10)) AS clean FROM a) SELECT artifact_path, clean, sha256(text) AS before, sha256(clean) AS after FROM c")
def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(planted(spark, sf_dir))


@query("clean_rescan", "SELECT 'x' AS artifact_path, 0::BIGINT AS left_over WHERE false")
def q_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan(planted(spark, sf_dir))


_SPANS = 'SELECT concat(\'f\', l_orderkey % 500) AS artifact_path, concat(l_orderkey, \'-\', l_linenumber, \'-\', l_partkey) AS id, l_partkey * 10 AS start, l_partkey * 10 + 4 + l_suppkey % 60 AS {q}end{q} FROM lineitem'


@query(
    "span_overlap",
    f"""WITH s AS ({_SPANS.format(q='"')}), r AS (SELECT *, max("end") OVER (PARTITION BY artifact_path ORDER BY start, "end" DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT artifact_path, id, CASE WHEN reach IS NULL OR start >= reach THEN 'kept' WHEN "end" <= reach THEN 'absorbed' ELSE 'conflict' END AS state FROM r""",
)
def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_problems(bound(spark, sf_dir, _SPANS.format(q="`")))
