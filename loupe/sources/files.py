"""Files, trees and repositories as sources: inventory, type, ignore rules, git output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.joins import bounded, folded_digest
from loupe.plans.fixtures import bound
from loupe.registry import query
from loupe.sources.artifacts import PLANTED, described, planted
from loupe.sources.discovery import MAX_RULES, files  # noqa: F401

# Commits read of a log; types by what a file begins with, then by suffix.
COMMIT_LIMIT = 500
SIGNATURES = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("pdf", "255044462D"), ("audio", "664C6143"), ("audio", "494433"), ("video", "1A45DFA3"), ("ole", "D0CF11E0A1B11AE1"), ("zip", "504B0304"), ("text", "FFFE"), ("text", "FEFF"))
SUFFIXES = {"svg": "svg", "html": "html", "htm": "html", "css": "css", "md": "markdown", "markdown": "markdown", "py": "source_code", "js": "source_code", "ts": "source_code", "java": "source_code", "c": "source_code", "go": "source_code", "rs": "source_code", "txt": "text", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "odt": "odf"}


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes alone; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("artifact_path"), F.col("length").alias("size"))


def artifact_type(path: Column, head: Column) -> Column:
    """By signature first, then by suffix; a zero byte makes binary, what is left is text if it is UTF-8."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_suffix = F.lit(None).cast("string")
    for ext, kind in SUFFIXES.items():
        by_suffix = F.when(suffix == ext, kind).otherwise(by_suffix)
    hexed = F.hex(F.substring(head, 1, 16))
    out = F.lit(None).cast("string")
    for kind, magic in reversed(SIGNATURES):
        out = F.when(hexed.startswith(magic), F.when(F.lit(kind == "zip"), F.coalesce(by_suffix, F.lit("zip"))).otherwise(kind)).otherwise(out)
    rest = F.when(F.instr(head.cast("string"), "\0") > 0, "binary").otherwise(F.coalesce(by_suffix, F.when(F.is_valid_utf8(head.cast("string")), "text").otherwise("unknown")))
    return F.coalesce(out, rest)


def nearest_rule(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ignore rule that decides for a path: of those that match, the deepest scope's last."""
    r = bounded(rules, MAX_RULES, "ignore rules")
    joined = paths.join(r, F.expr("startswith(path, scope) AND (suffix IS NULL OR endswith(path, suffix))"), "left")
    best = joined.groupBy("path").agg(F.max_by("negated", F.struct(F.length("scope").alias("depth"), "position")).alias("negated"), F.count("scope").alias("n"))
    return best.select("path", ((F.col("n") > 0) & ~F.coalesce("negated", F.lit(False))).alias("ignored"))


def parsed_log(raw: DataFrame, limit: int = COMMIT_LIMIT) -> DataFrame:
    """Commits of each log, beside its other columns: records end with U+001E, fields with U+0000; one more than the limit tells a truncated log."""
    keys = [c for c in raw.columns if c != "log"]
    records = raw.select(*keys, F.posexplode(F.filter(F.split("log", "\x1e", -1), lambda s: s != "")).alias("position", "record"))
    parts = F.split("record", "\0", 4)
    return records.where(F.col("position") <= limit).select(*keys, "position", F.get(parts, F.lit(0)).alias("commit_hash"), F.get(parts, F.lit(1)).alias("author"), F.get(parts, F.lit(3)).alias("message"), (F.col("position") == limit).alias("over_limit"))


def inventory_digest(artifacts: DataFrame) -> DataFrame:
    """A digest of all artifacts that doesn't depend on their order."""
    return folded_digest(artifacts.select(F.sha2(F.concat_ws("|", "artifact_path", "sha256"), 256).alias("h")))


@query("artifact_inventory", f"WITH a AS ({PLANTED}) SELECT artifact_path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, strlen(text) <= 8000 AS scanned FROM a")
def q_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(planted(spark, sf_dir)).select("artifact_path", "size", "sha256", (F.col("size") <= 8000).alias("scanned"))


@query("inventory_digest", f"WITH s AS ({PLANTED}), h AS (SELECT sha256(concat_ws('|', artifact_path, sha256(text))) AS h FROM s), a AS (SELECT substr(h, 1, 4) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY substr(h, 1, 4)), b AS (SELECT substr(h, 1, 2) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM a GROUP BY substr(h, 1, 2)) SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest FROM b")
def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_digest(described(planted(spark, sf_dir)))


_NAMED = "SELECT p_partkey, concat('f', p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.PY' WHEN 2 THEN '.bin' WHEN 3 THEN '.css' WHEN 4 THEN '' ELSE '.html' END) AS path, CASE p_partkey % 5 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'ID3 tag' ELSE p_name END AS head FROM part"


@query("artifact_type_identify", f"WITH a AS ({_NAMED}) SELECT path, CASE WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN starts_with(head, 'ID3') THEN 'audio' WHEN p_partkey % 6 = 0 THEN 'markdown' WHEN p_partkey % 6 = 1 THEN 'source_code' WHEN p_partkey % 6 = 3 THEN 'css' WHEN p_partkey % 6 = 5 THEN 'html' ELSE 'text' END AS artifact_type FROM a")
def q_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, _NAMED).select("path", artifact_type(F.col("path"), F.col("head").cast("binary")).alias("artifact_type"))


_IGNORE = "SELECT '' AS scope, '.log' AS suffix, false AS negated, 1 AS position UNION ALL SELECT 'a/', CAST(NULL AS {s}), false, 2 UNION ALL SELECT 'a/b/', '.md', true, 3 UNION ALL SELECT 'a/b/', '.log', false, 4"
_PATHS = "SELECT DISTINCT concat(CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/' ELSE 'a/b/' END, p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.md' ELSE '.c' END) AS path FROM part"


@query("ignore_rules", f"WITH p AS ({_PATHS}), r AS ({_IGNORE.format(s='VARCHAR')}), m AS (SELECT path, arg_max(negated, length(scope) * 100 + position) AS negated, count(scope) AS n FROM p LEFT JOIN r ON starts_with(path, scope) AND (suffix IS NULL OR ends_with(path, suffix)) GROUP BY 1) SELECT path, n > 0 AND NOT coalesce(negated, false) AS ignored FROM m")
def q_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rule(bound(spark, sf_dir, _PATHS), spark.sql(_IGNORE.format(s="STRING")))


#: Every conversation is a commit; 500 successive ids share a repository, so no log grows with the table.
_COMMITS = "SELECT DISTINCT CAST(floor(coalesce(conv_id, -1) / 500) AS BIGINT) AS repository, coalesce(conv_id, -1) AS conv_id FROM conversations"


@query("git_logs_parse", f"WITH c AS ({_COMMITS}), r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY conv_id) - 1 AS position FROM c) SELECT repository, CAST(position AS INT) AS position, concat('h', conv_id) AS commit_hash, 'Ann' AS author, concat('m ', conv_id) AS message, position = {COMMIT_LIMIT} AS over_limit FROM r WHERE position <= {COMMIT_LIMIT}")
def q_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("h"), "conv_id", F.lit("\0Ann\0a@x\0m "), "conv_id", F.lit("\x1e"))
    logs = bound(spark, sf_dir, _COMMITS).groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", one.alias("c")))), lambda x: x["c"]), "").alias("log"))
    return parsed_log(logs)
