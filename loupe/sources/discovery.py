"""Discovery: what each file is by its bytes, which paths are ignored, in which order, and what couldn't be read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loupe.functions.joins import bounded
from loupe.plans.fixtures import bound
from loupe.registry import query

# Signatures, brands, parts and suffixes by which a file's type is told, and what a scan never reads.
AUDIO_BRANDS = (b"M4A ", b"M4B ", b"M4P ", b"F4A ", b"F4B ")
OOXML_PARTS = ((b"word/document.xml", "docx"), (b"ppt/presentation.xml", "pptx"), (b"xl/workbook.xml", "xlsx"))
OOXML_SUFFIXES = {"docx": "docx", "docm": "docx", "dotx": "docx", "pptx": "pptx", "pptm": "pptx", "potx": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx"}
ODF_SUFFIXES = frozenset(("odt", "ods", "odp", "odg", "odf", "ott", "ots", "otp"))
MARKDOWN = frozenset(("md", "markdown", "mdx", "rst"))
CODE = frozenset(("c", "cc", "cpp", "cs", "cu", "go", "h", "hpp", "java", "js", "jsx", "kt", "lua", "php", "py", "r", "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx", "v", "vhd", "vhdl", "yaml", "yml", "toml", "json"))
PLAIN = frozenset(("txt", "csv", "log", "ini", "cfg", "conf"))
BASE_IGNORE = (".git/", "*.pyc", "__pycache__/")
MAX_RULES, MAX_FILES, MAX_FILE = 10_000, 100_000, 25 << 20


def _mp3_frame(b: bytes) -> bool:
    """Whether the bytes begin with a header that an MPEG audio frame may have."""
    return len(b) > 3 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0 and b[1] >> 3 & 3 != 1 and b[1] >> 1 & 3 != 0 and b[2] >> 4 not in (0, 15) and b[2] >> 2 & 3 != 3


def _named_type(suffix: str) -> str | None:
    return "markdown" if suffix in MARKDOWN else "source_code" if suffix in CODE else "text" if suffix in PLAIN else None


def identified(path: str, data: bytes) -> str:
    """The type of a file: by its signature first, then by its text, then by its suffix."""
    suffix = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].casefold() if "." in path.rsplit("/", 1)[-1] else ""
    head = data[:8192]
    for magic, kind in ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"%PDF-", "pdf"), (b"fLaC", "audio"), (b"ID3", "audio"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "legacy_office")):
        if head.startswith(magic):
            return kind
    if head[:4] in (b"RIFF", b"RIFX") and head[8:12] == b"WAVE" or suffix in ("mp2", "mp3", "mpa") and _mp3_frame(head):
        return "audio"
    if len(head) >= 12 and head[4:8] == b"ftyp":
        return "audio" if head[8:12] in AUDIO_BRANDS or suffix in ("m4a", "m4b", "m4p") else "video"
    if head.startswith(b"\x1aE\xdf\xa3"):
        return "audio" if suffix in ("weba", "mka") else "video"
    if head.startswith((b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")):
        at = head.find(b"mimetype")
        if at >= 0 and b"application/vnd.oasis.opendocument." in head[at : at + 256]:
            return "odf"
        if suffix in OOXML_SUFFIXES:
            return OOXML_SUFFIXES[suffix]
        if b"[Content_Types].xml" in data:
            for part, kind in OOXML_PARTS:
                if part in data:
                    return kind
        if suffix in ODF_SUFFIXES:
            return "odf"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")) and (kind := _named_type(suffix)):
        return kind
    if b"\0" in head:
        return "binary"
    text = head.decode("utf-8", "ignore").lstrip("﻿\t\r\n ")[:1024].casefold()
    if suffix == "svg" or re.match(r"(?:<\?xml[^>]*>\s*)?<svg(?:\s|>)", text):
        return "svg"
    if text.startswith(("<!doctype html", "<html")) or suffix in ("html", "htm", "xhtml"):
        return "html"
    if suffix == "css":
        return "css"
    if kind := _named_type(suffix):
        return kind
    sample = head[:4096]
    try:
        sample.decode()
        return "text"
    except UnicodeDecodeError:
        return "text" if sum(x < 9 or 13 < x < 32 for x in sample) < 0.02 * len(sample) else "unknown"


def typed(files: DataFrame) -> DataFrame:
    """Files (artifact_path, content) with their type; what is too large to be read is told by its suffix alone."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kinds = [identified(p, c or b"") for p, c in zip(batch.column("artifact_path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string())], names=[*batch.schema.names, "artifact_type"])

    return files.mapInArrow(made, files.select("*", F.lit("").alias("artifact_type")).schema)


def pattern_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regex over a path below the rule's folder, negated, folders only) of a line of an ignore file; None for no rule."""
    line = pattern.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line.removeprefix("!")
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i, line = "", 0, line.removeprefix("/")
    while i < len(line):
        rest = line[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**":
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (m := re.match(r"\[(!?)(\]?[^\]]*)\]", rest)):
            out, i = out + "[" + ("^" if m[1] else "") + re.sub(r"([\[&^\\])", r"\\\1", m[2]) + "]", i + m.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, folders


def ignore_rules(files: DataFrame) -> DataFrame:
    """(scope, regex, negated, folders, position) of the lines of ignore files (scope, text); the base rules stand first."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for scope, text in zip(batch.column("scope").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = [*(BASE_IGNORE if scope == "" else ()), *(text or "").splitlines()]
                rows += [(scope, *rule, i) for i, line in enumerate(lines) if (rule := pattern_regex(line))]
            types = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32())
            names = ["scope", "regex", "negated", "folders", "position"]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return files.select("scope", "text").mapInArrow(made, "scope string, regex string, negated boolean, folders boolean, position int")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored): whether the nearest rule ignores a path or a folder above it.

    Of the rules that match, the deepest folder's last one decides; in a folder that is ignored nothing is looked at.
    """
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), (i < F.size(parts)).alias("folder")))
    steps = paths.select("path", F.explode(levels).alias("s")).select("path", "s.prefix", "s.folder")
    r = bounded(rules, MAX_RULES, "ignore rules")
    below = F.substr(F.col("prefix"), F.length("scope") + 1)
    met = steps.join(r, F.startswith("prefix", F.col("scope")) & (F.col("folder") | ~F.col("folders")) & F.rlike(below, F.col("regex")) & (F.length("prefix") > F.length("scope")))
    told = met.groupBy("path", "prefix").agg(F.max_by("negated", F.struct(F.length("scope"), "position")).alias("negated"))
    out = told.groupBy("path").agg(F.bool_or(~F.col("negated")).alias("ignored"))
    return paths.select("path").join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def walk_key(path: Column) -> Column:
    """What sorts paths as a walk meets them: a folder's files before its folders, both by name whatever their case."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), F.lower(p), F.lit("\x01"), p)), "\x02")


def discovered(paths: DataFrame, rules: DataFrame, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """The paths that a scan reads, with their place in the walk, and a diagnostic if there are more than it may read.

    Only the first ``max_files`` paths are sorted into one order.
    """
    kept = paths.join(ignored(paths, rules).where("not ignored").select("path"), "path", "left_semi").withColumn("_key", walk_key(F.col("path")))
    first = kept.orderBy("_key").limit(max_files + 1)
    placed = first.withColumn("position", F.row_number().over(Window.orderBy("_key"))).drop("_key")
    cut = placed.where(F.col("position") > max_files).select(F.lit("discovery_truncated").alias("code"), F.lit(f"there are more than {max_files} files").alias("message"), F.lit("high").alias("severity"))
    return placed.where(F.col("position") <= max_files), cut


def files(spark: SparkSession, path: str, limit_bytes: int = MAX_FILE) -> DataFrame:
    """All files below a folder (artifact_path, size, too_large, content), as Spark's binary source reads them.

    The contents of files over the limit aren't kept; the files are, and ``oversize`` tells of them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > limit_bytes
    return found.select(F.col("path").alias("artifact_path"), F.col("length").alias("size"), large.alias("too_large"), F.when(~large, F.col("content")).alias("content"))


def oversize(found: DataFrame) -> DataFrame:
    """A diagnostic for each file that was too large to be read."""
    return found.where("too_large").select("artifact_path", F.lit("artifact_too_large").alias("code"), F.concat(F.col("size").cast("string"), F.lit(" bytes")).alias("message"), F.lit("high").alias("severity"))


def tracked_paths(raw: DataFrame) -> DataFrame:
    """Tracked paths (repository, position, path) of raw listings whose names end with U+0000 each."""
    return raw.select("repository", F.posexplode(F.filter(F.split("listing", "\0", -1), lambda p: p != "")).alias("position", "path"))


_TREE = """SELECT concat(CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/Build/' WHEN 3 THEN 'src/build/out/' ELSE '.git/objects/' END, CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'f' END, p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.md' WHEN 2 THEN '.pyc' ELSE '.c' END) AS path FROM part"""
_IGNORE = (("", "*.log\n!keep/\n# note\n"), ("src/", "/build/\n*.md\nf1?.c\n"), ("src/Build/", "!*.md\n!*7.md\n*[13].md\n"))
_GONE = """(starts_with(path, '.git/') OR ends_with(path, '.pyc') OR ends_with(path, '.log') OR starts_with(path, 'src/build/') OR (starts_with(path, 'src/') AND regexp_matches(path, '/f1.\\.c$')) OR (starts_with(path, 'src/') AND ends_with(path, '.md') AND (NOT starts_with(path, 'src/Build/') OR regexp_matches(path, '[13]\\.md$'))))"""


def _rules(spark: SparkSession) -> DataFrame:
    return ignore_rules(spark.createDataFrame(_IGNORE, "scope string, text string"))


@query("ignored_paths", f"WITH p AS ({_TREE}) SELECT path, {_GONE} AS ignored FROM p")
def q_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignored(bound(spark, sf_dir, _TREE), _rules(spark))


@query(
    "discovered_paths",
    f"""WITH p AS ({_TREE}), k AS (SELECT path, array_to_string(list_transform(string_split(path, '/'), lambda x, i: concat(CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END, lower(x), chr(1), x)), chr(2)) AS key FROM p WHERE NOT {_GONE}), r AS (SELECT path, row_number() OVER (ORDER BY key) AS position FROM k)
    SELECT path, CAST(position AS INT) AS position FROM r WHERE position <= 60""",
)
def q_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovered(bound(spark, sf_dir, _TREE), _rules(spark), 60)[0]


#: Files whose heads and names disagree.
_HEADS = """SELECT p_partkey, concat('d/f', p_partkey, CASE p_partkey % 9 WHEN 0 THEN '.md' WHEN 1 THEN '.PY' WHEN 2 THEN '.bin' WHEN 3 THEN '.css' WHEN 4 THEN '' WHEN 5 THEN '.html' WHEN 6 THEN '.mp3' WHEN 7 THEN '.m4a' ELSE '.svg' END) AS artifact_path, CASE p_partkey % 11 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'ID3 tag' WHEN 2 THEN 'RIFF0000WAVEfmt ' WHEN 3 THEN '0000ftypM4A 0000'
  WHEN 4 THEN '0000ftypisom0000' WHEN 5 THEN '<!DOCTYPE html><p>' WHEN 6 THEN concat('a', chr(0), 'b') WHEN 7 THEN '<?xml version="1.0"?> <svg >' ELSE p_name END AS head FROM part"""


@query(
    "identified_types",
    f"""WITH h AS ({_HEADS}) SELECT artifact_path, CASE p_partkey % 11 WHEN 0 THEN 'pdf' WHEN 1 THEN 'audio' WHEN 2 THEN 'audio' WHEN 3 THEN 'audio' WHEN 4 THEN CASE WHEN p_partkey % 9 = 7 THEN 'audio' ELSE 'video' END WHEN 6 THEN 'binary' WHEN 7 THEN 'svg'
      ELSE CASE WHEN p_partkey % 9 = 8 THEN 'svg' WHEN p_partkey % 11 = 5 OR p_partkey % 9 = 5 THEN 'html' WHEN p_partkey % 9 = 3 THEN 'css' WHEN p_partkey % 9 = 0 THEN 'markdown' WHEN p_partkey % 9 = 1 THEN 'source_code' ELSE 'text' END END AS artifact_type FROM h""",
)
def q_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = bound(spark, sf_dir, _HEADS).select("artifact_path", F.col("head").cast("binary").alias("content"))
    return typed(heads).select("artifact_path", "artifact_type")


@query("made_types", "SELECT concat('made/', c_custkey) AS artifact_path, CASE c_custkey % 12 WHEN 0 THEN 'docx' WHEN 1 THEN 'unknown' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'odf' WHEN 4 THEN 'pdf' WHEN 5 THEN 'pdf' WHEN 6 THEN 'png' WHEN 7 THEN 'jpeg' WHEN 8 THEN 'audio' WHEN 9 THEN 'audio' WHEN 10 THEN 'audio' ELSE 'text' END AS artifact_type FROM customer WHERE c_custkey % 12 NOT IN (1, 2)")
def q_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of made files whose names tell nothing; packages without a list of content types stay out, and a comment before its root hides an SVG."""
    from loupe.plans.made import made_files

    bare = made_files(spark, sf_dir).where("artifact_type NOT IN ('pptx', 'xlsx')").select(F.regexp_replace("artifact_path", r"\.\w+$", "").alias("artifact_path"), "content")
    return typed(bare).select("artifact_path", "artifact_type")


@query("tracked_paths", "WITH t AS (SELECT s_nationkey AS repository, s_name AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position FROM supplier) SELECT repository, CAST(position AS INT) AS position, path FROM t")
def q_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bound(spark, sf_dir, "SELECT s_nationkey, s_suppkey, s_name FROM supplier").groupBy(F.col("s_nationkey").alias("repository"))
    return tracked_paths(raw.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(x["s_name"], F.lit("\0"))), "").alias("listing")))
