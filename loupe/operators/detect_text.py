"""Detectors of traces in text: unusual Unicode, white space, explicit attribution."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.passes import parsed
from loupe.registry import query
from loupe.sources.artifacts import PLANTED, planted, table

# What the classification must report, and the attribution rules.
INVISIBLE_CLASSES = ("invisible", "language_dependent", "typographic")
BIDI_CONTROLS = (0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
NAMED = {0x00A0: ("typographic", "low"), 0x00AD: ("language_dependent", "info"), 0x200B: ("invisible", "low"), 0x200C: ("language_dependent", "info"), 0x200D: ("language_dependent", "info"), 0x202F: ("typographic", "low"), 0x2060: ("invisible", "low"), 0xFEFF: ("invisible", "low")}
REMOVABLE = (0x200B, 0x2060)
TEXT_CONTEXT, COMMENT, HTML_COMMENT, GIT_COMMIT, METADATA = "text", "comment", "html_comment", "git_commit", "metadata"
EVERYWHERE = (TEXT_CONTEXT, COMMENT, HTML_COMMENT, GIT_COMMIT, METADATA)
WRITTEN = (TEXT_CONTEXT, COMMENT, GIT_COMMIT)
#: rule, provider, confidence, contexts, pattern (case is ignored)
RULES = (
    ("openai.coauthor", "openai", 1.0, WRITTEN, r"Co-Authored-By:[ \t]*(?:ChatGPT|OpenAI Codex|Codex)(?:[ \t][^<\r\n]*)?<[^>\r\n]{1,320}>"),
    ("openai.generated-with", "openai", 0.99, EVERYWHERE, r"\b(?:generated|written|created)\s+(?:by|with)\s+(?:OpenAI(?:\s+Codex)?|ChatGPT|Codex)\b"),
    ("openai.chat-url", "openai", 0.98, WRITTEN, r"https?://(?:chatgpt\.com|chat\.openai\.com)/(?:share|c)/[A-Za-z0-9_-]+"),
    ("anthropic.coauthor-claude", "anthropic", 1.0, WRITTEN, r"Co-Authored-By:[ \t]*Claude(?:[ \t][^<\r\n]*)?<[^>\r\n]{1,320}>"),
    ("anthropic.generated-with-claude", "anthropic", 0.99, EVERYWHERE, r"\b(?:generated|written|created)\s+(?:by|with)\s+(?:Anthropic['’]s\s+)?Claude\b"),
    ("anthropic.session-url", "anthropic", 0.98, WRITTEN, r"https?://(?:www\.)?claude\.ai/(?:chat|share)/[A-Za-z0-9_-]+"),
    ("google.generated-with-gemini", "google", 0.99, EVERYWHERE, r"\b(?:generated|written|created)\s+(?:by|with)\s+(?:Google\s+)?Gemini\b"),
    ("google.gemini-share-url", "google", 0.98, WRITTEN, r"https?://g\.co/gemini/share/[A-Za-z0-9_-]+"),
    ("generic.explicit-ai-generated", "generic", 0.96, EVERYWHERE, r"\b(?:this\s+(?:file|document|code|content)\s+(?:was|is)\s+AI[- ]generated|AI[- ]generated\s+(?:by|with)\s+(?:an?\s+)?AI\s+(?:assistant|tool|system)|generated\s+(?:by|with)\s+an?\s+AI\s+(?:assistant|tool|system))\b"),
)
WHITESPACE = (("long-run", r"(?<=\S)[ \t]{8,}(?=\S)"), ("blank-lines", r"(?:\r?\n[ \t]*){4,}"))
PROTECTED_MARKERS = ("c2pa", "content credentials", "application/c2pa", "c2pa_manifest")

#: A text that no rule can match holds none of these.
_HINT = r"(?i)co-authored-by|generated|written|created|https?://"
_SUSPICIOUS = r"[\p{Cc}\p{Cf}\p{Z}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}&&[^ \t\n\r]]"


def _unicode_rows(text: str | None) -> Iterator[tuple]:
    from loupe.detection.model import Artifact
    from loupe.detection.text import classified, unusual

    a = Artifact("", "text", text or "", None)
    for m in unusual(a.string):
        kind, severity = classified(m[0], m.start())
        place = a.place(m.start())
        yield "invisible_unicode" if kind in INVISIBLE_CLASSES else "suspicious_unicode", severity, kind, f"U+{ord(m[0]):04X}", m.start(), place["line"], place["column"], ord(m[0]) in REMOVABLE


def unicode_findings(artifacts: DataFrame) -> DataFrame:
    """Each unusual character, classified in order of precedence.

    Texts without one are dropped by a scan before any is taken apart; the others are read once, and places are
    found by binary search over their lines.
    """
    hit = artifacts.where(F.col("text").rlike(_SUSPICIOUS))
    return parsed(hit, "text", _unicode_rows, "category string, severity string, safety_class string, code_point string, offset int, line int, col int, removable boolean").drop("error")


def _whitespace_rows(text: str | None) -> Iterator[tuple]:
    from loupe.detection.model import Artifact

    a = Artifact("", "text", text or "", None)
    for name, pattern in WHITESPACE:
        yield from ((name, m.start(), m.end() - m.start(), a.place(m.start())["line"]) for m in re.finditer(pattern, a.string))


def whitespace_findings(artifacts: DataFrame) -> DataFrame:
    """Long runs of blanks inside a line, and four or more line breaks in a row."""
    hit = artifacts.where(F.col("text").rlike(r"[ \t]{8}|\n[ \t\r\n]*\n"))
    return parsed(hit, "text", _whitespace_rows, "pattern string, offset int, length int, line int").drop("error")


def _attribution_rows(context: str) -> Callable[[str | None], Iterator[tuple]]:
    def rows(text: str | None) -> Iterator[tuple]:
        from loupe.detection.model import Artifact, attributions, standalone

        a = Artifact("", "text", text or "", None)
        for rule, provider, confidence, m in attributions(a.string, context):
            start, _ = a.line_span(m.start())
            stop = a.string.find("\n", m.end())
            line = a.string[start : len(a.string) if stop < 0 else stop]
            yield rule, provider, confidence, m.start(), a.place(m.start())["line"], m[0], standalone(line, m.start() - start, m.end() - start)

    return rows


def attribution_findings(artifacts: DataFrame, context: str = TEXT_CONTEXT) -> DataFrame:
    """Literal attributions by the rules of a context; removable where the line holds nothing else."""
    hit = artifacts.where(F.col("text").rlike(_HINT))
    return parsed(hit, "text", _attribution_rows(context), "rule_id string, provider string, confidence double, offset int, line int, match string, standalone boolean").drop("error")


def unicode_sql(source: str) -> str:
    """The unusual characters of (artifact_path, text), for DuckDB."""
    return f"""
    WITH a AS ({source}),
    c AS (SELECT artifact_path, text, i - 1 AS o, substr(text, i, 1) AS ch, unicode(substr(text, i, 1)) AS u FROM (SELECT artifact_path, text, unnest(range(1, length(text) + 1)) AS i FROM a WHERE regexp_matches(text, '[^\\x20-\\x7e\\t\\n\\r]'))),
    s AS (SELECT *, CASE
        WHEN u = 65279 AND o = 0 THEN 'safe'
        WHEN u IN ({", ".join(map(str, BIDI_CONTROLS))}) THEN 'control'
        WHEN u BETWEEN 65024 AND 65039 OR u BETWEEN 917760 AND 917999 THEN 'language_dependent'
        WHEN u IN (160, 8239) THEN 'typographic' WHEN u IN (173, 8204, 8205) THEN 'language_dependent' WHEN u IN (8203, 8288, 65279) THEN 'invisible'
        WHEN regexp_matches(ch, '\\p{{Cc}}') AND u NOT IN (9, 10, 13) THEN 'control' WHEN regexp_matches(ch, '\\p{{Cf}}') THEN 'suspicious'
        WHEN regexp_matches(ch, '\\p{{Z}}') AND u <> 32 THEN 'typographic' END AS safety_class FROM c)
    SELECT artifact_path, CASE WHEN safety_class IN ('invisible', 'language_dependent', 'typographic') THEN 'invisible_unicode' ELSE 'suspicious_unicode' END AS category,
      CASE WHEN safety_class = 'control' THEN 'medium' WHEN safety_class IN ('invisible', 'suspicious') OR u IN (160, 8239) THEN 'low' ELSE 'info' END AS severity,
      safety_class, 'U+' || lpad(upper(to_hex(u)), CAST(greatest(4, length(to_hex(u))) AS INT), '0') AS code_point, CAST(o AS INT) AS "offset",
      {place_sql("text", "o")[0]} AS line, {place_sql("text", "o")[1]} AS col, u IN (8203, 8288) AS removable
    FROM s WHERE safety_class IS NOT NULL
    """


def place_sql(text: str, offset: str) -> tuple[str, str]:
    """Line and column of an offset, for DuckDB."""
    head = f"substr({text}, 1, {offset})"
    return f"CAST(length({head}) - length(replace({head}, chr(10), '')) + 1 AS INT)", f"CAST({offset} - coalesce(length({head}) - instr(reverse({head}), chr(10)) + 1, 0) * CASE WHEN contains({head}, chr(10)) THEN 1 ELSE 0 END + 1 AS INT)"


@query("unicode_findings", unicode_sql(PLANTED))
def q_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode_findings(planted(spark, sf_dir))


@query(
    "unicode_class_counts",
    f"""
    WITH a AS ({PLANTED}),
    c AS (SELECT unicode(ch) AS u, o FROM (SELECT unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS o FROM a))
    SELECT CASE WHEN u = 8203 OR (u = 65279 AND o > 0) THEN 'invisible' WHEN u = 8238 THEN 'control' WHEN u = 160 THEN 'typographic' WHEN u = 65279 THEN 'safe' ELSE 'language_dependent' END AS safety_class, count(*) AS n
    FROM c WHERE u IN (8203, 65279, 8238, 160, 8204, 8205, 173, 917760) GROUP BY 1
    """,
)
def q_unicode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode_findings(planted(spark, sf_dir)).groupBy("safety_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "whitespace_patterns",
    f"""
    WITH a AS ({PLANTED})
    SELECT artifact_path, 'long-run' AS pattern, CAST(instr(text, 'left         right') + 3 AS INT) AS "offset", 9 AS length,
      CAST(length(substr(text, 1, instr(text, 'left         right') + 3)) - length(replace(substr(text, 1, instr(text, 'left         right') + 3), chr(10), '')) + 1 AS INT) AS line
    FROM a WHERE contains(text, 'left         right')
    UNION ALL
    SELECT artifact_path, 'blank-lines', CAST(instr(text, 'above' || repeat(chr(10), 5)) + 4 AS INT), 5,
      CAST(length(substr(text, 1, instr(text, 'above' || repeat(chr(10), 5)) + 4)) - length(replace(substr(text, 1, instr(text, 'above' || repeat(chr(10), 5)) + 4), chr(10), '')) + 1 AS INT)
    FROM a WHERE contains(text, 'above' || repeat(chr(10), 5))
    """,
)
def q_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitespace_findings(planted(spark, sf_dir))


def attribution_sql(source: str, context: str) -> str:
    """The rules of a context over (artifact_path, text), for DuckDB."""
    parts = []
    for rule, provider, confidence, contexts, pattern in RULES:
        if context in contexts:
            p = "(?is)(.*?)(" + pattern.replace("'", "''") + ")"
            parts.append(f"SELECT artifact_path, text, '{rule}' AS rule_id, '{provider}' AS provider, {confidence}::DOUBLE AS confidence, regexp_extract_all(text, '{p}', 1) AS b, regexp_extract_all(text, '{p}', 2) AS h FROM ({source})")
    return f"""
    WITH m AS ({" UNION ALL ".join(parts)}),
    e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0),
    f AS (SELECT artifact_path, text, rule_id, provider, confidence, h[i] AS match, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS INT) AS o FROM e)
    SELECT artifact_path, rule_id, provider, confidence, o AS "offset", CAST(length(substr(text, 1, o)) - length(replace(substr(text, 1, o), chr(10), '')) + 1 AS INT) AS line, match,
      NOT regexp_matches(list_last(string_split(substr(text, 1, o), chr(10))) || string_split(substr(text, o + length(match) + 1), chr(10))[1], '[\\p{{L}}\\p{{N}}]') AS standalone
    FROM f
    """


@query("attribution_findings", attribution_sql(PLANTED, TEXT_CONTEXT))
def q_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution_findings(planted(spark, sf_dir))


#: Conversations as commit messages, some with an attribution.
COMMITS = """SELECT concat('commit/', conv_id, '/', turn) AS artifact_path, concat(coalesce(text, ''), CASE WHEN (conv_id + turn) % 6 = 0 THEN '
Co-Authored-By: ChatGPT <bot@example.org>' ELSE '' END, CASE WHEN conv_id % 9 = 0 THEN '
created by Gemini' ELSE '' END) AS text FROM conversations"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    trailer = F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, "\nCo-Authored-By: ChatGPT <bot@example.org>").otherwise("")
    note = F.when(F.col("conv_id") % 9 == 0, "\ncreated by Gemini").otherwise("")
    return rows.select(F.concat(F.lit("commit/"), "conv_id", F.lit("/"), "turn").alias("artifact_path"), F.concat(F.coalesce("text", F.lit("")), trailer, note).alias("text"))


@query("git_attribution", f"SELECT artifact_path, rule_id, provider, line, false AS removable, 'git.rewrite-history' AS remediation_id FROM ({attribution_sql(COMMITS, GIT_COMMIT)})")
def q_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribution_findings(commits(spark, sf_dir), GIT_COMMIT)
    return found.select("artifact_path", "rule_id", "provider", "line", F.lit(False).alias("removable"), F.lit("git.rewrite-history").alias("remediation_id"))


# Files and folders that belong to assistants' tooling.
TOOLING_NAMES = {"CLAUDE.md": "anthropic", ".github/copilot-instructions.md": "github-copilot", ".cursorrules": "cursor", ".windsurfrules": "windsurf", "AGENTS.md": "generic-agent"}
TOOLING_PREFIXES = {".claude/": "anthropic", ".codex/": "openai", ".cursor/": "cursor"}


def tooling_paths(tracked: DataFrame) -> DataFrame:
    """Tracked paths that are an assistant's configuration, with its provider."""
    provider = F.lit(None).cast("string")
    for prefix, name in reversed(TOOLING_PREFIXES.items()):
        provider = F.when(F.col("path").startswith(prefix), name).otherwise(provider)
    for path, name in reversed(TOOLING_NAMES.items()):
        provider = F.when(F.col("path") == path, name).otherwise(provider)
    return tracked.withColumn("provider", provider).where("provider is not null").select("path", "provider", F.lit("tooling_residue").alias("category"), F.lit("info").alias("severity"))


_TRACKED = ("CLAUDE.md", ".claude/settings.json", ".codex/run.toml", "src/main.py", ".cursorrules", "docs/AGENTS.md")


@query(
    "tooling_paths",
    """
    WITH t AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'CLAUDE.md' WHEN 1 THEN '.claude/settings.json' WHEN 2 THEN '.codex/run.toml' WHEN 3 THEN 'src/main.py' WHEN 4 THEN '.cursorrules' ELSE 'docs/AGENTS.md' END AS path FROM part)
    SELECT path, CASE WHEN path = 'CLAUDE.md' OR starts_with(path, '.claude/') THEN 'anthropic' WHEN starts_with(path, '.codex/') THEN 'openai' ELSE 'cursor' END AS provider, 'tooling_residue' AS category, 'info' AS severity
    FROM t WHERE path NOT IN ('src/main.py', 'docs/AGENTS.md')
    """,
)
def q_tooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _TRACKED)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return tooling_paths(table(spark, sf_dir, "part").select(path.alias("path")))


def protected_markers(artifacts: DataFrame) -> DataFrame:
    """The first protected provenance marker of each artifact, where there is one."""
    low = F.lower("text")
    first = F.coalesce(*(F.when(low.contains(m), F.lit(m)) for m in PROTECTED_MARKERS))
    return artifacts.withColumn("marker", first).where("marker is not null").withColumn("offset", (F.instr(low, F.col("marker")) - 1).cast("int")).select("artifact_path", "marker", "offset", F.lit("c2pa_provenance").alias("category"), F.lit(False).alias("removable"))


@query(
    "protected_markers",
    """
    WITH a AS (SELECT concat('page/', page_id) AS artifact_path, concat(html, CASE WHEN page_id % 4 = 0 THEN '<!-- C2PA manifest -->' WHEN page_id % 7 = 0 THEN '<!-- Content Credentials -->' ELSE '' END) AS text FROM pages),
    b AS (SELECT *, CASE WHEN contains(lower(text), 'c2pa') THEN 'c2pa' WHEN contains(lower(text), 'content credentials') THEN 'content credentials' END AS marker FROM a)
    SELECT artifact_path, marker, CAST(instr(lower(text), marker) - 1 AS INT) AS "offset", 'c2pa_provenance' AS category, false AS removable FROM b WHERE marker IS NOT NULL
    """,
)
def q_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mark = F.when(F.col("page_id") % 4 == 0, "<!-- C2PA manifest -->").when(F.col("page_id") % 7 == 0, "<!-- Content Credentials -->").otherwise("")
    return protected_markers(pages.select(F.concat(F.lit("page/"), "page_id").alias("artifact_path"), F.concat("html", mark).alias("text")))
