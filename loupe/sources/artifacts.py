"""Tables as artifacts, with traces planted where the corpus has none.

The overlay is one SQL expression that Spark and DuckDB both read, so a query
and its twin can't drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZERO_WIDTH, NON_JOINER, JOINER, BOM = "​", "‌", "‍", "﻿"
BIDI, NO_BREAK, SOFT_HYPHEN, SELECTOR = "‮", " ", "­", "\U000e0100"
EM_DASH = "—"


def _when(condition: str, planted: str) -> str:
    return f"CASE WHEN {condition} THEN '{planted}' ELSE '' END"


#: What stands before the text, behind its second character, and at its end.
_BEFORE = [("doc_id % 13 = 0", BOM)]
_INSIDE = [
    ("doc_id % 5 = 0", ZERO_WIDTH),
    ("doc_id % 11 = 0", BIDI + NO_BREAK),
    ("doc_id % 17 = 0", BOM),
    ("doc_id % 19 = 0", "a" + JOINER + "b" + NON_JOINER),
    ("doc_id % 23 = 0", "c" + SOFT_HYPHEN + "d" + SELECTOR),
]
_AFTER = [
    ("doc_id % 7 = 0", "\nGenerated with ChatGPT\n"),
    ("doc_id % 29 = 0", "\nThe summary was written by Claude for the team.\n"),
    ("doc_id % 31 = 0", "\nhttps://chatgpt.com/share/abc-123\n"),
    ("doc_id % 37 = 0", "\nCo-Authored-By: Claude <noreply@example.org>\n"),
    ("doc_id % 41 = 0", "\nleft         right\n"),
    ("doc_id % 43 = 0", "\nabove\n\n\n\n\nbelow\n"),
    ("doc_id % 3 = 0", "\n\n# Heading\n\nHowever, one; two " + EM_DASH + " three. However, four. However, five!\n\n- item one\n- item two\n\nMoreover the end of it all. The end of it all. The end of it all.\n"),
]

TEXT = "concat(" + ", ".join([*(_when(*p) for p in _BEFORE), "substr(coalesce(text, ''), 1, 2)", *(_when(*p) for p in _INSIDE), "substr(coalesce(text, ''), 3)", *(_when(*p) for p in _AFTER)]) + ")"

#: The planted documents, in SQL for either engine.
PLANTED = f"SELECT doc_id, concat('doc/', doc_id, '.txt') AS artifact_path, lang, source, {TEXT} AS text FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text artifacts: doc_id, artifact_path, lang, source, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr("concat('doc/', doc_id, '.txt')").alias("artifact_path"), "lang", "source", F.expr(TEXT).alias("text"))


def described(artifacts: DataFrame, text: str = "text") -> DataFrame:
    """Adds size in bytes, SHA-256 and whether the text is within ``limit`` bytes."""
    return artifacts.withColumn("size", F.octet_length(text).cast("long")).withColumn("sha256", F.sha2(text, 256))
