"""Broadcasts behind a check of their size, and other ways beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a hand-written dimension that is broadcast.
SMALL = 100_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table has no more than so many rows; reads one more than that at most."""
    return df.limit(rows + 1).count() <= rows


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """The table as the broadcast side of an equality join where it is small; joined by shuffle beyond."""
    return F.broadcast(df) if at_most(df, rows) else df


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """A table that a join without equality broadcasts; more than ``rows`` of it are refused, as its format limits it."""
    if not at_most(df, rows):
        raise ValueError(f"there are more than {rows} {what}")
    return F.broadcast(df)


def glob_regex(glob: Column) -> Column:
    """A path glob as an anchored regular expression: ``*``, ``?``, ``[...]`` and ``[!...]``; all else is itself."""
    token = F.regexp_extract_all(F.replace(glob, F.lit("\\"), F.lit("/")), F.lit(r"(\[!?\]?[^\]]*\]|[\s\S])"), F.lit(1))
    inner = lambda t, skip: F.regexp_replace(F.substr(t, F.lit(skip), F.length(t) - skip), r"([\[\]&^\\])", r"\\$1")
    part = lambda t: (
        F.when(t == "*", ".*")
        .when(t == "?", ".")
        .when((F.length(t) > 2) & t.startswith("[!"), F.concat(F.lit("[^"), inner(t, 3), F.lit("]")))
        .when(F.length(t) > 2, F.concat(F.lit("["), inner(t, 2), F.lit("]")))
        .otherwise(F.concat(F.lit("\\Q"), t, F.lit("\\E")))
    )
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(token, part), ""), F.lit("$"))


def folded_digest(hashes: DataFrame, width: int = 2) -> DataFrame:
    """One digest of a column ``h`` of hex digests, whatever their order.

    Digests are folded by the first ``2 * width`` digits, those folds by the first ``width``, and these once more, so no
    row gathers more than the bucket that its digits name: with n hashes about n / 16 ** (2 * width) of them.
    """
    folded = hashes.select("h")
    for digits in (2 * width, width, 0):
        bucket = F.substr("h", F.lit(1), F.lit(digits)) if digits else F.lit("")
        folded = folded.groupBy(bucket.alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("all"))
        folded = folded.select(F.concat("bucket", F.sha2("all", 256)).alias("h"))
    return folded.select(F.col("h").alias("digest"))
