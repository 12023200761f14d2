"""Quality rules with risk-controlled thresholds.

Each rule scores a document; a document is rejected where a score reaches the
rule's cutoff in its stratum. One part of the labelled documents, told by a hash
of the text, proposes: for each stratum and rule the cutoff of a fixed grid that
rejects most bad and fewest good documents, and an order of the rules by that
gain. The other part, the holdout, decides: rules are allowed one after another
while the exact binomial tail shows, at the level asked for, that all allowed so
far reject no more than the permitted share of the stratum's good documents.
Tests of a stratum form a fixed sequence that ends at the first failure, and
Bonferroni's correction covers the strata. Strata with too few labelled
documents to prove anything are one stratum together; if that is too small as
well, it keeps all that the base rules keep.

One score counts words of a lexicon, a decision list that is learned greedily
from the proposing part of all labelled documents: the word that tells most of
the toxic documents not yet told, with few others, comes next. Toxic documents
stay on the cluster; a pass over their likely words brings the driver the words
that gain most and how many documents hold each combination of these, from which
all picks follow that no other word can come before. Nothing is fitted on a
sample.

Defined results: null and empty texts have no words and fail the base rules; a
null stratum is one of its own; repeated labels of an id count as bad if any is;
ids without label, null ids and repeated rows are judged like any other; with no
labels at all only the base rules decide; an empty table gives no rows. Other
columns are ignored by ``scored`` and kept by ``quality_filtered``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.llm.common import batches, discarded, hashes, join_counted, staged, table, unwrapped, windows

#: Words that may stand in the lexicon, and toxic documents that a word must tell.
LEXICON, SUPPORT = 200, 5
#: Words that a pass over the toxic documents weighs: the driver gets up to 2 ** AT_ONCE counts.
AT_ONCE = 16
#: Of the labelled texts, the share out of 10 that decides; the rest proposes.
HOLDOUT = 5
#: The stratum of all whose labelled documents are too few.
REST = "*"

#: Rules and their grids, mildest cutoff first.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "shouting": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "one_word": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "repeats": (0.28, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05),
    "lines": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "toxic": (8.0, 4.0, 2.0, 1.0),
}
#: Weight of a good document rejected against a bad one, when a cutoff is chosen.
REGRET = 10


@dataclass(frozen=True)
class Risk:
    """Good documents of a stratum that may be rejected, and the chance of breaking that promise anywhere."""

    share: float = 0.05
    chance: float = 0.05


_SPACE = b" \t\n\v\f\r"
_NOT_CODE_POINTS = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Lower case, and a space for everything that is neither letter nor digit nor beyond ASCII.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def _without(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def _covered_twice(h: np.ndarray, n: int = 8) -> int:
    """Words inside windows of ``n`` that stand in the text twice or more."""
    w = windows(h, n)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(text: bytes | None, lexicon: frozenset[bytes]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the scores of a text."""
    if not text:
        return (0, 0, 0, 0, 0, *(0.0 for _ in GRIDS))
    words = text.split()
    n = len(words)
    symbols = len(text) - _without(text, _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    h = hashes(words)
    repeat = _covered_twice(h)
    upper, lower = len(text) - _without(text, _UPPER), len(text) - _without(text, _LOWER)
    most = int(np.unique(h, return_counts=True)[1].max()) if n else 0
    toxic = len(lexicon.intersection(text.translate(_PLAIN).split())) if lexicon else 0
    share = max(n, 1)
    scores = (symbols / share, upper / max(upper + lower, 1), most / share, repeat / share, dup / max(len(lines), 1), float(toxic))
    return (n, _without(text, _SPACE + _NOT_CODE_POINTS), symbols, dup, repeat, *scores)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _held_out(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(10)) < HOLDOUT


def _plain_words(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, word): the distinct plain words of labelled texts."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            sets = [sorted(set((t or b"").translate(_PLAIN).split())) for t in texts]
            take = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(take), batch.column("toxic").take(take), pa.array([w for x in sets for w in x], pa.binary())], names=["doc_id", "toxic", "word"])

    return docs.mapInArrow(made, "doc_id long, toxic int, word binary")


def _toxic_sets(words: DataFrame) -> DataFrame:
    """(doc_id, words): the likely words of each toxic document that has some, with the good documents that hold them; staged."""
    counts = words.groupBy("word").agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("good"))
    likely = staged(counts.where((F.col("n") >= SUPPORT) & (F.col("n") >= 4 * F.col("good"))), "quality-likely")
    total = likely.agg(F.sum("n")).first()[0] or 0
    pairs = join_counted(words.where("toxic = 1").select("doc_id", "word"), likely, "word", total).distinct()
    sets = staged(pairs.groupBy("doc_id").agg(F.collect_list(F.struct("word", "good")).alias("words")), "quality-toxic")
    discarded(likely)
    return sets


def _decision_list(sets: DataFrame) -> list[bytes]:
    """The words picked greedily, first one first; of equal gains the greatest word."""
    held = F.col("words.word")
    picked: list[bytes] = []
    while len(picked) < LEXICON:
        rest = sets.where(~F.arrays_overlap(held, F.array(*map(F.lit, picked)))) if picked else sets
        counts = rest.select(F.explode("words").alias("w")).groupBy("w.word", "w.good").count()
        gains = counts.where(F.col("count") >= SUPPORT).select("word", "good", (F.col("count") - 4 * F.col("good")).alias("gain")).where("gain >= 0")
        first = gains.orderBy(F.desc("gain"), F.desc("word")).limit(AT_ONCE + 1).collect()
        if not first:
            break
        words = [(bytes(r["word"]), r["good"]) for r in first[:AT_ONCE]]
        bound = [(r["gain"], bytes(r["word"])) for r in first[AT_ONCE:]]  # no other word gains more, now or later
        mask = sum((F.when(F.array_contains(held, F.lit(w)), 1 << i).otherwise(0) for i, (w, _) in enumerate(words)), F.lit(0))
        masks = {r["mask"]: r["count"] for r in rest.groupBy(mask.alias("mask")).count().where("mask > 0").collect()}  # fewer than 2 ** AT_ONCE
        while len(picked) < LEXICON:
            new = [sum(n for m, n in masks.items() if m >> i & 1) for i in range(len(words))]
            able = [(n - 4 * good, w, i) for i, (n, (w, good)) in enumerate(zip(new, words, strict=True)) if n >= SUPPORT and n >= 4 * good]
            if not able or (bound and max(able)[:2] < bound[0]):
                break
            _, word, i = max(able)
            picked.append(word)
            masks = {m: n for m, n in masks.items() if not m >> i & 1}
        if not bound:
            break
    return picked


def lexicon_of(docs: DataFrame, labels: DataFrame) -> frozenset[bytes]:
    """The decision list, from the proposing part of all labelled documents."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int")).alias("toxic"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~_held_out(F.col("text"))).join(told.hint("merge"), "doc_id")  # labels grow with the documents
    words = staged(_plain_words(found), "quality-words")
    sets = _toxic_sets(words)
    picked = _decision_list(sets)
    discarded(words, sets)
    return frozenset(picked)


def scored(docs: DataFrame, lexicon: frozenset[bytes], whole: bool = False) -> DataFrame:
    """doc_id, stratum, holdout, counts and scores of every document; with its whole row, if that is asked for."""
    names = [*_COUNTS, *(f"s_{k}" for k in GRIDS)]
    held = ["doc_id", "stratum", "holdout", *(["row"] if whole else [])]

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            rows = list(zip(*(measured(t, lexicon) for t in texts), strict=True))
            yield pa.record_batch([*(batch.column(c) for c in held), *(pa.array(r, pa.int64() if i < len(_COUNTS) else pa.float64()) for i, r in enumerate(rows))], names=[*held, *names])

    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    row = [F.struct("*").alias("row")] if whole else []
    picked = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), F.col("text").cast("string").alias("text"))
    picked = picked.withColumn("holdout", _held_out(F.col("text")))
    schema = T.StructType([picked.schema[c] for c in held] + [T.StructField(n, T.LongType() if i < len(_COUNTS) else T.DoubleType()) for i, n in enumerate(names)])
    return picked.select(*held, "text").mapInArrow(made, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact."""
    if n == 0 or k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def cutoffs(scores: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str, dict[str, float]]:
    """The rules allowed in each stratum and their cutoffs; REST stands for strata not named."""
    spark = scores.sparkSession
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"))
    known = staged(scores.where(~base_failed()).join(told, "doc_id").select("stratum", "holdout", "good", *(f"s_{k}" for k in GRIDS)), "quality-labelled")
    least = log(risk.chance) / log1p(-risk.share)  # with fewer, not even a rule that rejects none could pass
    sizes = known.where("holdout and good").groupBy("stratum").count().where(F.col("count") >= least)
    large = [r["stratum"] for r in sizes.collect()]  # one for each ``least`` labelled documents, at most
    known = known.withColumn("stratum", F.when(F.col("stratum").isin(large), F.col("stratum")).otherwise(REST))

    points = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"s_{k}").alias("score")) for k, grid in GRIDS.items() for c in grid))
    fired = known.where("not holdout").select("stratum", "good", F.explode(points).alias("p")).where("p.score >= p.cutoff")
    gains = fired.groupBy("stratum", F.col("p.rule").alias("rule"), F.col("p.cutoff").alias("cutoff")).agg(F.sum(F.when(F.col("good"), -REGRET).otherwise(1)).alias("gain"))
    best: dict[str, dict[str, tuple]] = {s: {} for s in [*large, REST]}
    for r in gains.where("gain > 0").collect():
        old = best[r["stratum"]].get(r["rule"])
        best[r["stratum"]][r["rule"]] = max((r["gain"], r["cutoff"]), old) if old else (r["gain"], r["cutoff"])
    order = {s: sorted(rules, key=lambda k: (-rules[k][0], k)) for s, rules in best.items()}

    schema = "stratum string, " + ", ".join(f"c_{k} double, i_{k} int" for k in GRIDS)
    proposed = spark.createDataFrame([(s, *(x for k in GRIDS for x in ((rules[k][1], order[s].index(k)) if k in rules else (None, None)))) for s, rules in best.items()], schema)
    first = F.least(F.lit(len(GRIDS)), *(F.when(F.col(f"s_{k}") >= F.col(f"c_{k}"), F.col(f"i_{k}")) for k in GRIDS))
    counts = known.where("holdout and good").join(F.broadcast(proposed), "stratum").groupBy("stratum", first.alias("first")).count().collect()
    out: dict[str, dict[str, float]] = {}
    for s in best:
        rejected = {r["first"]: r["count"] for r in counts if r["stratum"] == s}
        n, k, allowed = sum(rejected.values()), 0, {}
        for i, rule in enumerate(order[s]):
            k += rejected.get(i, 0)
            if binomial_tail(k, n, risk.share) > risk.chance / len(best):
                break
            allowed[rule] = best[s][rule][1]
        out[s] = allowed
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), whole: bool = False) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document; with its ``whole`` row, if that is asked for."""
    spark = docs.sparkSession
    scores = staged(scored(docs, lexicon_of(docs, labels), whole), "quality-scores")
    found = cutoffs(scores, labels, risk)
    schema = "stratum string, " + ", ".join(f"c_{k} double" for k in GRIDS)
    limits = spark.createDataFrame([(s, *(rules.get(k) for k in GRIDS)) for s, rules in sorted(found.items())], schema)
    scores = scores.withColumn("_stratum", F.when(F.col("stratum").isin(list(found)), F.col("stratum")).otherwise(REST))
    limits = limits.withColumnRenamed("stratum", "_stratum")
    over = F.lit(False)
    for k in GRIDS:
        over = over | F.coalesce(F.col(f"s_{k}") >= F.col(f"c_{k}"), F.lit(False))
    return scores.join(F.broadcast(limits), "_stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | over))


def quality_filtered(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are scored once, beside their rows."""
    kept = judged(docs, labels, risk, True).where("kept")
    return unwrapped(kept, docs)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, cutoffs tested for each language."""
    got = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", *_COUNTS, "base_failed", "kept")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
