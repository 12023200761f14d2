"""Governance of a labelled corpus: admission, audits, balance and contamination."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.joins import folded_digest
from loupe.plans.fixtures import CONSENTS, SAMPLES, bound
from loupe.registry import query


@dataclass(frozen=True)
class Policy:
    """What a corpus may hold."""

    purpose: str = "training"
    now: str = "2000-01-01 00:00:00"
    retain_days: int = 1460
    targets: Mapping[str, float] = field(default_factory=lambda: {"legal": 0.5, "software": 0.25, "medical": 0.25})
    tolerance: float = 0.1
    holdout_only: tuple[str, ...] = ("source3",)
    required_uses: tuple[str, ...] = ("training",)


DEFAULT = Policy()


def _now(p: Policy) -> Column:
    return F.lit(p.now).cast("timestamp")


def _covers(p: Policy) -> Column:
    """Consent holds from its grant until before it expires, for its purpose."""
    return (F.col("status") == "active") & (F.col("granted_at") <= _now(p)) & (F.col("expires_at").isNull() | (_now(p) < F.col("expires_at"))) & (F.col("purpose") == p.purpose)


def _expired(p: Policy) -> Column:
    return _now(p) >= F.col("collected_at") + F.make_dt_interval(F.lit(p.retain_days))


def _unless(fine: Column, reason: str) -> Column:
    """The reason, unless it is known that all is fine: what isn't known doesn't admit a sample."""
    return F.when(~F.coalesce(fine, F.lit(False)), reason)


def refusals(samples: DataFrame, consents: DataFrame, existing: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """All reasons to refuse each sample; none means that it is admitted. A null never admits.

    A licence is a list of uses, ``permits``, that must hold every use of the policy, or else ``permits_training``.
    """
    splits = existing.groupBy("content_sha256").agg(F.collect_set("split").alias("splits"))  # at most one of each split
    joined = samples.join(consents, "consent_id", "left").join(splits, "content_sha256", "left")
    licensed = F.size(F.array_except(F.array(*map(F.lit, policy.required_uses)), F.col("permits"))) == 0 if "permits" in samples.columns else F.col("permits_training")
    reserved = F.coalesce(F.col("source").isin(*policy.holdout_only), F.lit(True))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("status").isNull(), "no_consent").when(F.col("status") == "withdrawn", "withdrawn").otherwise(_unless(_covers(policy), "not_covered")),
            _unless(licensed, "license"),
            _unless(F.col("domain").isin(*policy.targets), "domain") if policy.targets else F.lit(None).cast("string"),
            _unless(~_expired(policy), "retention"),
            _unless(F.col("splits").isNull() | (F.size(F.array_remove("splits", F.col("split"))) == 0), "other_split"),
            F.when(reserved, _unless(F.col("split") == "test", "holdout_source")),
        )
    )
    return joined.select(*samples.columns, F.array_join(reasons, ",").alias("refusals"), (F.size(reasons) == 0).alias("admitted"))


def admit_batch(candidates: DataFrame, consents: DataFrame, existing: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Each candidate judged against the corpus and the candidates before it.

    An admitted candidate only keeps the same content out of other splits, so
    the split of the first that no other rule refuses decides for its content.
    """
    alone = refusals(candidates, consents, existing, policy)
    firsts = alone.where("admitted").groupBy("content_sha256").agg(F.min_by("split", "ord").alias("first_split"))
    return alone.join(firsts, "content_sha256", "left").select("sample_id", (F.col("admitted") & (F.col("split") == F.col("first_split"))).alias("admitted"))


def must_delete(samples: DataFrame, consents: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Samples without a consent that covers the purpose now."""
    return samples.join(consents, "consent_id", "left").where(~F.coalesce(_covers(policy), F.lit(False))).select("sample_id")


def overdue(samples: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return samples.where(_expired(policy)).select("sample_id")


def leaked_sources(samples: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Sources kept for the holdout that occur elsewhere."""
    return samples.where(F.col("source").isin(*policy.holdout_only) & (F.col("split") != "test")).select("source").distinct()


def contaminated(samples: DataFrame) -> DataFrame:
    """Content that stands in more than one split."""
    return samples.groupBy("content_sha256").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def imbalance(samples: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Domains whose share is off its target; a domain without samples has share 0."""
    spark = samples.sparkSession
    targets = spark.createDataFrame(list(policy.targets.items()), "domain string, target double")
    counts = samples.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    total = samples.agg(F.count(F.lit(1)).alias("total"))
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    return F.broadcast(targets).join(counts, "domain", "left").join(F.broadcast(total)).withColumn("share", share).where(F.abs(share - F.col("target")) > policy.tolerance).select("domain", F.round("share", 6).alias("share"), "target")


def corpus_digest(samples: DataFrame) -> DataFrame:
    """A digest of all samples that doesn't depend on their order."""
    return folded_digest(samples.select(F.sha2(F.concat_ws("|", "sample_id", "content_sha256", "split"), 256).alias("h")))


def withdraw(consents: DataFrame, samples: DataFrame, consent_ids: DataFrame) -> DataFrame:
    """The samples that a withdrawal concerns. They are named, not deleted."""
    return samples.join(consents.join(consent_ids, "consent_id", "left_semi").select("consent_id"), "consent_id", "left_semi").select("sample_id", "consent_id")


def benchmark_overlap(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are, word for word, a held-out item."""
    digest = lambda df: df.withColumn("digest", F.sha2(F.trim("text"), 256))
    return digest(documents).join(digest(benchmark).select("item_id", "digest"), "digest").select("doc_id", "item_id")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, SAMPLES)


def _consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, CONSENTS)


_N = "TIMESTAMP '2000-01-01 00:00:00'"
_COVER = f"(c.status = 'active' AND c.granted_at <= {_N} AND (c.expires_at IS NULL OR {_N} < c.expires_at) AND c.purpose = 'training')"
_REFUSED = f"""s AS ({SAMPLES}), c AS ({CONSENTS}), cand AS (SELECT * FROM s WHERE ord % 4 = 0), ex AS (SELECT * FROM s WHERE ord % 4 <> 0 AND ord % 10 = 1),
  r AS (SELECT cand.*, concat_ws(',', CASE WHEN c.status IS NULL THEN 'no_consent' WHEN c.status = 'withdrawn' THEN 'withdrawn' WHEN {_COVER} IS DISTINCT FROM true THEN 'not_covered' END, CASE WHEN list_contains(permits, 'training') IS DISTINCT FROM true THEN 'license' END,
    CASE WHEN domain IN ('legal', 'software', 'medical') IS DISTINCT FROM true THEN 'domain' END, CASE WHEN {_N} >= collected_at + INTERVAL 1460 DAY THEN 'retention' END,
    CASE WHEN EXISTS (SELECT 1 FROM ex WHERE ex.content_sha256 = cand.content_sha256 AND ex.split <> cand.split) THEN 'other_split' END, CASE WHEN source = 'source3' AND split <> 'test' THEN 'holdout_source' END) AS refusals
  FROM cand LEFT JOIN c ON c.consent_id = cand.consent_id)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = _samples(spark, sf_dir)
    return s.where("ord % 4 = 0"), _consents(spark, sf_dir), s.where("ord % 4 <> 0 AND ord % 10 = 1")


@query("admission", f"WITH {_REFUSED} SELECT sample_id, refusals, refusals = '' AS admitted FROM r")
def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refusals(*_parts(spark, sf_dir)).select("sample_id", "refusals", "admitted")


@query("batch_admission", f"WITH {_REFUSED}, f AS (SELECT content_sha256, arg_min(split, ord) AS first_split FROM r WHERE refusals = '' GROUP BY 1) SELECT sample_id, refusals = '' AND coalesce(split = first_split, true) AS admitted FROM r LEFT JOIN f USING (content_sha256)")
def q_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit_batch(*_parts(spark, sf_dir)).select("sample_id", F.coalesce("admitted", F.lit(False)).alias("admitted"))


@query("corpus_must_delete", f"WITH s AS ({SAMPLES}), c AS ({CONSENTS}) SELECT sample_id FROM s LEFT JOIN c USING (consent_id) WHERE NOT coalesce({_COVER}, false)")
def q_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return must_delete(_samples(spark, sf_dir), _consents(spark, sf_dir))


@query("corpus_overdue", f"WITH s AS ({SAMPLES}) SELECT sample_id FROM s WHERE {_N} >= collected_at + INTERVAL 1460 DAY")
def q_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overdue(_samples(spark, sf_dir))


@query("corpus_leaked_sources", f"WITH s AS ({SAMPLES}) SELECT DISTINCT source FROM s WHERE source = 'source3' AND split <> 'test'")
def q_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_sources(_samples(spark, sf_dir))


@query("corpus_contaminated", f"WITH s AS ({SAMPLES}) SELECT content_sha256, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def q_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_samples(spark, sf_dir))


@query(
    "corpus_imbalance",
    f"""WITH s AS ({SAMPLES}), t(domain, target) AS (VALUES ('legal', 0.5::DOUBLE), ('software', 0.25::DOUBLE), ('medical', 0.25::DOUBLE)), n AS (SELECT domain, count(*) AS n FROM s GROUP BY 1)
    SELECT domain, round(coalesce(n, 0) / (SELECT count(*) FROM s), 6) AS share, target FROM t LEFT JOIN n USING (domain) WHERE abs(coalesce(n, 0) / (SELECT count(*) FROM s) - target) > 0.1""",
)
def q_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imbalance(_samples(spark, sf_dir))


@query("corpus_digest", f"WITH s AS ({SAMPLES}), h AS (SELECT sha256(concat_ws('|', sample_id, content_sha256, split)) AS h FROM s), a AS (SELECT substr(h, 1, 4) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY substr(h, 1, 4)), b AS (SELECT substr(h, 1, 2) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM a GROUP BY substr(h, 1, 2)) SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest FROM b")
def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_digest(_samples(spark, sf_dir))


@query("consent_withdrawal", f"WITH s AS ({SAMPLES}), c AS ({CONSENTS}) SELECT sample_id, consent_id FROM s WHERE consent_id IN (SELECT consent_id FROM c WHERE status = 'withdrawn')")
def q_withdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _consents(spark, sf_dir)
    return withdraw(c, _samples(spark, sf_dir), c.where("status = 'withdrawn'").select("consent_id"))


@query("benchmark_overlap", "SELECT doc_id, item_id FROM (SELECT doc_id, trim(CASE WHEN doc_id % 50 = 0 THEN (SELECT text FROM benchmark WHERE item_id = 1) ELSE text END) AS t FROM documents) AS d JOIN (SELECT item_id, trim(text) AS t FROM benchmark) AS b USING (t)")
def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bound(spark, sf_dir, "SELECT doc_id, text FROM documents")
    items = bound(spark, sf_dir, "SELECT item_id, text FROM benchmark")
    one = items.where("item_id = 1").select(F.col("text").alias("planted"))
    return benchmark_overlap(docs.join(F.broadcast(one), how="left").select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.col("planted")).otherwise(F.col("text")).alias("text")), items)
