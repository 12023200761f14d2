"""Attestations as tables: evidence, commitments, redaction, summaries, exports, timestamps and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.staging import staged
from loupe.plans.fixtures import bound, dealt
from loupe.registry import query

# Prefixes of content identifiers, what a stage's claim is called, and which disclosures stay as they are.
PREFIXES = {"certificate": "TAI1-", "bundle": "TPB1-", "attestation": "TAIP1-", "trust_store": "TAITS1-", "model": "TAIMDL1-"}
STAGES = (("origination", "originated"), ("framing", "framed"), ("decision_control", "directed"), ("execution", "executed"), ("validation", "validated"), ("integration", "integrated"), ("accountability", "owned"))
OPEN_DISCLOSURES = ("public", "omitted")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column, characters: int = 32) -> Column:
    """The first characters of a hex digest in base32: five digits of sixteen are four of thirty-two."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(-(-characters // 4) - 1)), lambda i: F.conv(F.substr(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda n, shift: F.substr(F.lit(_ALPHABET), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.substr(F.array_join(F.transform(groups, lambda n: F.concat(letter(n, 15), letter(n, 10), letter(n, 5), letter(n, 0))), ""), F.lit(1), F.lit(characters))


def content_id(kind: str, canonical: Column) -> Column:
    """The identifier that a record's canonical text gives it."""
    return F.concat(F.lit(PREFIXES[kind]), base32(F.sha2(canonical, 256)))


def commitments(evidence: DataFrame) -> DataFrame:
    """Evidence (evidence_id, payload, salt) with a salted digest, which tells nothing of a payload that can be guessed."""
    return evidence.withColumn("commitment", F.sha2(F.concat(F.col("salt").cast("binary"), F.col("payload").cast("binary")), 256))


def opened(published: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Whether each payload that was disclosed (evidence_id, payload, salt) opens what was published of it."""
    joined = disclosed.join(published.select("evidence_id", "commitment", "sha256"), "evidence_id", "left")
    salted = F.sha2(F.concat(F.coalesce("salt", F.lit("")).cast("binary"), F.col("payload").cast("binary")), 256)
    wanted = F.coalesce("commitment", "sha256")
    state = F.when(F.col("commitment").isNull() & F.col("sha256").isNull(), "nothing_published").when(salted == wanted, "consistent").otherwise("mismatch")
    return joined.select("evidence_id", state.alias("state"))


def collected(observations: DataFrame) -> DataFrame:
    """Evidence rows of observations (evidence_id, kind, payload, disclosure, reason): a digest, never the payload.

    What is committed is salted with its id's own salt, what is omitted has a reason and no digest, and an id that
    names several observations is refused.
    """
    twice = observations.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    committed, omitted = F.col("disclosure") == "committed", F.col("disclosure") == "omitted"
    rows = observations.join(twice, "evidence_id")
    return rows.select(
        "evidence_id",
        "kind",
        "disclosure",
        F.when(~committed & ~omitted, digest).alias("sha256"),
        F.when(committed, F.sha2(F.concat(F.col("salt").cast("binary"), F.col("payload").cast("binary")), 256)).alias("commitment"),
        F.when(omitted, F.col("reason")).alias("reason"),
        F.when(F.col("n") > 1, "duplicate").when(omitted & F.col("reason").isNull(), "no_reason").otherwise("accepted").alias("state"),
    )


_WITHHELD = ("sha256", "issuer", "collection_method", "locator")


def redacted(evidence: DataFrame) -> DataFrame:
    """Evidence for the public: what isn't open keeps its id, kind, disclosure and commitment, and loses the rest."""
    shown = F.col("disclosure").isin(*OPEN_DISCLOSURES)
    return evidence.select(
        "record_id",
        "evidence_id",
        "kind",
        "disclosure",
        "commitment",
        F.when(shown, F.col("description")).otherwise(F.concat(F.lit("Withheld "), "kind", F.lit(" evidence"))).alias("description"),
        *(F.when(shown, F.col(c)).alias(c) for c in _WITHHELD),
    )


def private_strings(evidence: DataFrame) -> DataFrame:
    """(record_id, secret): every string that a public variant of a record may not hold."""
    hidden = evidence.where(~F.col("disclosure").isin(*OPEN_DISCLOSURES))
    return hidden.select("record_id", F.explode(F.array_compact(F.array("description", *_WITHHELD))).alias("secret")).distinct()


def leaks(published: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_id, secret): what a public text (record_id, text) holds although it was withheld."""
    return published.join(private_strings(evidence), "record_id").where(F.contains("text", F.col("secret"))).select("record_id", "secret")


def stage_summaries(claims: DataFrame, actors: DataFrame) -> DataFrame:
    """Who carried each stage, by the strongest claim of it, in one line for each record; nobody is called an author.

    Of claims that are equal in rank and position, that of the last actor by id counts.
    """
    order = F.struct("evidence_rank", "level_rank", (-F.col("position")).alias("p"), "actor_id")
    best = claims.groupBy("record_id", "dimension").agg(F.max_by(F.struct("actor_id", "level_rank"), order).alias("c"))
    named = best.where("c.level_rank > 0").select("record_id", "dimension", F.col("c.actor_id").alias("actor_id")).join(actors.select("actor_id", F.col("kind").alias("actor_kind")), "actor_id", "left")
    who = F.when(F.col("actor_kind") == "ai_system", "AI").otherwise("human")
    place = F.element_at(F.create_map(*(F.lit(x) for i, (d, label) in enumerate(STAGES) for x in (d, f"{i}{label}"))), F.col("dimension"))
    parts = named.withColumn("part", F.struct(F.substr(place, F.lit(1), F.lit(1)).alias("at"), F.concat(who, F.lit("-"), F.substr(place, F.lit(2))).alias("said")))
    told = parts.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["said"]), ", ").alias("summary"))
    return claims.select("record_id").distinct().join(told, "record_id", "left").withColumn("summary", F.coalesce("summary", F.lit("no stage claims")))


def watermark_admissions(providers: DataFrame) -> DataFrame:
    """Which provider adapters may verify: all four conditions, none of them unknown; others say that they can't."""
    wanted = ("official", "documented", "offline", "licensed")
    lacking = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in wanted)))
    return providers.select("provider", F.array_join(lacking, ",").alias("lacking"), F.when(F.size(lacking) == 0, "supported").otherwise("verification_unavailable").alias("status"))


def timestamp_states(tokens: DataFrame) -> DataFrame:
    """The first reason why a token isn't evidence of a record's moment."""
    reason = (
        F.when(F.coalesce(F.col("token_digest") != F.col("record_digest"), F.lit(True)), "digest")
        .when(F.col("format") == "rfc3161", "not_parsed")
        .when(F.col("signature_ok").isNull() & ~F.col("signed"), "unsigned")
        .when(F.col("signature_ok").isNull(), "no_key")
        .when(~F.col("signature_ok"), "signature")
    )
    return tokens.select("record_id", F.coalesce(reason, F.lit("")).alias("reason"), reason.isNull().alias("established"))


def manifest_problems(manifests: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """What of a model's manifest doesn't hold: its own id, its signature, and each of its files on this disk.

    Files are read or they aren't: without ``found`` rows of a manifest only its id and signature are told. Files meet in sorted
    shuffles, since what is made of few bytes looks small enough to be broadcast and isn't.
    """
    own = manifests.select("manifest_id", F.array_compact(F.array(F.when(content_id("model", F.col("canonical")) != F.col("manifest_id"), "id"), F.when(F.col("signature_ok").isNull(), "unsigned").when(~F.col("signature_ok"), "signature"))).alias("p"))
    read = found.select("manifest_id").distinct().withColumn("read", F.lit(True))
    checked = files.join(read.hint("merge"), "manifest_id").join(found.withColumnsRenamed({"sha256": "have", "size_bytes": "have_size"}).hint("merge"), ["manifest_id", "path"], "left")
    bad = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("sha256"), "digest").when(F.col("have_size") != F.col("size_bytes"), "size")
    problems = own.select("manifest_id", F.explode("p").alias("problem"), F.lit("").alias("path"))
    return problems.unionByName(checked.select("manifest_id", bad.alias("problem"), "path").where("problem is not null"))


def certificate_status(certificates: DataFrame, diagnostics: DataFrame, indicators: DataFrame, inventory: DataFrame) -> DataFrame:
    """What a certificate may state of its scan: incomplete, indicators found, or clear within the detectors' scope."""
    grave = diagnostics.groupBy("certificate_id").agg(F.count(F.lit(1)).alias("told"))
    found = indicators.groupBy("certificate_id").agg(F.count(F.lit(1)).alias("indicators"))
    hashed = inventory.groupBy("certificate_id").agg(F.bool_and(F.col("sha256").isNotNull() | F.col("artifact_type").isin("directory", "git_repository")).alias("hashed"))
    joined = certificates.join(grave, "certificate_id", "left").join(found, "certificate_id", "left").join(hashed, "certificate_id", "left")
    state = F.when((F.coalesce("told", F.lit(0)) > 0) | ~F.coalesce("hashed", F.lit(True)), "incomplete").when(F.coalesce("indicators", F.lit(0)) > 0, "indicators_detected").otherwise("clear")
    return joined.select("certificate_id", state.alias("status"))


def confidence_text(findings: DataFrame) -> DataFrame:
    """Findings with what their confidence is a confidence in."""
    share = F.round(F.col("confidence") * 100).cast("int").cast("string")
    said = (
        F.when(F.col("confidence_type") == "deterministic", F.concat(F.lit("observed ("), share, F.lit("% certainty of the rule); says nothing of authorship")))
        .when(F.col("confidence_type") == "verified", F.concat(F.lit("verified by a mechanism ("), share, F.lit("%)")))
        .when(F.col("confidence_type") == "probabilistic", F.concat(F.lit("measured ("), share, F.lit("% of a model)")))
        .when(F.col("confidence_type") == "heuristic", F.concat(F.lit("style signal ("), share, F.lit("% of a rule); no proof of provenance")))
    )
    return findings.withColumn("confidence_text", said)


# -- exports


def prov_json(entities: DataFrame, activities: DataFrame, agents: DataFrame) -> DataFrame:
    """One PROV document for each record, as JSON: its entities, activities and agents by id, and the edges between them."""
    listed = lambda df, key, name: df.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(key).alias("key"), F.struct(F.col("kind").alias("kind")).alias("value"))))).alias(name))
    edge = lambda kind, a, b: F.when(F.col(b).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(a).alias("from"), F.col(b).alias("to")))
    edges = activities.select("record_id", F.explode(F.array_compact(F.array(edge("used", "activity_id", "input_id"), edge("wasAssociatedWith", "activity_id", "agent_id"), F.when(F.col("output_id").isNotNull(), F.struct(F.lit("wasGeneratedBy").alias("kind"), F.col("output_id").alias("from"), F.col("activity_id").alias("to")))))).alias("e"))
    linked = edges.groupBy("record_id").agg(F.array_sort(F.collect_set("e")).alias("edges"))
    out = listed(entities, "entity_id", "entity").join(listed(activities, "activity_id", "activity"), "record_id", "full_outer").join(listed(agents, "agent_id", "agent"), "record_id", "full_outer").join(linked, "record_id", "full_outer")
    return out.select("record_id", F.to_json(F.struct("activity", "agent", "edges", "entity")).alias("json"))


def statements(records: DataFrame) -> DataFrame:
    """An in-toto statement for each record (record_id, subject, sha256, predicate) and the bytes that a DSSE envelope signs."""
    body = F.to_json(F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), F.array(F.struct(F.create_map(F.lit("sha256"), F.col("sha256")).alias("digest"), F.col("subject").alias("name"))).alias("subject"), F.lit("https://in-toto.io/attestation/link/v0.3").alias("predicateType"), F.col("predicate").alias("predicate")))
    kind = "application/vnd.in-toto+json"
    signed = F.concat(F.lit(f"DSSEv1 {len(kind)} {kind} "), F.octet_length("statement").cast("string"), F.lit(" "), F.col("statement"))
    return records.withColumn("statement", body).select("record_id", "statement", F.sha2(signed, 256).alias("signed_sha256"))


# -- queries

_EVIDENCE = """SELECT concat('r', o_custkey) AS record_id, concat('e', o_orderkey) AS evidence_id, CASE o_orderkey % 3 WHEN 0 THEN 'test_run' WHEN 1 THEN 'diff' ELSE 'approval' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'committed' ELSE 'omitted' END AS disclosure,
  concat('about ', o_orderkey, '.') AS description, concat('d', o_orderkey, '.') AS sha256, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('issuer', o_orderkey, '.') END AS issuer, concat('by', o_orderkey, '.') AS collection_method, CASE WHEN o_orderkey % 7 = 0 THEN concat('at', o_orderkey, '.') END AS locator, CASE WHEN o_orderkey % 4 = 2 THEN concat('c', o_orderkey) END AS commitment FROM orders"""


@query(
    "evidence_redacted",
    f"""WITH e AS ({_EVIDENCE}) SELECT record_id, evidence_id, kind, disclosure, commitment, CASE WHEN disclosure IN ('public', 'omitted') THEN description ELSE concat('Withheld ', kind, ' evidence') END AS description, CASE WHEN disclosure IN ('public', 'omitted') THEN sha256 END AS sha256,
    CASE WHEN disclosure IN ('public', 'omitted') THEN issuer END AS issuer, CASE WHEN disclosure IN ('public', 'omitted') THEN collection_method END AS collection_method, CASE WHEN disclosure IN ('public', 'omitted') THEN locator END AS locator FROM e""",
)
def q_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(bound(spark, sf_dir, _EVIDENCE))


#: Public texts, some of which hold what was to be withheld.
_PUBLISHED = "SELECT concat('r', o_custkey) AS record_id, concat('we tell about ', o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 100000000 END, '. and d', o_orderkey, '. too') AS text FROM orders WHERE o_orderkey % 2 = 0"


@query(
    "evidence_leaks",
    f"""WITH e AS ({_EVIDENCE}), s AS (SELECT DISTINCT record_id, unnest([description, sha256, issuer, collection_method, locator]) AS secret FROM e WHERE disclosure NOT IN ('public', 'omitted')), p AS ({_PUBLISHED})
    SELECT record_id, secret FROM p JOIN s USING (record_id) WHERE contains(text, secret)""",
)
def q_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(bound(spark, sf_dir, _PUBLISHED), bound(spark, sf_dir, _EVIDENCE))


_COMMITTED = "SELECT concat('e', event_id) AS evidence_id, concat('p', event_id % 50) AS payload, concat('s', event_id) AS salt, event_id % 6 AS k FROM events"


@query("evidence_opened", f"WITH c AS ({_COMMITTED}) SELECT evidence_id, CASE WHEN k = 0 THEN 'nothing_published' WHEN k = 1 THEN 'mismatch' ELSE 'consistent' END AS state FROM c")
def q_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir, _COMMITTED)
    published = commitments(c).withColumn("commitment", F.when(F.col("k") == 0, None).when(F.col("k") == 2, None).otherwise(F.col("commitment"))).withColumn("sha256", F.when(F.col("k") == 2, F.sha2("payload", 256)))
    disclosed = c.select("evidence_id", F.when(F.col("k") == 1, "other").otherwise(F.col("payload")).alias("payload"), F.when(F.col("k") == 2, None).otherwise(F.col("salt")).alias("salt"))
    return opened(published, disclosed)


@query("evidence_commitments", f"WITH c AS ({_COMMITTED}) SELECT evidence_id, sha256(concat(salt, payload)) AS commitment FROM c")
def q_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commitments(bound(spark, sf_dir, _COMMITTED)).select("evidence_id", "commitment")


_OBSERVED = """SELECT concat('e', o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS evidence_id, 'file' AS kind, concat('content ', o_orderkey) AS payload, concat('salt', o_orderkey) AS salt, CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'committed' ELSE 'omitted' END AS disclosure,
  CASE WHEN o_orderkey % 8 = 3 THEN 'not ours' END AS reason FROM orders"""


@query(
    "evidence_collected",
    f"""WITH o AS ({_OBSERVED}) SELECT evidence_id, kind, disclosure, CASE WHEN disclosure IN ('public', 'private') THEN sha256(payload) END AS sha256, CASE WHEN disclosure = 'committed' THEN sha256(concat(salt, payload)) END AS commitment, CASE WHEN disclosure = 'omitted' THEN reason END AS reason,
    CASE WHEN count(*) OVER (PARTITION BY evidence_id) > 1 THEN 'duplicate' WHEN disclosure = 'omitted' AND reason IS NULL THEN 'no_reason' ELSE 'accepted' END AS state FROM o""",
)
def q_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(bound(spark, sf_dir, _OBSERVED))


_STAGE_CLAIMS = """SELECT concat('r', l_orderkey) AS record_id, CASE l_partkey % 7 WHEN 0 THEN 'origination' WHEN 1 THEN 'framing' WHEN 2 THEN 'decision_control' WHEN 3 THEN 'execution' WHEN 4 THEN 'validation' WHEN 5 THEN 'integration' ELSE 'accountability' END AS dimension, concat('a', l_suppkey) AS actor_id, l_quantity % 3 AS evidence_rank, l_partkey % 4 AS level_rank, l_linenumber * 100000 + l_partkey AS position FROM lineitem"""
_ACTORS = "SELECT concat('a', s_suppkey) AS actor_id, CASE WHEN s_suppkey % 3 = 0 THEN 'ai_system' ELSE 'person' END AS kind FROM supplier"
_DIMENSION = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {i}" for i, (d, _) in enumerate(STAGES)) + " END"
_LABEL = "CASE dimension " + " ".join(f"WHEN '{d}' THEN '{label}'" for d, label in STAGES) + " END"


@query(
    "stage_summary",
    f"""WITH c AS ({_STAGE_CLAIMS}), a AS ({_ACTORS}), b AS (SELECT *, row_number() OVER (PARTITION BY record_id, dimension ORDER BY evidence_rank DESC, level_rank DESC, position, actor_id DESC) AS k FROM c),
    s AS (SELECT record_id, string_agg(concat(CASE WHEN kind = 'ai_system' THEN 'AI' ELSE 'human' END, '-', {_LABEL}), ', ' ORDER BY {_DIMENSION}) AS summary FROM b LEFT JOIN a USING (actor_id) WHERE k = 1 AND level_rank > 0 GROUP BY 1)
    SELECT DISTINCT c.record_id, coalesce(summary, 'no stage claims') AS summary FROM c LEFT JOIN s ON s.record_id = c.record_id""",
)
def q_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_summaries(bound(spark, sf_dir, _STAGE_CLAIMS), bound(spark, sf_dir, _ACTORS))


_PROVIDERS = "SELECT concat('p', p_partkey) AS provider, p_partkey % 2 = 0 AS official, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 3 > 0 END AS documented, p_size % 2 = 0 AS offline, p_size % 5 > 0 AS licensed FROM part"


@query(
    "watermark_admission",
    f"WITH p AS ({_PROVIDERS}), r AS (SELECT provider, concat_ws(',', CASE WHEN official IS DISTINCT FROM true THEN 'official' END, CASE WHEN documented IS DISTINCT FROM true THEN 'documented' END, CASE WHEN offline IS DISTINCT FROM true THEN 'offline' END, CASE WHEN licensed IS DISTINCT FROM true THEN 'licensed' END) AS lacking FROM p) SELECT provider, lacking, CASE WHEN lacking = '' THEN 'supported' ELSE 'verification_unavailable' END AS status FROM r",
)
def q_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark_admissions(bound(spark, sf_dir, _PROVIDERS))


_TOKENS = "SELECT o_orderkey AS record_id, concat('d', o_orderkey) AS record_digest, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('d', o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) END AS token_digest, CASE WHEN o_custkey % 4 = 0 THEN 'rfc3161' ELSE 'own' END AS format, o_custkey % 5 > 0 AS signed, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 7 > 0 END AS signature_ok FROM orders"


@query(
    "timestamp_states",
    f"WITH t AS ({_TOKENS}), r AS (SELECT record_id, CASE WHEN token_digest IS DISTINCT FROM record_digest THEN 'digest' WHEN format = 'rfc3161' THEN 'not_parsed' WHEN signature_ok IS NULL AND NOT signed THEN 'unsigned' WHEN signature_ok IS NULL THEN 'no_key' WHEN NOT signature_ok THEN 'signature' ELSE '' END AS reason FROM t) SELECT record_id, reason, reason = '' AS established FROM r",
)
def q_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamp_states(bound(spark, sf_dir, _TOKENS))


@query("content_ids", f"WITH o AS (SELECT o_orderkey, sha256(concat('record ', o_orderkey)) AS h FROM orders), d AS (SELECT DISTINCT h FROM o), b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> (5 * (3 - j))) & 31 AS BIGINT) + 1, 1), '' ORDER BY i, j) AS s FROM d, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY h) SELECT o_orderkey, concat('TAIP1-', s) AS id FROM o JOIN b USING (h)")
def q_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "SELECT o_orderkey FROM orders").select("o_orderkey", content_id("attestation", F.concat(F.lit("record "), "o_orderkey")).alias("id"))


@query(
    "manifest_problems",
    """WITH m AS (SELECT p_partkey AS k FROM part) SELECT k, 'id' AS problem, '' AS path FROM m WHERE k % 5 = 0 UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 'unsigned' ELSE 'signature' END, '' FROM m WHERE k % 3 < 2
    UNION ALL SELECT k, CASE WHEN f = 0 THEN 'missing' WHEN f = 1 THEN 'digest' ELSE 'size' END, concat('f', f) FROM m, (SELECT unnest(range(4)) AS f) WHERE k % 4 > 0 AND f < k % 4""",
)
def q_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = bound(spark, sf_dir, "SELECT p_partkey AS k FROM part", part=dealt(spark, sf_dir, "part", "p_partkey"))
    canonical = F.concat(F.lit("manifest "), "k")
    m = k.select("k", canonical.alias("canonical"), content_id("model", F.when(F.col("k") % 5 == 0, F.concat(canonical, F.lit("!"))).otherwise(canonical)).alias("manifest_id"), F.when(F.col("k") % 3 == 0, None).otherwise(F.col("k") % 3 == 2).alias("signature_ok"))
    m = staged(m, "manifests")
    each = m.select("k", "manifest_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("f"))
    files = each.select("manifest_id", F.concat(F.lit("f"), "f").alias("path"), F.concat(F.lit("sha"), "f").alias("sha256"), F.lit(10).alias("size_bytes"))
    broken = F.col("f") < F.col("k") % 4
    found = each.where((F.col("k") % 4 > 0) & ~(broken & (F.col("f") == 0))).select("manifest_id", F.concat(F.lit("f"), "f").alias("path"), F.when(broken & (F.col("f") == 1), "x").otherwise(F.concat(F.lit("sha"), "f")).alias("sha256"), F.when(broken & (F.col("f") > 1), 11).otherwise(10).alias("size_bytes"))
    return manifest_problems(m, files, found).join(m.select("manifest_id", "k").hint("merge"), "manifest_id").select("k", "problem", "path")


@query(
    "certificate_status",
    "SELECT o_orderkey AS certificate_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'incomplete' WHEN o_orderkey % 3 = 0 THEN 'indicators_detected' ELSE 'clear' END AS status FROM orders",
)
def q_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir, "SELECT o_orderkey AS certificate_id FROM orders")
    inventory = c.select("certificate_id", F.explode(F.array(F.struct(F.lit("directory").alias("t"), F.lit(None).cast("string").alias("h")), F.struct(F.lit("text").alias("t"), F.when(F.col("certificate_id") % 11 == 0, None).otherwise("h").alias("h")))).alias("a")).select("certificate_id", F.col("a.t").alias("artifact_type"), F.col("a.h").alias("sha256"))
    return certificate_status(c, c.where("certificate_id % 7 = 0"), c.where("certificate_id % 3 = 0"), inventory)


@query(
    "confidence_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN concat('observed (', p, '% certainty of the rule); says nothing of authorship') WHEN 1 THEN concat('verified by a mechanism (', p, '%)') WHEN 2 THEN concat('measured (', p, '% of a model)') ELSE concat('style signal (', p, '% of a rule); no proof of provenance') END AS confidence_text
    FROM (SELECT *, CAST(l_partkey % 101 AS INT) AS p FROM lineitem)""",
)
def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 101) / 100.0 AS confidence, CASE l_suppkey % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'verified' WHEN 2 THEN 'probabilistic' ELSE 'heuristic' END AS confidence_type FROM lineitem")
    return confidence_text(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "confidence_text")


@query(
    "prov_export",
    """WITH a AS (SELECT concat('r', user_id) AS record_id, concat('act', event_id) AS activity_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('in', event_id % 10) END AS input_id, concat('out', event_id) AS output_id FROM events),
    e AS (SELECT record_id, 'used' AS kind, activity_id AS f, input_id AS t FROM a WHERE input_id IS NOT NULL UNION SELECT record_id, 'wasGeneratedBy', output_id, activity_id FROM a UNION SELECT record_id, 'wasAssociatedWith', activity_id, record_id FROM a),
    x AS (SELECT record_id, string_agg('"' || activity_id || '":{"kind":"' || kind || '"}', ',' ORDER BY activity_id) AS acts, string_agg('"' || output_id || '":{"kind":"output"}', ',' ORDER BY output_id) AS outs FROM a GROUP BY 1), y AS (SELECT record_id, string_agg('{"kind":"' || kind || '","from":"' || f || '","to":"' || t || '"}', ',' ORDER BY kind, f, t) AS edges FROM e GROUP BY 1)
    SELECT record_id, '{"activity":{' || acts || '},"agent":{"' || record_id || '":{"kind":"user"}},"edges":[' || edges || '],"entity":{' || outs || '}}' AS json FROM x JOIN y USING (record_id)""",
)
def q_prov(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bound(spark, sf_dir, "SELECT concat('r', user_id) AS record_id, concat('act', event_id) AS activity_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('in', event_id % 10) END AS input_id, concat('out', event_id) AS output_id, concat('r', user_id) AS agent_id FROM events")
    entities = a.select("record_id", F.col("output_id").alias("entity_id"), F.lit("output").alias("kind"))
    agents = a.select("record_id", "agent_id", F.lit("user").alias("kind")).distinct()
    return prov_json(entities, a, agents)


@query(
    "intoto_statements",
    """WITH s AS (SELECT o_orderkey AS record_id, '{"_type":"https://in-toto.io/Statement/v1","subject":[{"digest":{"sha256":"' || sha256(concat('x', o_orderkey)) || '"},"name":"a' || o_orderkey || '"}],"predicateType":"https://in-toto.io/attestation/link/v0.3","predicate":{"step":"build","n":' || o_custkey || '}}' AS statement FROM orders)
    SELECT record_id, statement, sha256('DSSEv1 28 application/vnd.in-toto+json ' || strlen(statement) || ' ' || statement) AS signed_sha256 FROM s""",
)
def q_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "SELECT o_orderkey AS record_id, concat('a', o_orderkey) AS subject, sha2(concat('x', o_orderkey), 256) AS sha256, named_struct('step', 'build', 'n', o_custkey) AS predicate FROM orders")
    return statements(rows)
