"""Contracts: report schemas and API surfaces compared, and two runs of a scan held against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.plans.fixtures import bound
from loupe.registry import query

#: What two runs of one scan may differ in.
VOLATILE = ("scan_id", "generated_at")


def schema_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, location, breaking) of every difference between two schemas.

    A schema is a table (object, field, type, required, member): a row for each definition (field and member null), for
    each property, and for each member of an enumeration; its version is the member of the object ``schema_version``.
    """
    versions = lambda df: df.where("object = 'schema_version'").select(F.col("member").alias("v"))
    plain = lambda df: df.where("object <> 'schema_version'")
    o, n = plain(old), plain(new)
    defined = lambda df, name: df.select("object").distinct().withColumn(name, F.lit(True))
    objects = defined(o, "was").join(defined(n, "is"), "object", "full_outer")
    out = objects.where("was is null or is is null").select(F.when(F.col("was").isNull(), "added_definition").otherwise("removed_definition").alias("kind"), F.col("object").alias("location"), F.col("is").isNull().alias("breaking"))
    both = objects.where("was and is").select("object")
    fields = lambda df, p: df.where("field is not null").select("object", "field", F.col("type").alias(f"{p}_type"), F.coalesce("required", F.lit(False)).alias(f"{p}_required"), F.lit(True).alias(f"{p}_there"))
    pairs = fields(o, "old").join(fields(n, "new"), ["object", "field"], "full_outer").join(both, "object", "left_semi")
    at = F.concat_ws(".", "object", "field")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("new_there").isNull(), F.struct(F.lit("removed_property").alias("kind"), F.lit(True).alias("breaking"))),
            F.when(F.col("old_there").isNull(), F.struct(F.lit("added_property").alias("kind"), F.col("new_required").alias("breaking"))),
            F.when(F.col("old_there") & F.col("new_there") & ~F.col("old_type").eqNullSafe(F.col("new_type")), F.struct(F.lit("changed_property_type").alias("kind"), F.lit(True).alias("breaking"))),
            F.when(F.col("old_there") & F.col("new_there") & (F.col("old_required") != F.col("new_required")), F.struct(F.lit("changed_property_requirement").alias("kind"), F.lit(True).alias("breaking"))),
        )
    )
    out = out.unionByName(pairs.select(F.explode(kinds).alias("k"), at.alias("location")).select("k.kind", "location", "k.breaking"))
    members = lambda df, name: df.where("member is not null").select("object", "member", F.lit(True).alias(name))
    listed = members(o, "was").join(members(n, "is"), ["object", "member"], "full_outer").join(both, "object", "left_semi").where("was is null or is is null")
    out = out.unionByName(listed.select(F.when(F.col("was").isNull(), "added_enum_member").otherwise("removed_enum_member").alias("kind"), F.concat_ws(":", "object", "member").alias("location"), F.col("is").isNull().alias("breaking")))
    changed = versions(old).join(versions(new).withColumnRenamed("v", "w")).where("NOT (v <=> w)")
    return out.unionByName(changed.select(F.lit("changed_schema_version").alias("kind"), F.lit("schema_version").alias("location"), F.lit(False).alias("breaking")))


def surface_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name, breaking) between two API surfaces: (name, member, signature, has_default), a row for each parameter
    or attribute of a public name, and one without a member for the name itself.

    What goes, or becomes required, breaks a caller; what is added with a default doesn't.
    """
    a = old.select("name", "member", F.col("signature").alias("was"), F.lit(True).alias("old"))
    b = new.select("name", "member", F.col("signature").alias("is"), F.coalesce("has_default", F.lit(False)).alias("optional"), F.lit(True).alias("new"))
    joined = a.join(b, a["name"].eqNullSafe(b["name"]) & a["member"].eqNullSafe(b["member"]), "full_outer").select(F.coalesce(a["name"], b["name"]).alias("name"), F.coalesce(a["member"], b["member"]).alias("member"), "was", "is", "optional", "old", "new")
    kept = a.select("name").distinct().join(b.select("name").distinct(), "name", "left_semi").withColumn("kept", F.lit(True))
    joined = joined.join(kept, "name", "left")
    whole = F.col("member").isNull()
    kind = (
        F.when(whole & F.col("new").isNull(), "removed_name")
        .when(whole & F.col("old").isNull(), "added_name")
        .when(F.col("kept").isNull(), None)  # its whole name came or went
        .when(F.col("new").isNull(), "removed_member")
        .when(F.col("old").isNull(), "added_member")
        .when(~F.col("was").eqNullSafe(F.col("is")), "changed_signature")
    )
    breaking = kind.isin("removed_name", "removed_member", "changed_signature") | ((kind == "added_member") & ~F.col("optional"))
    return joined.select(kind.alias("kind"), F.concat_ws(".", "name", "member").alias("name"), breaking.alias("breaking")).where("kind is not null")


def fingerprint(report: DataFrame, key: str) -> DataFrame:
    """(field, digest) of a report's table: each column's values in the order of ``key``, whatever their rows' order.

    Columns are digested as sums of row digests, so no column is gathered; volatile ones are left out.
    """
    columns = sorted(c for c in report.columns if c not in VOLATILE)

    def folded(c: str) -> Column:
        rows = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.to_json(F.struct(F.col(c))), F.lit(""))), 256)
        halves = (F.sum(F.conv(F.substr(rows, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)")) for i in range(4))
        return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(h.cast("string") for h in halves)), 256)

    one = report.agg(*(folded(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("digest")) for c in columns))).alias("f")).select("f.*")


def first_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: whether two fingerprints are the same, and the first field, by name, in which they aren't."""
    joined = first.withColumnRenamed("digest", "was").join(second.withColumnRenamed("digest", "is"), "field", "full_outer")
    differs = F.min(F.when(~F.col("was").eqNullSafe(F.col("is")), F.col("field")))
    return joined.agg(differs.isNull().alias("identical"), differs.alias("first_difference"))


_SCHEMA_ROWS = """SELECT concat('o', p_partkey % 20) AS object, CAST(NULL AS STRING) AS field, CAST(NULL AS STRING) AS type, CAST(NULL AS BOOLEAN) AS required, CAST(NULL AS STRING) AS member FROM part WHERE p_partkey % 20 <> {gone} GROUP BY 1
UNION ALL SELECT concat('o', p_partkey % 20), concat('f', p_partkey), {t}, p_partkey % {r} = 0, NULL FROM part WHERE p_partkey % {m} <> 0 AND p_partkey % 20 <> {gone} UNION ALL SELECT concat('o', p_partkey % 20), NULL, NULL, NULL, concat('m', p_size) FROM part WHERE p_partkey % 20 < 3 AND p_partkey % 20 <> {gone} AND p_size % {e} <> 0 GROUP BY p_partkey % 20, p_size
UNION ALL SELECT 'schema_version', NULL, NULL, NULL, '{v}'"""
_OLD = _SCHEMA_ROWS.format(gone=19, t="p_type", r=4, m=6, e=5, v="0.1")
_NEW = _SCHEMA_ROWS.format(gone=18, t="CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE p_type END", r=8, m=10, e=7, v="0.2")


@query(
    "schema_differences",
    f"""WITH o AS ({_OLD}), n AS ({_NEW}), od AS (SELECT DISTINCT object FROM o WHERE object <> 'schema_version'), nd AS (SELECT DISTINCT object FROM n WHERE object <> 'schema_version'), b AS (SELECT object FROM od INTERSECT SELECT object FROM nd),
    p AS (SELECT coalesce(x.object, y.object) AS object, coalesce(x.field, y.field) AS field, x.type AS ot, y.type AS nt, x.required AS oreq, y.required AS nreq, x.field IS NOT NULL AS old, y.field IS NOT NULL AS new FROM (SELECT * FROM o WHERE field IS NOT NULL) AS x FULL JOIN (SELECT * FROM n WHERE field IS NOT NULL) AS y ON x.object = y.object AND x.field = y.field),
    q AS (SELECT *, concat(object, '.', field) AS location FROM p WHERE object IN (SELECT object FROM b)), om AS (SELECT object, member FROM o WHERE member IS NOT NULL AND object IN (SELECT object FROM b)), nm AS (SELECT object, member FROM n WHERE member IS NOT NULL AND object IN (SELECT object FROM b))
    SELECT 'removed_definition' AS kind, object AS location, true AS breaking FROM od WHERE object NOT IN (SELECT object FROM nd) UNION ALL SELECT 'added_definition', object, false FROM nd WHERE object NOT IN (SELECT object FROM od)
    UNION ALL SELECT 'removed_property', location, true FROM q WHERE old AND NOT new UNION ALL SELECT 'added_property', location, nreq FROM q WHERE new AND NOT old UNION ALL SELECT 'changed_property_type', location, true FROM q WHERE old AND new AND ot <> nt UNION ALL SELECT 'changed_property_requirement', location, true FROM q WHERE old AND new AND oreq <> nreq
    UNION ALL SELECT 'removed_enum_member', concat(object, ':', member), true FROM (SELECT * FROM om EXCEPT SELECT * FROM nm) UNION ALL SELECT 'added_enum_member', concat(object, ':', member), false FROM (SELECT * FROM nm EXCEPT SELECT * FROM om) UNION ALL SELECT 'changed_schema_version', 'schema_version', false""",
)
def q_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_differences(bound(spark, sf_dir, _OLD), bound(spark, sf_dir, _NEW))


_API = """SELECT concat('n', p_partkey % 50) AS name, CAST(NULL AS STRING) AS member, {s} AS signature, CAST(NULL AS BOOLEAN) AS has_default FROM part WHERE p_partkey % 50 <> {gone} GROUP BY p_partkey % 50 UNION ALL SELECT concat('n', p_partkey % 50), concat('p', p_partkey), {t}, p_size % 2 = 0 FROM part WHERE p_partkey % {m} <> 0 AND p_partkey % 50 <> {gone}"""
_API_OLD = _API.format(s="'f'", gone=49, t="p_type", m=7)
_API_NEW = _API.format(s="CASE WHEN p_partkey % 50 = 3 THEN 'g' ELSE 'f' END", gone=48, t="CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE p_type END", m=11)


@query(
    "api_differences",
    f"""WITH o AS ({_API_OLD}), n AS ({_API_NEW}), j AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.member, n.member) AS member, o.signature AS was, n.signature AS is_, n.has_default AS optional, o.name IS NOT NULL AS old, n.name IS NOT NULL AS new FROM o FULL JOIN n ON o.name = n.name AND o.member IS NOT DISTINCT FROM n.member),
    k AS (SELECT *, CASE WHEN member IS NULL AND NOT new THEN 'removed_name' WHEN member IS NULL AND NOT old THEN 'added_name' WHEN name IN ('n48', 'n49') THEN NULL WHEN NOT new THEN 'removed_member' WHEN NOT old THEN 'added_member' WHEN was <> is_ THEN 'changed_signature' END AS kind FROM j)
    SELECT kind, concat_ws('.', name, member) AS name, kind IN ('removed_name', 'removed_member', 'changed_signature') OR (kind = 'added_member' AND NOT coalesce(optional, false)) AS breaking FROM k WHERE kind IS NOT NULL""",
)
def q_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface_differences(bound(spark, sf_dir, _API_OLD), bound(spark, sf_dir, _API_NEW))


@query("scan_determinism", "SELECT true AS identical, CAST(NULL AS VARCHAR) AS first_difference, 'again' AS run UNION ALL SELECT true, NULL, 'in parallel' UNION ALL SELECT false, 'severity', 'altered'")
def q_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan run twice, in one task and in many, and held against one whose severities were altered."""
    from loupe.detection.engine import findings, scan_rows
    from loupe.functions.spreading import spread
    from loupe.functions.staging import staged
    from loupe.sources.artifacts import planted

    texts = planted(spark, sf_dir).select("artifact_path", F.lit("text").alias("artifact_type"), "text")
    told = lambda found: fingerprint(found.withColumn("scan_id", F.uuid()), "id")
    scanned = staged(findings(scan_rows(texts)), "findings")  # held against both other runs, and altered
    first = staged(told(scanned), "fingerprint")
    altered = fingerprint(scanned.withColumn("severity", F.lit("critical")), "id")
    runs = (("again", told(findings(scan_rows(texts)))), ("in parallel", told(findings(scan_rows(spread(texts, "artifact_path"))))), ("altered", altered))
    return reduce(DataFrame.unionByName, (first_difference(first, other).withColumn("run", F.lit(name)) for name, other in runs))
