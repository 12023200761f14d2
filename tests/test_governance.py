"""Policies, admission, ledgers, rotations, cleaning, discovery and streams where they used to go wrong."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loupe.functions import joins
from loupe.operators import apply, cache, corpus, media_clean, policy, stats, trust
from loupe.plans import made
from loupe.sources import discovery, loaders


def test_globs_are_globs(spark):
    import fnmatch

    globs = ["src/my_file.txt", "src/my[XY]file.txt", "a*", "a?c", "[!a]*", "50%", "a.b", "[[]x]", "src\\a*", "(a|b)+$", "x[", "[]a]z", "[a-c]q", "^a", "[^a]b"]
    paths = ["src/my_file.txt", "src/myXfile.txt", "abc", "a\nc", "bcd", "50%", "axb", "a.b", "[x]", "src/ab", "src\\ab", "(a|b)+$", "x[", "]z", "az", "bq", "^a", "^b", "ab"]
    rows = spark.createDataFrame([(g, p) for g in globs for p in paths], "g string, p string")
    got = rows.select("g", "p", F.rlike(F.replace("p", F.lit("\\"), F.lit("/")), joins.glob_regex(F.col("g"))).alias("m")).collect()
    assert [(r["g"], r["p"]) for r in got if r["m"] != fnmatch.fnmatchcase(r["p"].replace("\\", "/"), r["g"].replace("\\", "/"))] == []


def test_selectors_ask_for_providers_ids_and_tags(spark):
    found = spark.createDataFrame([("1", "a", "c", "d", "low", "p", ["x", "y"]), ("2", "a", "c", "d", "low", None, None)], "id string, artifact_path string, category string, detector_id string, severity string, provider string, tags array<string>")
    said = [("s1", "p", None, None, None), ("s2", None, ["x"], None, None), ("s3", None, ["x", "z"], None, None), ("s4", None, None, "2", None), ("s5", None, None, None, "b*")]
    chosen = spark.createDataFrame(said, "selector_id string, provider string, tags_all array<string>, finding_id string, path_glob string")
    got = {(r["id"], r["selector_id"]) for r in policy.matching_selectors(found, chosen).select("f.id", "s.selector_id").collect()}
    assert got == {("1", "s1"), ("1", "s2"), ("2", "s4")}
    with pytest.raises(ValueError):
        joins.bounded(spark.range(11), 10, "things")


def test_conflicting_exceptions_are_told_and_refused(spark):
    found = spark.createDataFrame([("1", "a", "security_issue", "d", "low")], "id string, artifact_path string, category string, detector_id string, severity string")
    rows = [("e1", "exception", "remove", 9), ("e2", "exception", "review", 9), ("e3", "exception", "ignore", 1)]
    chosen = spark.createDataFrame(rows, "selector_id string, kind string, action string, expires_at int").withColumn("category", F.lit("security_issue")).withColumn("path_glob", F.lit(None).cast("string"))
    decided = policy.bundle_decisions(found, chosen, found.limit(0), "strict", 5)
    assert [tuple(r) for r in decided.collect()] == [("1", "conflict", None, "e1,e2")]
    with pytest.raises(PySparkException):
        policy.refuse_conflicts(decided).collect()
    audit = policy.bundle_audit(found, chosen, found.limit(0), "strict", 5).collect()
    assert [(r["rule_id"], r["expired"]) for r in audit] == [("e3", True)]
    calm = policy.bundle_decisions(found, chosen.where("selector_id = 'e1'"), found.limit(0), "strict", 5)
    assert policy.refuse_conflicts(calm).first()["action"] == "remove"


def test_what_is_not_known_admits_nobody(spark):
    now = datetime(2000, 1, 1)
    fine = ("s", "sha", "legal", "train", "src", now - timedelta(days=1), "c", True, 0)
    names = "sample_id string, content_sha256 string, domain string, split string, source string, collected_at timestamp, consent_id string, permits_training boolean, ord long"
    consents = spark.createDataFrame([("c", now - timedelta(days=30), None, "active", "training"), ("d", now - timedelta(days=30), None, "active", None), ("e", None, None, "active", "training")], "consent_id string, granted_at timestamp, expires_at timestamp, status string, purpose string")
    rows = [fine] + [tuple(None if j == i else v for j, v in enumerate(fine)) for i in (2, 3, 4, 5, 6, 7)] + [(*fine[:6], c, *fine[7:]) for c in ("d", "e")]
    samples = spark.createDataFrame([(f"s{i}", *r[1:]) for i, r in enumerate(rows)], names)
    got = {r["sample_id"]: r["refusals"] for r in corpus.refusals(samples, consents, samples.where("sample_id = 's0'")).collect()}
    assert got == {"s0": "", "s1": "domain", "s2": "other_split", "s3": "holdout_source", "s4": "retention", "s5": "no_consent", "s6": "license", "s7": "not_covered", "s8": "not_covered"}
    uses = samples.limit(1).withColumn("permits", F.array(F.lit("evaluation")))
    assert corpus.refusals(uses, consents, samples.limit(0)).first()["refusals"] == "license"


def test_a_chain_covers_every_entry_before(spark):
    entries = spark.createDataFrame([(log, i, f"p{i}", "k", 'say "x"\n') for log in (1, 2) for i in range(300)], "log_id long, event_id long, payload string, kind string, subject_id string").repartition(5)
    whole = trust.chained(entries).cache()
    assert trust.ledger_problems(whole).count() == 0 and whole.where("previous_hash is null").count() == 2
    again = trust.entry_digest(F.col("previous_hash"), F.sha2("payload", 256), F.col("sequence"), F.lit(""), F.col("kind"), F.col("subject_id"))
    hit = (F.col("log_id") == 1) & (F.col("sequence") == 150)
    edited = whole.withColumn("payload", F.when(hit, "forged").otherwise(F.col("payload"))).withColumn("entry_hash", F.when(hit, again).otherwise(F.col("entry_hash")))
    assert [tuple(r) for r in trust.ledger_problems(edited).collect()] == [(1, 151, "unlinked")]
    assert trust.untrusted_entries(edited).count() == 150
    moved = trust.chained(entries.withColumn("payload", F.when(F.col("event_id") == 0, "other").otherwise(F.col("payload"))))
    heads = lambda df: {tuple(r) for r in df.select("log_id", "sequence", "entry_hash").collect()}
    assert not heads(whole) & heads(moved)
    assert trust.chained(entries.limit(0)).count() == 0


def test_long_rotations(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("t1", "x"), ("t2", "t1"), ("gone", "nobody"), ("self", "self")]
    got = {r["anchor_id"]: r["depth"] for r in trust.rotation_chains(spark.createDataFrame(rows, "anchor_id string, replaces string")).collect()}
    assert all(got[f"a{i}"] == i for i in range(300))
    assert {k: got[k] for k in ("x", "y", "z", "t1", "t2", "gone", "self")} == {"x": 2, "y": 2, "z": 2, "t1": 3, "t2": 4, "gone": 0, "self": 0}


def test_evaluations_that_are_too_small(spark):
    rows = [(f"s{i}", i % 4 == 0, 0.1, "d", "g") for i in range(20)]
    e = stats.evaluation(spark.createDataFrame(rows, "sample_id string, is_positive boolean, score double, domain string, subgroup string")).first()
    assert e["problems"] == "few_negatives,undersized,few_scored" and e["undersized"] == 2


def test_untouched_entries_go_first(spark):
    entries = spark.createDataFrame([("k1", 10, 1, True, True), ("k2", 10, 9, True, False), ("k3", 10, 2, False, True)], "key string, size_bytes long, generation int, reachable boolean, touched boolean")
    assert [sorted(r["key"] for r in cache.eviction(entries, n).collect()) for n in (25, 15, 5)] == [["k3"], ["k2", "k3"], ["k1", "k2", "k3"]]
    assert cache.pruned(entries).count() == 0
    assert sorted(r["key"] for r in cache.pruned(entries, older_than=2, to_fit=10).collect()) == ["k1", "k3"]


def test_digests_do_not_depend_on_order(spark):
    hashes = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    a, b = joins.folded_digest(hashes).first()[0], joins.folded_digest(hashes.repartition(7)).first()[0]
    assert a == b != joins.folded_digest(hashes.limit(499)).first()[0]


def test_spans_are_verified_before_they_are_cut():
    text = "ab\ncd\nef"
    assert apply.cut(text, [(3, 6, "cd\n", "x"), (4, 5, "d", "y")]) == ("applied", "ab\nef", ["x", "y"])
    assert apply.cut(text, [(3, 6, "XX\n", "x")])[0] == "changed"
    assert apply.cut(text, [(0, 4, "ab\nc", "x"), (3, 6, "cd\n", "y")])[0] == "overlap"
    assert apply.cut(text, [(5, 99, "", "x")])[0] == "invalid_span"


def test_cleaned_files_keep_what_carries_their_content():
    for make in made._MADE:
        b = make(35, "Anna")
        status, clean, before, after, gone = media_clean.cleaned_file(b)
        if b.startswith(b"%PDF"):
            assert status == "unsupported"
            continue
        assert status == "cleaned" and before == after and gone and b"Anna" not in clean
        assert media_clean.cleaned_file(clean)[0] in ("cleaned", "unsupported")
    photo = media_clean.cleaned_file(made._jpeg(3, "Anna"))[1]
    assert b"\x12\x01\x03\x00" in photo and b"hand" not in photo
    marked = made._zip(("docProps/core.xml", "<c><creator>c2pa</creator></c>"), ("word/document.xml", "<d/>"))
    assert media_clean.cleaned_file(marked)[0] == "protected"
    assert media_clean.cleaned_file(b"\xff\xd8\xff\xe1\0\x04ab")[0] == "refused"
    svg = b'<svg a="1>2" inkscape:x="<"><!-- exported by x --><g inkscape:y = \'q\'>t</g></svg>'.replace(b'"<"', b'"&lt;"').replace(b"<svg ", b'<svg xmlns:inkscape="i" ')
    assert media_clean.cleaned_file(svg)[1] == b'<svg xmlns:inkscape="i" a="1>2"><g>t</g></svg>'


def test_ignore_patterns(spark):
    rules = discovery.ignore_rules(spark.createDataFrame([("", "/top.txt\n**/deep/*.c\nbuild/\n!keep.log\n*.log\n\\#x\n# y\na/**/z\n"), ("sub/", "!*.log\n")], "scope string, text string"))
    paths = ["top.txt", "sub/top.txt", "x/deep/a.c", "deep/a.c", "x/deep/y/a.c", "build/a", "sub/build/b", "build", "keep.log", "sub/a.log", "sub/t/b.log", "#x", "y", "a/z", "a/b/c/z", ".git/x", "m.pyc"]
    got = {r["path"] for r in discovery.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).where("ignored").collect()}
    assert got == {"top.txt", "x/deep/a.c", "deep/a.c", "build/a", "sub/build/b", "keep.log", "#x", "a/z", "a/b/c/z", ".git/x", "m.pyc"}


def test_walks_meet_files_before_folders(spark, tmp_path):
    frame = spark.createDataFrame([(p,) for p in ("b/x", "a/Z", "a/y", "c", "B", "a/b/c")], "path string")
    kept, cut = discovery.discovered(frame, discovery.ignore_rules(spark.createDataFrame([("", "")], "scope string, text string")), 5)
    assert [r["path"] for r in kept.orderBy("position").collect()] == ["B", "c", "a/y", "a/Z", "a/b/c"] and cut.count() == 1
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    (tmp_path / "small.txt").write_bytes(b"x")
    found = discovery.files(spark, str(tmp_path), 50)
    assert {r["too_large"]: r["content"] is None for r in found.collect()} == {True: True, False: False}
    assert discovery.oversize(found).first()["code"] == "artifact_too_large"


def test_loads_fail_on_what_they_do_not_know(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"certificate_id": "a", "revoked_at": "soon"}\n')
    with pytest.raises(Exception, match="FAILED_READ_FILE|CANNOT_PARSE_JSON"):
        loaders.load(spark, "revocations", str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.json").write_text('{"selector_id": "abc", "kind": "suppression", "category": "x", "action": "ignore", "approved_by": "me", "expires_at": 5}\n')
    assert loaders.load_controls(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "d.json").write_text('{"selector_id": "abc", "kind": "suppression", "action": "ignore", "approved_by": "me", "expires_at": 5}\n')
    with pytest.raises(Exception, match="a control isn't one"):
        loaders.load_controls(spark, str(tmp_path / "d.json")).collect()
    assert loaders.policy_from_yaml(loaders.policy_yaml("strict"))[1] == "review"
    for bad in ("policy: p\nrules: {c2pa_provenance: remove}", "policy: p\ndefault_action: remove", "policy: p\nrules: {a: explode}", "[]"):
        with pytest.raises(ValueError):
            loaders.policy_from_yaml(bad)


def test_bindings_in_buckets_and_by_broadcast_agree(spark):
    uses = spark.createDataFrame([(i, i * 7 % 101) for i in range(60)], "use_id long, moment long")
    bindings = spark.createDataFrame([(f"b{i:02}", i * 3, None if i % 5 == 0 else i * 3 + 11) for i in range(30)], "anchor_id string, not_before long, not_after long")
    a, b = ({tuple(r) for r in trust.binding_in_force(uses, bindings, n).collect()} for n in (1000, 0))
    assert a == b and len(a) == 60
    assert trust.binding_in_force(uses.limit(0), bindings, 0).count() == 0


def test_expiry_alarms(spark, tmp_path):
    from loupe.streaming.scan import expiry_alarms, run_once

    at = datetime(2024, 1, 1)
    schema = "consent_id string, ts timestamp, expires_at timestamp"
    first = [("a", at, at + timedelta(hours=5)), ("b", at, at + timedelta(days=9)), ("c", at, None), ("e", at, at + timedelta(hours=6))]
    later = [("d", at + timedelta(days=2), at + timedelta(days=20)), ("e", at + timedelta(minutes=5), at + timedelta(days=15))]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [r["consent_id"] for r in run_once(expiry_alarms(stream), "append").collect()] == ["a"]


def test_plans_that_may_not_be_applied(spark):
    found = spark.createDataFrame([("1", "a", "document_metadata"), ("2", "b", "c2pa_provenance"), ("3", "b", "document_metadata"), ("4", "c", "stylistic_signal")], "id string, artifact_path string, category string")
    plan = spark.createDataFrame([("1", "a"), ("1", "a"), ("3", "b"), ("4", "x"), ("9", "a")], "id string, artifact_path string").withColumn("disposition", F.lit("planned"))
    content = spark.createDataFrame([("a", 1), ("b", 1)], "artifact_path string, content int")
    after = content.withColumn("content", F.when(F.col("artifact_path") == "a", 2).otherwise(1))
    told = spark.createDataFrame([("z", "high"), ("y", "info")], "artifact_path string, severity string")
    got = {tuple(r) for r in policy.plan_violations(plan, found, content, after, told, "privacy", "client-delivery").collect()}
    assert got == {("policy", "privacy"), ("incomplete", "z"), ("content", "a"), ("missing", "9"), ("mismatched", "4"), ("duplicate", "1"), ("action", "4"), ("protected", "b")}
    fine = plan.where("id = '1'").distinct()
    assert policy.plan_violations(fine, found, content, content, told.where("severity = 'info'"), "client-delivery", "client-delivery").count() == 0
