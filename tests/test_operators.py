"""Operators on small inputs whose results are known."""

import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loupe.operators import cache, clean, corpus, detect_text, measure, policy, scan, stats, structure, style, trust
from loupe.sources import files


def texts(spark, *values):
    return spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)], "artifact_path string, text string")


def test_zero_width_space_is_located(spark):
    (r,) = detect_text.unicode_findings(texts(spark, "first\nab​cd")).collect()
    assert (r["category"], r["safety_class"], r["line"], r["col"], r["removable"]) == ("invisible_unicode", "invisible", 2, 3, True)


def test_joiners_and_selectors_are_language(spark):
    rows = detect_text.unicode_findings(texts(spark, "a‍b️c‌d", "﻿x", "x﻿", "\u0007", "　", "\U000e0001")).collect()
    assert sorted((r["artifact_path"], r["safety_class"], r["removable"]) for r in rows) == [("t0", "language_dependent", False)] * 3 + [("t1", "safe", False), ("t2", "invisible", False), ("t3", "control", False), ("t4", "typographic", False), ("t5", "suspicious", False)]


def test_long_texts_without_traces_are_quick(spark):
    began = datetime.now()
    assert detect_text.unicode_findings(texts(spark, "a" * 300_000 + "​" + "b" * 300_000, None, "")).count() == 1
    assert detect_text.attribution_findings(texts(spark, "created " * 60_000)).count() == 0
    assert datetime.now() - began < timedelta(seconds=60)


def test_attributions(spark):
    rows = detect_text.attribution_findings(
        texts(spark, "x\nGenerated by ChatGPT\nhttps://claude.ai/chat/abc\n", "generated by the protobuf compiler", "This was written by Claude today", "Co-Authored-By: Claude X <a@b.c>")
    ).collect()
    assert {(r["artifact_path"], r["provider"], r["standalone"]) for r in rows} == {("t0", "openai", True), ("t0", "anthropic", True), ("t2", "anthropic", False), ("t3", "anthropic", True)}


PAGE = '<html><head><meta charset="u"><link href="x.css"></head><body><div id="a" class="x y" style="c"><div class="z"><p>hi</p></div></div><img src="data:1"><br></body></html>'


def shape(text):
    (row,) = structure.topology_of(text)
    return dict(zip((*structure.TOPOLOGY, "truncated_by"), row))


def test_topology():
    s = shape(PAGE)
    assert (s["elements"], s["void_elements"], s["distinct_ids"], s["class_tokens"], s["inline_styles"], s["external_references"], s["unclosed_elements"]) == (10, 4, 1, 3, 1, 1, 0)
    assert shape("<div><span>text")["unclosed_elements"] == 2
    assert shape("<div>text</div></span>")["mismatched_closes"] == 1
    assert shape("<div><div><p>x</p></div></div>")["wrapper_only_elements"] == 2
    assert shape("")["elements"] == 0
    assert shape("<a>" * 2000)["truncated_by"] == "depth"


def test_html_findings(spark):
    page = '<meta name="Generator" content="M"><p hidden>a</p><p style="opacity: 0">b</p><img src=" DATA:x"><script></script><!-- created with Gemini -->'
    found = structure.html_findings(structure.html_events(texts(spark, page, None))).collect()
    assert sorted((r["category"], r["detail"]) for r in found) == sorted([("generator_metadata", "M"), ("hidden_element", "hidden attribute"), ("hidden_element", "zero opacity"), ("structural_signal", "data uri"), ("security_issue", "script"), ("generated_comment", "google")])


def test_comments():
    assert [c for c, _, _ in structure.comment_spans("x = '# no' # yes\n", "a.py")] == ["# yes"]
    assert [(c, line) for c, line, _ in structure.comment_spans("a /* b\n*/ // c\n<!-- d", "a.js")] == [("/* b\n*/", 1), ("// c", 2)]
    assert list(structure.comment_spans("<!-- " * 50_000, "a.js")) == []


def test_deep_rules_of_style_sheets_are_counted(spark):
    nested = lambda n: "@media x { " * n + ".a { display: none } " + "} " * n
    rows = structure.stylesheet_features(texts(spark, nested(40), nested(4000) + ".b { x: y }", ".c { visibility: hidden } " + nested(5000))).orderBy("artifact_path").collect()
    assert [(r["rules"], r["hiding_rules"], r["truncated_by"], r["error"]) for r in rows] == [(1, 1, None, None), (2, 1, None, None), (1, 1, "depth", None)]


def test_containers(spark):
    rows = [(k, bytearray(v)) for k, v in structure.sample_files().items()] + [("empty", bytearray(b"")), ("cut.png", bytearray(b"\x89PNG\r\n\x1a\n\0"))]
    entries = structure.container_metadata(spark.createDataFrame(rows, "artifact_path string, content binary"))
    got = {(r["artifact_path"], r["field"], r["value"]) for r in entries.collect()}
    assert {("a.png", "Software", "generated by ChatGPT"), ("a.wav", "artist", "Anna"), ("a.flac", "artist", "Anna"), ("a.mp3", "TPE1", "Anna"), ("a.pdf", "Author", "Anna"), ("a.mp4", "©nam", "A title!"), ("a.jpg", "comment", "hello"), ("a.docx", "docProps/core.xml:property:creator", "Anna")} <= got
    assert entries.where("error is not null").select("artifact_path").first()[0] == "broken.pdf"
    found = structure.metadata_findings(entries)
    assert found.where("artifact_path = 'a.png'").first()["provider"] == "openai"


def test_containers_of_every_kind_tell_their_metadata(spark):
    rows = [(k, bytearray(v)) for k, v in structure.sample_files().items()] + [("what.bin", bytearray(b"unknown"))]
    entries = structure.container_metadata(spark.createDataFrame(rows, "artifact_path string, content binary"))
    got = {(r["artifact_path"], r["field"], r["value"]) for r in entries.where("error is null").collect()}
    assert {("items.m4a", "com.apple.quicktime.software", "generated by ChatGPT"), ("items.m4a", "artist", "Anna"), ("items.m4a", "xmp", "<x>Anna</x>")} <= got
    assert {("a.webm", "document_type", "webm"), ("a.webm", "writing_application", "Maker"), ("a.webm", "artist", "Anna")} <= got
    assert {("photo.jpg", "Artist", "Anna"), ("photo.jpg", "Orientation", "1"), ("photo.jpg", "UserComment", "generated by ChatGPT")} <= got
    assert {("old.mp3", "TPE1", "Anna"), ("old.mp3", "COMM", "generated by ChatGPT"), ("note.mp3", "COMM", "by: generated by ChatGPT")} <= got
    assert {r["artifact_path"] for r in entries.where("error is not null").collect()} == {"broken.pdf", "what.bin"}
    found = {(r["artifact_path"], r["field"]): r for r in structure.metadata_findings(entries).collect()}
    assert found["items.m4a", "com.apple.quicktime.software"]["category"] == "generator_metadata" and found["photo.jpg", "Artist"]["category"] == "personal_metadata"
    assert [k[1] for k, r in found.items() if k[0] == "photo.jpg" and not r["removable"]] == ["Orientation"]
    assert {k[0] for k, r in found.items() if r["provider"] == "openai"} == {"a.png", "items.m4a", "photo.jpg", "old.mp3", "note.mp3"}
    deep = b"x"
    for _ in range(20):
        deep = struct.pack(">I4s", 8 + len(deep), b"udta") + deep
    with pytest.raises(OverflowError):
        list(structure.metadata_of(struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + deep))


def test_long_metadata_is_read_whole_or_refused(monkeypatch):
    import zlib

    def png(text):
        body = b"Comment\0\0" + zlib.compress(text)
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(body)) + b"zTXt" + body + b"\0" * 4

    text = b"x" * 400_000 + b"generated by ChatGPT"
    assert [v for _, _, v, _ in structure.metadata_of(png(text))] == [text.decode()]
    with pytest.raises(ValueError):
        list(structure.metadata_of(png(text)[:-200]))
    vorbis = struct.pack("<I", 0) + struct.pack("<I", 10_001) + b"".join(struct.pack("<I", len(c)) + c for c in [b"a=b"] * 10_000 + [b"ARTIST=Anna"])
    flac = b"fLaC\x84" + len(vorbis).to_bytes(3) + vorbis
    assert [(f, v) for _, f, v, _ in structure.metadata_of(flac)][-1] == ("artist", "Anna")
    monkeypatch.setattr(structure, "MAX_INFLATED", 300_000)
    monkeypatch.setattr(structure, "MAX_EVENTS", 10_000)
    for content in (png(text), flac):
        with pytest.raises(OverflowError):
            list(structure.metadata_of(content))


def test_hostile_packages_are_refused():
    import io
    import zipfile

    def package(*entries):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in entries:
                z.writestr(name, data)
        return held.getvalue()

    with pytest.raises(OverflowError):
        list(structure.package_of(package(("a", "0" * 5_000_000))))
    with pytest.raises(ValueError):
        list(structure.package_of(package(("../a", "x"))))
    with pytest.raises(ValueError):
        list(structure.package_of(package(("docProps/core.xml", "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"))))
    with pytest.raises(ValueError):
        list(structure.metadata_of(struct.pack(">I4s", 4, b"ftyp") + b"ftyp"))


def test_logs_of_all_repositories_are_parsed(spark, tmp_path):
    ids = [None, *range(700, 760), *range(1000, 2000), 5000]
    spark.createDataFrame([(i, 0) for i in ids], "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = files.q_logs(spark, str(tmp_path)).collect()
    assert {r["commit_hash"] for r in rows} == {f"h{-1 if i is None else i}" for i in ids} and len(rows) == len(ids)
    assert [r["position"] for r in sorted(rows, key=lambda r: r["commit_hash"]) if r["repository"] == 1] == list(range(60))
    logs = spark.createDataFrame([("a", "h\0A\0e\0m\x1e" * 700), ("b", "h\0A\0e\0m\x1e" * 500)], "repository string, log string")
    got = files.parsed_log(logs).groupBy("repository").agg(F.count(F.lit(1)).alias("n"), F.max("over_limit").alias("over")).collect()
    assert {tuple(r) for r in got} == {("a", 501, True), ("b", 500, False)}


def test_a_shift_in_any_dimension_counts(spark, tmp_path):
    vector = lambda i: [0.1 * (i % 3 - 1 + k % 2) for k in range(64)]
    rows = [(i, vector(i), 1) for i in range(1, 400) if i % 10 != 7] + [(7, vector(1), 1), (17, [*vector(2)[:63], 90.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["doc_id"]: r["band"] for r in style.q_compare_all(spark, str(tmp_path)).collect()} == {7: "within_variation", 17: "marked"}
    assert style.q_baseline_all(spark, str(tmp_path)).count() == 64


def test_stylometry(spark):
    text = "# Title\n\nOne two; three four.\n\n- item a\n- item b\n"
    r = measure.stylometry(texts(spark, text, "")).where("artifact_path = 't0'").first()
    assert (r["word_count"], r["heading_count"], r["list_item_count"]) == (9, 1, 2) and r["semicolon_rate"] > 0
    again = "the end of all things. " * 3
    assert measure.stylometry(texts(spark, again)).first()["repeated_fourgrams"] == 2
    assert measure.stylometry(texts(spark, "")).first()["word_count"] == 0


def predictions(spark, groups):
    rows, k = [], 0
    for domain, subgroup, negatives, positives, fp, abstained in groups:
        for positive, n in ((False, negatives), (True, positives)):
            for i in range(n):
                wrong = not positive and i < fp
                rows.append((f"s{k}", positive, 0.9 if positive or wrong else 0.1, domain, subgroup))
                k += 1
        for _ in range(abstained):
            rows.append((f"s{k}", False, None, domain, subgroup))
            k += 1
    return spark.createDataFrame(rows, "sample_id string, is_positive boolean, score double, domain string, subgroup string")


def test_rates_and_intervals(spark):
    p = predictions(spark, [("a", "x", 100, 100, 7, 0), ("b", "tiny", 4, 4, 4, 50)])
    rows = {(r["kind"], r["name"]): r for r in stats.with_rates(stats.group_results(p)).collect()}
    assert rows[("domain", "a")]["fp_rate"] == 0.07
    assert not rows[("subgroup", "tiny")]["sufficient"]
    e = stats.evaluation(p).first()
    assert e["worst_subgroup"] == "x" and e["undersized"] == 2 and e["domain_spread"] is None and "coverage" in e["problems"]
    nothing = spark.createDataFrame([(0, 0), (0, 30), (40, 40)], "k long, n long").select(*(c.alias(n) for c, n in zip(stats.wilson(F.col("k"), F.col("n")), ("low", "high")))).collect()
    assert (nothing[0]["low"], nothing[0]["high"]) == (None, None)
    assert nothing[1]["low"] == 0 and nothing[1]["high"] > 0 and nothing[2]["low"] < 1


def test_regression_gate(spark):
    good, bad = predictions(spark, [("a", "x", 100, 100, 1, 0)]), predictions(spark, [("a", "x", 100, 100, 9, 0)])
    r = stats.release_regression(stats.evaluation(good), stats.evaluation(bad)).first()
    assert not r["passed"] and "false_positives" in r["reasons"] and "worst_subgroup" in r["reasons"]
    assert stats.release_regression(stats.evaluation(good), stats.evaluation(good)).first()["passed"]


def test_batch_admission(spark):
    now = datetime(2000, 1, 1)
    rows = [(f"s{i}", sha, "legal", split, "src", now - timedelta(days=1), "c1", True, i) for i, (sha, split) in enumerate([("a", "train"), ("a", "test"), ("a", "train"), ("b", "test")])]
    samples = spark.createDataFrame(rows, "sample_id string, content_sha256 string, domain string, split string, source string, collected_at timestamp, consent_id string, permits_training boolean, ord long")
    consents = spark.createDataFrame([("c1", now - timedelta(days=30), None, "active", "training")], "consent_id string, granted_at timestamp, expires_at timestamp, status string, purpose string")
    got = {r["sample_id"]: r["admitted"] for r in corpus.admit_batch(samples, consents, samples.limit(0)).collect()}
    assert got == {"s0": True, "s1": False, "s2": True, "s3": True}
    refused = corpus.refusals(samples, consents.withColumn("status", F.lit("withdrawn")), samples).first()
    assert "withdrawn" in refused["refusals"]


def test_style(spark):
    base = [("w", i, i * 20, 0.5 + 0.01 * (i % 3), 0.4 + 0.02 * (i % 2), 0.3) for i in range(12)]
    frame = spark.createDataFrame(base, "writer string, doc_id long, day long, f1 double, f2 double, f3 double")
    features = ("f1", "f2", "f3")
    bases = style.baselines(frame, features)
    candidates = spark.createDataFrame([("w", 100, 0.51, 0.41, 99.0), ("w", 101, 2.0, 2.0, 0.3)], "writer string, doc_id long, f1 double, f2 double, f3 double")
    got = {r["doc_id"]: r["band"] for r in style.compared(candidates, bases, features).collect()}
    assert got == {100: "within_variation", 101: "marked"}
    few = style.baselines(frame.limit(4), features)
    assert {r["band"] for r in style.compared(candidates, few, features).collect()} == {"undetermined"}


def test_ledger(spark):
    entries = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)], "log_id long, event_id long, payload string")
    whole = trust.chained(entries)
    assert trust.ledger_problems(whole).count() == 0
    edited = whole.withColumn("payload", F.when(F.col("sequence") == 3, "x").otherwise(F.col("payload")))
    assert [r["problem"] for r in trust.ledger_problems(edited).collect()] == ["altered"]
    heads = whole.groupBy("log_id").agg(F.max("sequence").alias("known_sequence"), F.max_by("entry_hash", "sequence").alias("known_hash"))
    assert trust.rollbacks(whole.where("sequence < 4"), heads).first()["state"] == "rolled_back"
    assert trust.rollbacks(whole, heads).count() == 0


def test_rotation_cycles_end(spark):
    anchors = spark.createDataFrame([("a", 0, 5, "b"), ("b", 6, 9, "a"), ("c", 20, None, "b"), ("d", 1, None, "gone")], "anchor_id string, not_before long, not_after long, replaces string")
    assert {r["anchor_id"]: r["depth"] for r in trust.rotation_chains(anchors).collect()} == {"a": 1, "b": 1, "c": 2, "d": 0}
    assert {(r["anchor_id"], r["problem"]) for r in trust.rotation_gaps(anchors).collect()} == {("b", "gap"), ("c", "gap"), ("d", "unknown")}


def test_protected_provenance_is_never_removed(spark):
    rules = spark.createDataFrame([("p", "c2pa_provenance", "remove")], "policy string, category string, action string")
    assert policy.policy_problems(rules, spark.createDataFrame([("q", "remove")], "policy string, default_action string")).count() == 3
    found = spark.createDataFrame([("1", "a", "c2pa_provenance", True, "x", "preserve"), ("2", "a", "document_metadata", True, "x", "remove"), ("3", "b", "document_metadata", True, "x", "remove")], "id string, artifact_path string, category string, removable boolean, remediation_id string, action string")
    assert {r["id"]: r["disposition"] for r in policy.remediation_plan(found).collect()} == {"1": "preserve", "2": "blocked_protected", "3": "planned"}


def test_budget_and_eviction(spark):
    found = spark.createDataFrame([(p, f"{p}{i}", i) for p in ("b", "A", "c") for i in range(4)], "artifact_path string, id string, emit_ord long")
    kept = scan.finding_budget(found, 6).collect()
    assert sorted(r["id"] for r in kept) == ["A0", "A1", "A2", "A3", "b0", "b1"]
    assert {r["artifact_path"] for r in kept if r["artifact_truncated"]} == {"b"}
    entries = spark.createDataFrame([("k1", 10, 1, False), ("k2", 10, 1, True), ("k3", 10, 2, True)], "key string, size_bytes long, generation int, reachable boolean")
    assert sorted(r["key"] for r in cache.eviction(entries, 15).collect()) == ["k1", "k2"]


def test_cleaning_removes_only_what_it_may(spark):
    rows = clean.cleaned(texts(spark, "a​b­\nGenerated by ChatGPT\nkept: written by Claude here\n")).collect()
    assert rows[0]["clean"] == "ab­\nkept: written by Claude here\n"
    spans = spark.createDataFrame([("a", "1", 0, 10), ("a", "2", 2, 5), ("a", "3", 8, 12), ("a", "4", 12, 13)], "artifact_path string, id string, start long, end long")
    assert {r["id"]: r["state"] for r in clean.span_problems(spans).collect()} == {"1": "kept", "2": "absorbed", "3": "conflict", "4": "kept"}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"print(1)")
    (tmp_path / "y.dat").write_bytes(b"a\0b")
    (tmp_path / "z").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    got = files.files(spark, str(tmp_path)).select(F.substring_index("artifact_path", "/", -1).alias("n"), files.artifact_type(F.col("artifact_path"), F.col("content")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == {"x.py": "source_code", "y.dat": "binary", "z": "png"}
    assert files.inventory(spark, str(tmp_path)).count() == 3


def test_media_cleaning_keeps_the_content(spark):
    from loupe.operators.media_clean import media_cleaned

    files_ = {**structure.sample_files(), "marked.png": structure.sample_files()["a.png"].replace(b"generated", b"c2pa rate")}
    rows = {r["artifact_path"]: r for r in media_cleaned(spark.createDataFrame([(k, bytearray(v)) for k, v in files_.items()], "artifact_path string, content binary")).collect()}
    for name in ("a.png", "a.wav", "a.flac", "a.mp3"):
        assert rows[name]["status"] == "cleaned" and rows[name]["material_before"] == rows[name]["material_after"]
        assert [f for _, f, v, _ in structure.metadata_of(bytes(rows[name]["clean"])) if v] == []
    assert rows["marked.png"]["status"] == "protected" and rows["a.pdf"]["status"] == "unsupported"


def test_seeded_corpus_is_stable(spark):
    from loupe.operators.reports import seeded_corpus

    a, b = (sorted(map(tuple, seeded_corpus(spark, 500, 7).repartition(k).collect())) for k in (1, 5))
    assert a == b and len({r[1] for r in a}) == 8


def test_streams_skip_content_they_have_seen(spark, tmp_path):
    from loupe.streaming.scan import fresh_only, ledger_links, run_once

    at = datetime(2024, 1, 1)
    rows = [(at, "a", "x"), (at, "b", "x"), (at, "c", "y")]
    spark.createDataFrame(rows, "ts timestamp, artifact_path string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, artifact_path string, text string").parquet(str(tmp_path / "in"))
    assert run_once(fresh_only(stream), "append").groupBy("text").count().where("count > 1").count() == 0
    entries = [(1, 1, "h1", ""), (1, 2, "h2", "h1"), (1, 2, "h2", "h1"), (1, 4, "h4", "h2"), (2, 1, "g1", "z")]
    spark.createDataFrame(entries, "log_id long, sequence long, entry_hash string, previous_hash string").coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("log_id long, sequence long, entry_hash string, previous_hash string").parquet(str(tmp_path / "log"))
    got = sorted(map(tuple, run_once(ledger_links(log), "append").collect()))
    assert got == [(1, 1, "linked"), (1, 2, "linked"), (1, 2, "rolled_back"), (1, 4, "gap"), (2, 1, "unlinked")]


def test_svg_that_cannot_be_read_is_a_row(spark):
    from loupe.operators.vector import svg_elements, svg_findings

    rows = svg_elements(texts(spark, "<svg><g", "<!DOCTYPE svg [<!ENTITY a 'b'>]><svg/>", None, '<svg><g opacity="0"/></svg>'))
    assert {r["artifact_path"] for r in rows.where("error is not null").collect()} == {"t0", "t1", "t2"}
    assert [r["detail"] for r in svg_findings(rows).collect()] == ["hidden"]
