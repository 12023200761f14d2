"""What the review of the third round found: right beyond the sizes that the driver's small tables have."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loupe import catalog
from loupe.detection import engine, model
from loupe.detection import text as text_
from loupe.detection.model import Observation, Options, Registry
from loupe.functions.staging import shared_dir, staged
from loupe.operators import trust
from loupe.operators.detect_text import WHITESPACE
from tests.test_queries import rows_of


@pytest.fixture
def held(spark, tmp_path):
    """Runs a query over tables of its own and holds it against its SQL."""

    def run(name, **tables):
        duck = duckdb.connect()
        for table, rows in tables.items():
            rows.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            duck.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        want = duck.sql(catalog.oracles()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(got, df.columns) == rows_of(want.fetchall(), want.columns)
        return got

    return run


def test_plugins_of_any_number_may_be_blocked(spark, held):
    part = spark.createDataFrame([(k, 4) for k in (11, 199_991, 220_000 + 11, 22_000_011, 1)], "p_partkey long, p_size int")
    assert sorted(r[0] for r in held("capability_decisions", part=part) if r[1] == "blocked") == [11, 199_991, 220_011, 22_000_011]


def test_equal_claims_of_a_stage_go_to_the_last_actor(spark, held):
    rows = [(o, 7 * p + 1, s, 1, 5.0) for o in range(40) for p in (1, 2) for s in ((3, 4) if o % 2 else (4, 3))]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    got = held("stage_summary", lineitem=lineitem, supplier=spark.createDataFrame([(3,), (4,)], "s_suppkey long"))
    assert len(got) == 40


def test_a_budget_scans_each_artifact_once(spark, tmp_path):
    seen = tmp_path / "seen"

    class Counting:
        id, types = "test.counting.v1", frozenset(("text",))

        def observe(self, artifact, options):
            with seen.open("a") as out:
                out.write(artifact.path + "\n")
            return [Observation("c", "t", {"n": n}) for n in range(3)]

    texts = spark.createDataFrame([(f"a{i:02}", "text", "x") for i in range(20)], "artifact_path string, artifact_type string, text string")
    rows = engine.scan_rows(texts, Options(), Registry(()).with_plugin(Counting(), frozenset(("test.counting.v1",))))
    kept = engine.within_budget(rows, 10).where("kind = 'finding'").groupBy("artifact_path").count().collect()
    assert sorted(map(tuple, kept)) == [("a00", 3), ("a01", 3), ("a02", 3), ("a03", 1)]
    assert sorted(seen.read_text().split()) == [f"a{i:02}" for i in range(20)]


def test_characters_and_hints_are_found_as_they_were_one_by_one():
    rng = random.Random(3)
    alphabet = "abz \t\n\r\x00\x7fäß“ ​﻿‮­　️\U000e0100İıſK]^\\-["
    usual = re.compile(r"[^\x20-\x7e\t\n\r]")
    for n in range(400):
        text = "".join(rng.choice(alphabet) * rng.choice((1, 1, 1, 9)) for _ in range(n % 40))
        assert [m.span() for m in text_.unusual(text)] == [m.span() for m in usual.finditer(text) if text_.classified(m[0], m.start())]
        assert [(name, m.span()) for name, m in text_.spaced(text)] == [(name, m.span()) for name, p in WHITESPACE for m in re.finditer(p, text)]
    hint = re.compile(r"co-authored-by|generated|written|created|https?://", re.I)
    for word in ("co-authored-by", "Generated", "WRITTEN", "wrıtten", "wrİtten", "created", "http://", "httpſ://", "httpſ:/", "writen", "ä created", "äcreate"):
        assert model.hinted(word) == bool(hint.search(word)), word


def test_passes_over_what_is_made_of_numbers_are_dealt_over_tasks(spark, sf_dir):
    for name in ("dom_topology", "dom_histograms", "stylesheet_features", "sheet_measures", "sheet_properties", "media_cleaned", "scan_files"):
        assert catalog.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_the_first_binding_in_force_is_found_without_meeting_all(spark):
    rng = random.Random(5)
    rows = [(f"b{i:04}", a, rng.choice((None, a, a + rng.randrange(40), a + rng.randrange(4000)) if i % 97 == 0 or i > 350 else (a, a + rng.randrange(9), a + rng.randrange(90)))) for i in range(400) for a in (rng.randrange(3000),)]
    asked = [(i, rng.randrange(-50, 7000)) for i in range(900)] + [(901, None), (902, 5), (902, 5)]
    uses, bindings = spark.createDataFrame(asked, "use_id long, moment long"), spark.createDataFrame([*rows, ("none", None, None)], "anchor_id string, not_before long, not_after long")
    first = lambda t: min(((b, n) for n, b, e in rows if t is not None and b <= t and (e is None or t < e)), default=(0, None))[1]
    for small in (0, 10**6):
        df = trust.binding_in_force(uses.repartition(3), bindings.repartition(3), small)
        assert "NestedLoop" not in df._jdf.queryExecution().toString()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(str((u, t, first(t))) for u, t in asked)


def test_rotations_are_followed_within_and_across_ranges(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"r{i}" for i in range(600)]
    near = {n: f"r{i - 1}" if i % 53 else None for i, n in enumerate(names)} | {"r100": "r140", "r7": "r590", "r590": "r7", "r300": "gone", "r44": "r44"}
    far = {n: rng.choice((*names, None, "gone") if i % 3 else names) for i, n in enumerate(names)}

    def depth(links, n):
        seen = []
        while n in links and n not in seen:
            seen.append(n)
            n = links[n]
        return len(seen) - 1

    for at_once in (10**6, 40):
        monkeypatch.setattr(trust, "LINKS_AT_ONCE", at_once)
        for links in (near, far):
            got = {r["anchor_id"]: r["depth"] for r in trust.rotation_chains(spark.createDataFrame(list(links.items()), "anchor_id string, replaces string").repartition(3)).collect()}
            assert got == {n: depth(links, n) for n in links}


def test_neighbouring_rotations_are_written_a_few_times_and_not_once_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(trust, "staged", lambda df, name: written.append(staged(df, name)) or written[-1])
    monkeypatch.setattr(trust, "discarded", lambda *frames: None)
    anchors = spark.range(20_000).selectExpr("concat('r', id) AS anchor_id", "CASE WHEN id % 307 > 0 THEN concat('r', id - 1) END AS replaces")
    assert trust.rotation_chains(anchors).agg(F.max("depth")).first()[0] == 306
    assert sum(df.count() for df in written) < 4 * 20_000


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_files_of_manifests_are_never_broadcast(spark, sf_dir):
    df = catalog.queries()["manifest_problems"](spark, sf_dir)
    assert df.count() and "Broadcast" not in _plan(df)[1] and "SortMergeJoin" in _plan(df)[1]


def test_a_report_that_is_loaded_was_written_compressed(spark, sf_dir):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("report-*"))
    assert catalog.queries()["loaded_findings"](spark, sf_dir).count()
    (new,) = set(shared.glob("report-*")) - before
    assert {p.suffix for p in new.glob("part-*")} == {".gz"}


def test_what_is_read_twice_is_scanned_once(spark, sf_dir):
    assert _plan(catalog.queries()["scan_plan"](spark, sf_dir))[0].count("MapInArrow") == 0
    assert _plan(catalog.queries()["scan_determinism"](spark, sf_dir))[0].count("MapInArrow") == 2
