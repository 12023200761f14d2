"""The scan: identities, budgets, hostile inputs and every kind of detector on small artifacts."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loupe.detection import text as text_detectors
from loupe.detection.engine import BUILTIN, detectors_run, diagnostics, findings, inspected, report_summary, scan_rows, within_budget
from loupe.detection.model import Artifact, Incomplete, Observation, Options, finding_id
from loupe.detection.pdf import Broken, Pdf
from loupe.operators import structure
from loupe.plans import made


def seen(kind, text=None, content=None, options=Options(), path="a"):
    rows = list(inspected(Artifact(path, kind, text, content), BUILTIN.detectors, options))
    return [r for r in rows if r["kind"] == "finding"], [r for r in rows if r["kind"] == "diagnostic"]


def test_an_id_covers_evidence_and_place():
    import hashlib

    (r,), _ = seen("text", "ab\ncd​", path="p.txt")
    place = {"line": 2, "column": 3, "offset": 5, "end_offset": 6, "byte_offset": None, "package_part": None, "json_pointer": None}
    evidence = {"character": "​", "code_point": "U+200B", "unicode_name": "ZERO WIDTH SPACE", "safety_class": "invisible", "context": "ab\\ncd⟦U+200B⟧"}
    whole = {"artifact": "p.txt", "category": "invisible_unicode", "detector": "text.unicode-forensics.v1", "evidence": evidence, "location": place, "provider": None}
    assert r["id"] == "fnd_" + hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()[:20]
    assert json.loads(r["evidence"]) == evidence and (r["line"], r["col"], r["offset"]) == (2, 3, 5)
    assert finding_id("p", "d", Observation("c", "t")) != finding_id("q", "d", Observation("c", "t"))


def test_one_hidden_element_is_one_finding_with_all_reasons():
    found, _ = seen("html", '<a hidden style="display:none; visibility : hidden">x</a>')
    (hidden,) = [f for f in found if f["category"] == "hidden_element"]
    assert json.loads(hidden["evidence"])["reasons"] == ["hidden attribute", "display:none", "visibility:hidden"]


def test_comments_with_more_to_say_are_not_removable():
    found, _ = seen("html", "<!-- created with Gemini --><!-- see: created with Gemini, really -->")
    assert [f["remediation_id"] for f in found if f["category"] == "generated_comment"] == ["html.remove-attribution-comment", None]


@pytest.mark.parametrize(
    ("kind", "token"),
    [("text", "​"), ("text", "created with "), ("text", "Co-Authored-By: "), ("text", "a        "), ("text", "\n"), ("source_code", "/* "), ("source_code", "<!-- "), ("css", "{"), ("css", "/* "), ("css", ".a{"), ("css", "[a"), ("html", "<a "), ("html", "<!-- "), ("svg", "<g>")],
)
def test_hostile_repeats_are_quick(kind, token):
    def took(n):
        began = time.perf_counter()
        seen(kind, token * n, options=Options(max_findings=1_000_000))
        return time.perf_counter() - began

    once, twice = took(25_000), took(100_000)
    assert twice < 10 and (twice < 2 or twice < 8 * once)


def test_what_goes_over_its_budget_says_so():
    found, told = seen("html", "<b>" * 60_000)
    assert not [f for f in found if f["detector_id"].startswith("web.")] and [d["code"] for d in told] == ["scan_limit_exceeded"]
    found, told = seen("text", "​" * 5, options=Options(max_findings=4))
    assert not found and [(d["code"], d["detector_id"]) for d in told] == [("scan_limit_exceeded", "text.unicode-forensics.v1")]
    found, told = seen("text", "x" * 50, options=Options(max_file_size=49))
    assert [d["code"] for d in told] == ["artifact_too_large"]
    assert [d["code"] for d in seen("binary", "x", options=Options(single_artifact=True))[1]] == ["unsupported_artifact"] and not seen("binary", "x")[1]
    assert [d["code"] for d in seen("text", content=b"\xff\xfa\x00")[1]] == ["corrupt_artifact", "corrupt_artifact"]


class Failing:
    id, types, experimental = "acme.failing", frozenset(("text",)), False

    def observe(self, artifact, options):
        yield Observation("structural_signal", "seen")
        raise KeyError("boom")


class Experimental:
    id, types, experimental = "acme.experimental", frozenset(("text",)), True

    def observe(self, artifact, options):
        yield Observation("stylistic_signal", "seen")


def test_plugins_are_admitted_isolated_and_refused(spark):
    allowed = frozenset(("acme.failing", "acme.experimental"))
    registry = BUILTIN.with_plugin(Failing(), allowed).with_plugin(Experimental(), allowed).with_plugin(Failing(), allowed).with_plugin(object(), allowed).with_plugin(type("P", (Failing,), {"id": "acme.other"})(), allowed)
    assert [why for _, why in registry.refused] == ["another detector has its id", "it has no valid id", "it isn't on the list of allowed plugins"]
    rows = scan_rows(spark.createDataFrame([("a", "text", "x​")], "artifact_path string, artifact_type string, text string"), Options(), registry)
    assert {r["code"] for r in diagnostics(rows).collect()} == {"detector_failure", "plugin_rejected"}
    assert {r["detector_id"] for r in findings(rows).collect()} == {"text.unicode-forensics.v1"}
    assert [d.id for d in registry.eligible(Options(enabled=frozenset(("acme.experimental",))))] == ["acme.experimental"]
    assert "acme.failing" not in {d.id for d in registry.eligible(Options(disabled=frozenset(("acme.failing",))))}
    assert not report_summary(rows).first()["complete"]


def test_budget_cuts_the_report_and_what_is_behind(spark):
    rows = scan_rows(spark.createDataFrame([(p, "text", "​" * 3) for p in ("b", "A", "c", "d")], "artifact_path string, artifact_type string, text string"))
    kept = within_budget(rows, 5).collect()
    assert sorted(r["artifact_path"] for r in kept if r["kind"] == "finding") == ["A", "A", "A", "b", "b"]
    assert [(r["artifact_path"], r["code"]) for r in kept if r["kind"] == "diagnostic"] == [("b", "finding_limit_exceeded")]
    assert {r["artifact_path"] for r in kept if r["kind"] == "run"} == {"A", "b"}
    assert within_budget(rows, 100).where("kind = 'finding'").count() == 12
    assert {r["detector_id"]: r["artifacts"] for r in detectors_run(rows).collect()} == {"text.unicode-forensics.v1": 4, "text.explicit-attribution.v1": 4}
    assert scan_rows(rows.limit(0).select("artifact_path", F.lit("text").alias("artifact_type"), F.lit("x").alias("text"))).count() == 0


def test_nulls_and_empties_are_scanned(spark):
    rows = [("a", "text", None, None), ("b", None, "​", None), (None, "html", "", None), ("d", "docx", None, bytearray(b"")), ("e", "svg", "", None), ("f", "pdf", None, None)]
    got = scan_rows(spark.createDataFrame(rows, "artifact_path string, artifact_type string, text string, content binary"))
    assert findings(got).count() == 0
    assert {(r["artifact_path"], r["code"]) for r in diagnostics(got).collect()} == {("d", "corrupt_artifact"), ("e", "corrupt_artifact"), ("f", "corrupt_artifact")}


def test_style_sheet_measures():
    f = text_detectors.sheet_features("@import 'x'; /* c */ @media x { .a #b > p, q { color: red !important; -moz-x: 1; --v: 2 } .a #b > p { d: url( data:x) } } .open { e: f", 1000)
    assert (f["rules"], f["selectors"], f["declarations"], f["duplicate_selectors"], f["max_selector_parts"]) == (3, 3, 4, 1, 4)  # what stands before an at-rule is part of it
    f = text_detectors.sheet_features("/* c */ @media x { .a #b > p, q { color: red !important; -moz-x: 1; --v: 2 } .a #b > p { d: url( data:x) } } .open { e: f", 1000)
    assert (f["rules"], f["selectors"], f["declarations"], f["important_declarations"], f["vendor_prefixed_properties"], f["custom_properties"]) == (3, 3, 4, 1, 1, 1)
    assert (f["duplicate_selectors"], f["embedded_data_uris"], f["comments"], f["complete"]) == (1, 1, 1, True)
    assert f["specificity_histogram"] == {"1-1-1": 2, "0-0-1": 1}
    assert text_detectors.sheet_features(".a{b:c}" * 10, 4)["truncated_by"] == "rules"


def test_comments_of_style_sheets_hide_in_strings():
    spans = lambda t: [t[a:b] for a, b in text_detectors.css_comments(t)]
    assert spans('a { b: "/* no */" } /* yes */ .c { d: \'\\\'/* no\' } /* open') == ["/* yes */", "/* open"]


def test_hiding_rules_are_the_innermost():
    found, _ = seen("css", "@media print { .a { display: none } } .b { color: red } } .c { visibility : hidden }")
    assert [json.loads(f["evidence"])["selector"] for f in found if f["category"] == "hidden_element"] == [".a", ".c"]


def test_pdf_readers():
    for make, wanted in ((made._plain_pdf, {"Author": "N (x)", "Producer": "Maker"}), (made._packed_pdf, {"Author": "N", "Creator": "Maker"})):
        found, told = seen("pdf", content=make(1, "N"))
        got = {json.loads(f["evidence"])["field"]: json.loads(f["evidence"]) for f in found}
        assert {k: v["value"] for k, v in got.items()} == wanted and not told
        assert {v["reader"] for v in got.values()} == {"object-graph"}
    lexical = made._plain_pdf(1, "N").replace(b"startxref\n", b"startxref\n9")
    assert {json.loads(f["evidence"])["reader"] for f in seen("pdf", content=lexical)[0]} == {"lexical"}
    bomb = b"%PDF-1.4\nxref\n0 99999999\ntrailer <<>>\nstartxref\n9\n%%EOF"
    with pytest.raises(Broken):
        Pdf(bomb)
    circle = made._pdf([b"<< /Type /Catalog >>", b"3 0 R", b"2 0 R"], "/Root 1 0 R /Info 2 0 R")
    assert seen("pdf", content=circle)[0] == []
    deep = made._pdf([b"<< /Type /Catalog >>", b"[" * 100 + b"]" * 100], "/Root 1 0 R /Info 2 0 R")
    assert seen("pdf", content=deep)[0] == []
    assert [d["code"] for d in seen("pdf", content=b"%PDF-1.4")[1]] == ["corrupt_artifact"]


def test_packages_are_checked_before_they_are_read():
    for parts in ((("../a", "x"),), (("a", "0" * 5_000_000),), (("docProps/core.xml", "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"),)):
        assert [d["code"] for d in seen("docx", content=made._zip(*parts))[1]] == ["unsafe_artifact"]
    assert [d["code"] for d in seen("docx", content=made._zip(("docProps/core.xml", "<a>")))[1]] == ["corrupt_artifact"]
    assert [d["code"] for d in seen("odf", content=made._zip(("mimetype", "x")))[1]] == ["corrupt_artifact"]
    kept, _ = seen("docx", content=made._zip(("docProps/core.xml", "<c><creator>has a c2pa_manifest</creator></c>"), ("customXml/item1.xml", "<x>Content Credentials</x>")))
    assert {(f["category"], f["removable"]) for f in kept} == {("personal_metadata", False), ("document_metadata", False), ("c2pa_provenance", False)}


def test_svg_that_is_protected_or_broken():
    marked = '<svg xmlns="s"><metadata><x>c2pa</x></metadata><!-- created with ChatGPT c2pa --></svg>'
    found, _ = seen("svg", marked)
    assert {f["removable"] for f in found} == {False} and {f["category"] for f in found} == {"c2pa_provenance", "generator_metadata", "explicit_ai_attribution"}
    for broken, code in (("<svg><g", "corrupt_artifact"), ("<html/>", "corrupt_artifact"), ("<!DOCTYPE svg [<!ENTITY a 'b'>]><svg/>", "unsafe_artifact")):
        assert code in [d["code"] for d in seen("svg", broken)[1]]


def test_repositories():
    log = "".join(f"h{i}\0Ann\0a@x\0m {i}\n\nCo-Authored-By: Claude <c@x>\0\x1e\n" for i in range(3))
    found, _ = seen("git_repository", log, b"CLAUDE.md\0src/a.c\0.codex/x\0")
    assert [(f["category"], f["provider"], f["removable"]) for f in found] == [("git_attribution", "anthropic", False)] * 3 + [("tooling_residue", "anthropic", False), ("tooling_residue", "openai", False)]
    _, told = seen("git_repository", "h\0A\0e\0m\0\x1e" * 501, b"")
    assert [d["code"] for d in told] == ["detector_scan_truncated"]


def test_rows_that_cannot_be_read_are_diagnostics(spark):
    pages = spark.createDataFrame([("a", "<a hidden>" + "<b>" * 100_001), ("b", "<a hidden>")], "artifact_path string, text string")
    events = structure.html_events(pages)
    assert [(r["artifact_path"], r["code"]) for r in structure.problems(events).collect()] == [("a", "scan_limit_exceeded")]
    assert [r["artifact_path"] for r in structure.html_findings(events).collect()] == ["b"]


def test_guarded_parsing():
    from loupe.detection.markup import guard, unclosed_tags

    assert unclosed_tags("<a <b> <c <d") == 3 and unclosed_tags("a > b") == 0
    with pytest.raises(Incomplete):
        guard("<a " * 10_000)
