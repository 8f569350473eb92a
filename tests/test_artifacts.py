"""Artifacts, reports, sources and sinks on written files; published figures where they are at hand."""

import glob
import json
import os

import pytest

from tidemark.plans.reports import Reports
from tidemark.sources import files, sinks
from tidemark.sources.artifacts import Sides, discover_sides

PUBLISHED = os.environ.get("ARTIFACT_DIR")


def artifact(language, **more):
    query = {"symbol": "Foo", "one_tokens": 2, "two_tokens": 40, "one_ms": 1.5, "two_ms": 30, "one_stdout_head": ["Foo c@a/b.x:3"], "two_stdout_head": ["Foo", "Source: a L3"]}
    return {
        "language": language, "repo": "https://github.com/o/n", "commit": "c", "two_detector_only": "",
        "one": {"cold_wall_seconds": 1, "index": {"symbols": 5, "edges": 4}, "edge_breakdown": [{"kind": "calls", "count": 7}]},
        "two": {"status": "", "ok": True, "metrics": {"calls": 3}}, "native_baseline": {"tool": "x-parser", "ok": True, "command": "run /tmp/t/repo"},
        "coverage": {"one_a_definition_symbols": 12, "z_definition_ratio": 1.2, "a_definition_ratio": 9, "native_definitions": 10},
        "commands": {"target_path": "/private/tmp/t/repo"}, "queries": [query, query | {"two_missing": True, "two_tokens": 0}],
        "multi_repo_validation": {"status": "passed", "selection_method": "m", "repos": [{"repo": "https://github.com/o/r.git", "commit": "c", "target_path": "/w/repo/src", "one_definitions": 3, "native_definitions": 3, "coverage_ratio": 1, "note": 'One counts {"f": 1}; native counts {"f": 1}'}] * 3},
    } | more


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "LIVE_GO_BENCHMARK.json").write_text(json.dumps(artifact("go"), indent=2))
    (folder / "LIVE_JSON_BENCHMARK.json").write_text(json.dumps(artifact("json", multi_repo_validation=None, queries=[])))
    (folder / "LIVE_EJS_BENCHMARK.json").write_text(json.dumps(artifact("", two_detector_only="false", one={"cold_wall_seconds": 1, "edge_breakdown": {"calls": 1}}, coverage={})))
    (folder / "A_LANGUAGE_DISCOVERY.json").write_text(json.dumps({"rows": [["go", ".go", "e1", "ok"], ["go", ".gox", "e2", "ok"]], "detector_only_code_extensions": [".ejs", ".zz"]}))
    return Reports(spark, str(folder))


def test_sides_and_rows(reports, spark):
    assert reports.sides == Sides("one", "two")
    live = {r.language: r for r in reports.live.collect()}
    assert list(live) == ["ejs", "go", "json"]  # a missing language comes from the file's name
    go = live["go"]
    assert (go.comparable_rows, go.token_ratio, go.latency_ratio, go.coverage_ratio, go.coverage_key, go.subject_definitions) == (1, 20.0, 20.0, 1.2, "z_definition_ratio", 12)
    assert go.strict_target and go.blockers == [] and go.validation_passed
    assert live["json"].blockers == ["no_comparable_query_rows"] and live["json"].comparable_rows == 0
    assert live["ejs"].detector_only and live["ejs"].blockers == ["coverage_missing"]


def test_evidence(reports):
    calls = {r.language: (r.subject_calls, r.status) for r in reports.calls().collect()}
    assert calls == {"go": (7, "calls-only"), "json": (7, "calls-only"), "ejs": (None, "missing")}
    precision = {r.language: (r.comparable_rows, r.proven_rows, r.kind_rows, r.status) for r in reports.precision().collect()}
    assert precision["go"] == (1, 1, 3, "sampled-name-location") and precision["json"][3] == "count-only"
    support = {r.language: (r.support_type, r.extractor) for r in reports.support().collect()}
    assert support["go"] == ("deterministic-extractor", "e2") and support["ejs"][0] == "detector-only"
    assert reports.validation_gate().first().passed
    ready = {r.language: r for r in reports.readiness().collect()}
    assert ready["go"].executable_ready_rows == 3 and ready["json"].validation_status == "structured-no-validation"
    row = reports.repo_readiness().where("language = 'go' AND position = 1").first()
    assert row.folder == "work/go/02-o__r" and row.target == "work/go/02-o__r/src" and row.candidate == "run work/go/02-o__r/src"


def test_renderers_and_explorer(reports, tmp_path, spark):
    assert "| Language |" in reports.markdown("precision") and json.loads(reports.json("gap"))["rows"][0]["live_languages"] == 3
    rows = {r.language: r for r in reports.explorer().collect()}
    assert rows["json"].status == "not-comparable" and rows["go"].label == "Go" and rows["ejs"].label == "EJS"
    audit = reports.final_audit()
    assert "The matrix report is not present." in audit and "| LIVE_GO_BENCHMARK.json |" in audit
    assert {(r.family, r.status) for r in reports.coverage_audit().where("support_type = 'detector-only'").collect()} == {("detector-only .ejs", "live benchmark evidence"), ("detector-only .zz", "no live benchmark artifact")}
    sinks.write_json(reports.gap_summary(), str(tmp_path / "gap"))
    assert spark.read.json(str(tmp_path / "gap")).count() == 1
    assert reports.tools().count() == 1 and reports.hero().first().fastest == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.ejs").write_text("x")
    (tmp_path / "src/node_modules/b.ejs").write_text("y")
    (tmp_path / "src/c.txt").write_text("z")
    assert [r.text for r in files.source_tree(spark, str(tmp_path), [".ejs"]).collect()] == ["x"]
    row = files.provenance(spark, str(tmp_path / "src"), "*.txt").first()
    assert (row.name, row.bytes, row.sha256[:8]) == ("c.txt", 1, "594e519a")
    assert files.read_optional_json(spark, str(tmp_path / "no.json"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.require_files(spark, str(tmp_path), ["no.json"])


if PUBLISHED:

    def test_published_figures(spark):
        """All recomputable rows of the published gap, evidence and validation reports."""
        r = Reports(spark, f"{PUBLISHED}/raw", discover_sides(spark, f"{PUBLISHED}/raw/LIVE_*_BENCHMARK.json"))
        want = {x["language"]: x for x in json.load(open(glob.glob(f"{PUBLISHED}/*gap-report.json")[0]))["live"]}
        live = r.live.collect()
        assert len(live) == 34
        for x in live:
            w = want[x.language]
            assert (x.token_ratio, x.latency_ratio, x.coverage_ratio, x.comparable_rows, x.token_gap, x.latency_gap, x.blockers) == (w["tokenRatio"], w["latencyRatio"], w["coverageRatio"], w["equivalentRows"], w["tokenGapTo10x"], w["latencyGapTo10x"], w["blockers"])
            assert (x.validation_passed, x.repo_count, x.min_coverage_ratio) == (w["validation"]["passed"], w["validation"]["repoCount"], w["validation"]["minCoverageRatio"])
        p, c, v = r.precision_summary().first(), r.call_summary().first(), r.validation_gate().first()
        assert (p.comparable_rows, p.proven_rows, p.passed) == (181, 143, True)
        assert (c.live_calls, c.live_counted) == (251196, True)
        assert (v.repo_rows, v.passed_repo_rows, v.passed) == (99, 99, True)


def test_matrix_and_fixture_sweep(spark, tmp_path):
    """Inputs whose schema is inferred from their readers."""
    q = {"symbol": "a", "one_tokens": 1, "two_tokens": 12, "one_ms": 1, "two_ms": 11}
    tools = {"one": {"ok": True, "seconds": 2, "metrics": {"symbols": 9, "calls": 10, "recv_typed": 4, "cold_seconds": 0.5}}, "two": {"metrics": {"calls": 3}}, "lsp": {"ok": True, "status": "ok"}}
    (tmp_path / "MATRIX_REPORT.json").write_text(json.dumps([{"language": "go", "repo": "r", "tools": tools, "queries": [q]}, {"language": "c", "repo": "r", "tools": {"one": {"seconds": 3, "metrics": {}}}, "queries": []}]))
    sweep = {"results": [{"language": "go", "one": {"ok": True}}, {"language": "zz", "category": "x", "one": {"seconds": 1, "metrics": {"symbols": 2}}, "two": {"support": {"support": "detector_only"}}, "fixture_oracle": {"recall": 0.5, "precision": 1, "missing_symbols": ["f"]}}]}
    (tmp_path / "SUPPORTED_LANGUAGE_BENCHMARK.json").write_text(json.dumps(sweep))
    (tmp_path / "LIVE_ASTRO_BENCHMARK.json").write_text(json.dumps(artifact("astro")))
    (tmp_path / "SATURATION_REPORT.json").write_text(json.dumps({"iterations_requested": 3, "languages": [{"language": "go", "saturated": True, "iterations": [{"iteration": 1, "queries": {"token_ratio": 2.0}}]}]}))
    r = Reports(spark, str(tmp_path))
    core = {x.language: x for x in r.core().collect()}
    assert core["go"].index_seconds == 0.5 and core["c"].index_seconds == 3 and list(core["go"].native_tools) == ["lsp"] and core["go"].pass_target
    assert (r.core_counts().first().groups, r.core_counts().first().token_ratio, r.call_summary().first().core_typed) == (2, 12.0, False)
    rows = {x.language: (x.tier, x.status) for x in r.explorer(r.supported()).collect()}
    assert rows == {"go": ("core", "comparable"), "c": ("core", "not-comparable"), "astro": ("live", "comparable"), "zz": ("supported", "not-comparable")}
    assert r.saturation().first().iterations[0].token_ratio == 2.0
