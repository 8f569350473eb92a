"""Edge cases of the rules on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import strings as S
from tidemark.functions.collections import first_entry, json_map
from tidemark.operators import classify, coverage, evidence, explore, graph, joins, paired, scan


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


QUERY = "g string, subject_tokens double, rival_tokens double, subject_ms double, rival_ms double, subject_missing boolean, rival_missing boolean"


def test_no_queries_and_all_missing(spark):
    empty = paired.paired_summary(spark.createDataFrame([], QUERY)).first()
    assert (empty["rows"], empty.subject_tokens, empty.token_ratio, empty.pass_target, empty.token_gap) == (0, 0.0, None, False, None)
    gone = paired.paired_summary(spark.createDataFrame([("a", 1.0, None, 1.0, None, False, True)], QUERY), "g").first()
    assert gone.comparable_rows == 0 and gone.token_ratio is None and gone.rival_missing_rows == 1


def test_zero_and_null_flags(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 0.0, 3.0, None, None), ("a", 1.0, 9.996, 1.0, 9.996, None, False)], QUERY)
    s = paired.paired_summary(rows, "g").first()
    assert s.comparable_rows == 1 and s.token_ratio == 10.0 and not s.token_target and s.token_gap == 1.0
    assert rows.where(paired.comparable(strict=False)).count() == 2


def test_numbers(spark):
    r = one(spark, a=N.positive(F.lit("x")), b=N.positive(F.lit(None).cast("string")), c=N.ratio(F.lit(1.0), F.lit(0.0)), d=N.rounded_strict(F.lit(1.005)), e=N.rounded(F.lit(1.005)), f=N.number(F.lit("NaN")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (False, False, None, 1.0, 1.01, None)
    gates = spark.range(0).agg(N.every(F.lit(False)).alias("e"), N.some(F.lit(True)).alias("s")).first()
    assert gates.e is True and gates.s is False


def test_truth_of_text_and_paths(spark):
    r = one(spark, a=S.is_filled(F.lit("")), b=S.is_filled(F.lit("false")), c=S.after_marker(F.lit("/x/repo/a/b")), d=S.after_marker(F.lit("/x/repo/")), e=S.after_marker(F.lit(None).cast("string")), f=S.replace_first(F.lit("a b a"), "a", "X"), g=S.slug(F.lit("https://github.com/o/n.git")), h=S.padded_index(F.lit(122)), i=S.capitalised(F.lit("ab c_d é x9")), j=S.label(F.lit("csharp")), k=S.label(F.lit("")), l=S.iso_time(F.lit(0)))
    assert list(r) == [False, True, "a/b", ".", ".", "X b a", "o/n", "123", "Ab C_d é X9", "C#", "unknown", "1970-01-01T00:00:00.000Z"]


def test_hashes_equal_the_formula(spark):
    r = one(spark, h=S.fnv1a(F.lit("node-12")), m=S.mulberry32(F.lit(12345).cast("long")))
    assert r.h == graph._fnv1a("node-12")
    assert math.isclose(r.m, next(graph._generator(12345)))
    assert one(spark, h=S.fnv1a(F.lit(""))).h == 0x811C9DC5


def test_first_key_in_document_order(spark):
    m = json_map(F.lit('{"b_definition_ratio": "2", "a_definition_ratio": "1", "x": null}'))
    c = coverage.coverage_columns(m, "subject")
    r = one(spark, key=c["coverage_key"], ratio=c["coverage_ratio"], other=c["subject_definitions"], none=first_entry(m, lambda k: k == "zz")["value"])
    assert list(r) == ["b_definition_ratio", 2.0, None, None]


@pytest.mark.parametrize(("ratio", "band"), [(0.9999, "parity"), (1.0, "parity"), (1.0001, "parity"), (1.00011, "exceed"), (0.5, "below"), (None, None)])
def test_bands(spark, ratio, band):
    assert one(spark, b=coverage.band(F.lit(ratio).cast("double"))).b == band


def test_below_counts_as_parity_too(spark):
    r = coverage.coverage_counts(spark.createDataFrame([(0.5,), (1.5,), (None,)], "coverage_ratio double")).first()
    assert (r["rows"], r.with_ratio, r.parity_rows, r.exceed_rows, r.below_rows) == (3, 2, 1, 1, 1)


def test_validation(spark):
    schema = "validation struct<minimum_repos:int,status:string,repos:array<struct<ok:boolean,coverage_ratio:double>>>"
    rows = spark.createDataFrame([((None, None, [(None, 1.0), (True, 0.99995), (False, 2.0)]),), ((2, "", [(None, 1.0), (None, 1.2)]),), (None,)], schema)
    got = rows.select(*[c.alias(n) for n, c in coverage.validation_columns(F.col("validation")).items()]).collect()
    assert [(r.repo_count, r.passed_repo_count, r.validation_passed, r.validation_status) for r in got] == [(3, 2, False, "partial"), (2, 2, True, "passed"), (0, 0, False, "missing")]


def test_joins_choose_one_partner(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z")], "k string, p int, v string")
    assert {(r.k, r.v) for r in joins.left_first(left, right, ["k"], [F.col("p")]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in joins.left_last(left, right, ["k"], [F.col("p")]).collect()} == {("a", "x"), ("b", None)}
    base = spark.createDataFrame([("t", "old", 0), ("t", "new", 1), ("", "none", 2)], "k string, v string, p int")
    added = spark.createDataFrame([("t", "late", 0), ("u", "first", 0), ("u", "second", 1)], "k string, v string, p int")
    assert {(r.k, r.v) for r in joins.upsert(base, added, ["k"], "p").collect()} == {("t", "new"), ("u", "first")}


def test_list_order_and_collation(spark):
    rows = spark.createDataFrame([(x,) for x in "aBA_b"], "t string")
    assert [r.t for r in joins.ordered_by_list(rows, "t", ["b"]).collect()] == ["b", "_", "a", "A", "B"]


def test_nulls_come_last_both_ways(spark):
    rows = spark.createDataFrame([("x", 1.0), ("z", None), ("y", 2.0), ("w", None)], "label string, v double")
    order = lambda d: [r.label for r in rows.orderBy(*explore.null_last("v", d)).collect()]
    assert order("asc") == ["x", "y", "w", "z"] and order("desc") == ["y", "x", "w", "z"]
    assert [r.label for r in paired.near_misses(rows, "v", "label", most=1.0).collect()] == ["w", "z", "x"]


def test_band_starts(spark):
    rows = spark.createDataFrame([(0, False), (1, True), (2, False), (3, False)], "i int, f boolean")
    assert [r.band_start for r in explore.band_starts(rows, "f", [F.col("i")]).orderBy("i").collect()] == [True, False, True, False]


def test_graph(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "node int, id string")
    edges = spark.createDataFrame([(0, 0), (0, 9), (0, 1), (1, 0), (0, 1), (None, 1)], "s int, t int")
    assert {(r.node, r.degree, r.degree_share) for r in graph.degrees(edges, nodes).collect()} == {(0, 1, 1.0), (1, 1, 1.0), (2, 0, 0.0)}
    assert [r.node for r in graph.isolated(edges, nodes).collect()] == [2]
    assert graph.layout(nodes, edges, "s").count() == 3


def test_kinds_and_commands(spark):
    assert list(one(spark, a=classify.row_status(F.lit(None).cast("double"), F.lit(True)), b=classify.tool_class(F.lit("go"), F.lit(None).cast("string"), F.lit(None).cast("boolean")), c=classify.tool_class(F.lit("json"), F.lit("x-proxy"), F.lit(False)))) == ["not-comparable", "other-baseline", "structured-format"]
    blocked = one(spark, b=evidence.command_blockers(F.lit("run <x> /private/tmp/h-1/y (note)"), "h-"), c=evidence.kind_map(F.lit('x Native counts {"a": 2} y'), evidence.NATIVE_KIND_PATTERNS))
    assert blocked.b == ["native_command_contains_placeholder", "native_command_uses_ephemeral_helper_path", "native_command_contains_inline_note"] and blocked.c == {"a": 2.0}


def test_scanners(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    counts = lambda df: {(r.kind, r.n) for r in scan.totals(df).collect() if r.n}
    assert counts(scan.ejs(files(("a.ejs", "<% include('x') %> function f(a) {} let b; const c"), ("b.ejs", None)))) == {("template", 2), ("include", 1), ("function", 1), ("variable", 2)}
    assert counts(scan.svelte(files(("a.svelte", "<script>\nlet a\nfunction f() {}\nx()\n</script>let z<script lang='ts'>const q</script>")))) == {("script_block", 2), ("function", 1), ("variable", 2)}
    razor = "@page \"/a\"\n@using X\n@namespace Y\n<Card/><b>\npublic void Go(int x) {\n}\nprivate if (x) {}"
    assert counts(scan.razor(files(("a.razor", razor)))) == {("view", 1), ("route", 1), ("import", 2), ("component", 1), ("method", 1)}
    assert ("method", 1) not in counts(scan.razor(files(("a.razor", razor + "[Parameter]"))))
    xml = '<Project Sdk="S" xmlns="u"><ItemGroup><PackageReference/><ProjectReference/></ItemGroup><TargetFrameworks>a; b,</TargetFrameworks><TargetFramework>c</TargetFramework></Project>'
    solution = 'Project("{1}") = "a", "b.csproj"\n'
    assert counts(scan.projects(files(("a.csproj", xml), ("b.sln", solution * 2)))) == {("project", 3), ("sdk", 1), ("package", 1), ("project_reference", 1), ("target_framework", 3)}
    assert [list(r.paths) for r in scan.samples(scan.ejs(files(("b", ""), ("a", ""))), 1).collect()] == [["a"]]


def test_set_scores_equal_the_arrays(spark):
    arrays = spark.createDataFrame([("a", ["x", "y", "x"], ["y", "z"]), ("b", ["q"], ["q"])], "k string, e array<string>, f array<string>")
    items = arrays.select("k", F.explode("e").alias("item"), F.lit(True).alias("expected")).union(arrays.select("k", F.explode("f"), F.lit(False)))
    one_way = {r.k: (r.recall, r.precision) for r in evidence.recall_precision(arrays, "e", "f").collect()}
    assert one_way == {r.k: (r.recall, r.precision) for r in evidence.set_scores(items, "k").collect()} == {"a": (0.5, 0.5), "b": (1.0, 1.0)}


def test_blockers_are_distinct_and_empty_keys_stay(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("a", ["x", "w"]), ("b", [])], "k string, blockers array<string>")
    assert {r.k: r.blockers for r in evidence.blockers_by(rows, "k").collect()} == {"a": ["w", "x"], "b": []}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidemark.session import Scratch, scratch_root

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a")))
    before = spark.conf.get("spark.checkpoint.dir", None)
    scratch = Scratch(spark, "test")
    assert scratch.table(spark.range(3), "t").count() == 3
    scratch.drop("t")
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_layout_equals_single_pairs(monkeypatch):
    """The vectorised steps against forces summed pair by pair and edge by edge."""
    import numpy as np

    p = graph.LAYOUT
    ids, edges = [f"n{k}" for k in range(9)], [(0, 1), (1, 2), (2, 0), (3, 4), (5, 8), (5, 0)]
    s, t = (np.array([e[k] for e in edges]) for k in (0, 1))
    whole = graph.force_layout(ids, s, t, "seed")
    monkeypatch.setattr(graph, "LAYOUT_BLOCK", 4)
    assert np.allclose(graph.force_layout(ids, s, t, "seed"), whole)
    monkeypatch.setattr(graph, "LAYOUT", p | {"iterations": 0})
    at = [list(x) for x in graph.force_layout(ids, s, t, "seed")]
    speed = [[0.0, 0.0] for _ in ids]
    for step in range(p["iterations"]):
        for a in range(len(ids)):
            for b in range(len(ids)):
                if a != b:
                    x, y = at[a][0] - at[b][0], at[a][1] - at[b][1]
                    if x * x + y * y < 0.01:
                        low, high, sign = min(a, b), max(a, b), 1 if a < b else -1
                        x, y = sign * ((low - high) * 0.01 + 0.001), sign * ((low + high) * 0.01 + 0.001)
                    square = x * x + y * y
                    speed[a][0] += x * p["repulsion"] / square**1.5
                    speed[a][1] += y * p["repulsion"] / square**1.5
        for a, b in edges:
            x, y = at[b][0] - at[a][0], at[b][1] - at[a][1]
            distance = math.hypot(x, y) or 0.01
            pull = (distance - p["length"]) * p["stiffness"] / distance
            for k, d in ((0, x), (1, y)):
                speed[a][k] += d * pull
                speed[b][k] -= d * pull
        for a in range(len(ids)):
            speed[a] = [(v - c * p["centre"]) * p["damping"] for v, c in zip(speed[a], at[a], strict=True)]
            move = [v * (1 - step / p["iterations"]) for v in speed[a]]
            length = math.hypot(*move)
            scale = p["largest_step"] / length if length > p["largest_step"] else 1.0
            at[a] = [c + m * scale for c, m in zip(at[a], move, strict=True)]
    assert np.allclose(at, whole, atol=1e-6)


def test_risk_reasons(spark):
    rows = [("json", "x", False, True), ("go", "x", True, True), ("go", "a counter", False, True), ("go", "x", False, None), ("go", "x", False, True)]
    df = spark.createDataFrame(rows, "language string, tool string, detected boolean, validated boolean")
    cols = [F.col(c) for c in df.columns]
    assert [r[0] for r in df.select(classify.risk_reason(*cols)).collect()] == list(classify.RISK_REASONS)
    assert df.select(classify.risk_reason(*cols, {"scope": "compare scopes"})).collect()[4][0] == "compare scopes"
