"""Benchmark artifacts: one JSON document per language and repository, read with explicit schemas.

The documents name their two measured sides by a prefix; ``Sides`` holds the two
prefixes, and every table made here names them ``subject_*`` and ``rival_*``. Blocks
with dynamic keys are read as maps (document order is kept), blocks of two shapes as
text that is parsed by either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.strings import first_filled, is_filled
from tidemark.operators.coverage import coverage_columns, status_columns, validation_columns
from tidemark.operators.paired import paired_summary


@dataclass(frozen=True)
class Sides:
    subject: str
    rival: str


def discover_sides(spark: SparkSession, path: str) -> Sides:
    """The two prefixes, from one artifact: both have tokens per query, the subject a cold start time."""
    row = spark.read.text(path, wholetext=True).limit(1).select(F.from_json("value", "queries array<map<string,string>>").alias("q"), F.from_json("value", "map<string,string>").alias("top")).first()
    names = sorted({k.removesuffix("_tokens") for q in row["q"]["queries"] for k in q if k.endswith("_tokens")})
    subject = [n for n in names if "cold_wall_seconds" in (row["top"].get(n) or "")]
    if len(names) != 2 or len(subject) != 1:
        raise ValueError(f"cannot tell the sides from {names}")
    return Sides(subject[0], next(n for n in names if n != subject[0]))


def artifact_schema(sides: Sides) -> str:
    s, r = sides.subject, sides.rival
    index = "struct<symbols:bigint,edges:bigint,calls:bigint,recv_typed:bigint,indexed_files:bigint,duration_ms:bigint,edge_kinds:map<string,bigint>>"
    pair = lambda suffix, kind: f"{s}_{suffix}:{kind},{r}_{suffix}:{kind}"
    query = f"struct<symbol:string,{pair('tokens', 'double')},{pair('ms', 'double')},{pair('missing', 'boolean')},{pair('stdout_head', 'array<string>')},{pair('ms_samples', 'array<double>')}>"
    repo = f"struct<repo:string,commit:string,target_path:string,note:string,ok:boolean,{s}_definitions:double,native_definitions:double,coverage_ratio:double,native_command:string>"
    metrics = "struct<definitions:double,diagnostics:string,definition_counts:map<string,double>,expanded_definition_counts:map<string,double>>"
    return (
        f"language string, repo string, commit string, {r}_detector_only string, coverage map<string,string>, queries array<{query}>, "
        f"{s} struct<cold_wall_seconds:double,reindex_wall_seconds:double,calls:bigint,edges:bigint,recv_typed:bigint,receiver_typed_calls:bigint,edge_breakdown:string,index:{index}>, "
        f"{r} struct<status:string,ok:boolean,seconds:double,calls:bigint,metrics:struct<nodes:bigint,links:bigint,edges:bigint,calls:bigint>>, "
        f"native_baseline struct<tool:string,name:string,status:string,ok:boolean,seconds:double,command:string,metrics:{metrics}>, "
        f"multi_repo_validation struct<minimum_repos:int,status:string,generated_at:string,scope:string,selection_method:string,measurement_order:string,repos:array<{repo}>>, "
        "commands struct<target_path:string,native_baseline:string>, optimization struct<cycles_run:int,stop_reason:string,cycle_notes:array<string>>"
    )


def read_artifacts(spark: SparkSession, folder: str, sides: Sides, pattern: str = "LIVE_*_BENCHMARK.json") -> DataFrame:
    """One row per artifact file, under neutral names; a file that is no JSON gives nulls."""
    s, r = sides.subject, sides.rival
    raw = spark.read.text(f"{folder}/{pattern}", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", artifact_schema(sides)).alias("a"))
    a = lambda name: F.col(f"a.{name}")
    sub, riv, native = f"a.{s}", f"a.{r}", "a.native_baseline"

    def query(q: Column) -> Column:
        return F.struct(q["symbol"].alias("symbol"), *[q[f"{p}_{f}"].alias(f"{n}_{t}") for n, p in (("subject", s), ("rival", r)) for f, t in (("tokens", "tokens"), ("ms", "ms"), ("missing", "missing"), ("stdout_head", "head"), ("ms_samples", "ms_samples"))])

    def repo(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("repo", "commit", "target_path", "note", "ok", "native_definitions", "coverage_ratio", "native_command")], x[f"{s}_definitions"].alias("subject_definitions"))

    v = F.col("a.multi_repo_validation")
    repos = F.transform(v["repos"], repo)
    breakdown = F.col(f"{sub}.edge_breakdown")
    listed = F.filter(F.from_json(breakdown, "array<struct<kind:string,count:bigint>>"), lambda e: e["kind"] == "calls")
    return raw.select(
        "file",
        F.coalesce(F.nullif(a("language"), F.lit("")), F.lower(F.regexp_extract("file", r"^LIVE_(.*)_BENCHMARK\.json$", 1))).alias("language"),
        a("repo").alias("repo"),
        a("commit").alias("commit"),
        is_filled(F.col(f"a.{r}_detector_only")).alias("detector_only"),
        F.transform(a("queries"), query).alias("queries"),
        a("coverage").alias("coverage"),
        F.when(v.isNotNull(), F.struct(*[v[c].alias(c) for c in ("minimum_repos", "status", "generated_at", "scope", "selection_method", "measurement_order")], repos.alias("repos"))).alias("validation"),
        repos.alias("repos"),
        F.struct(first_filled(F.col(f"{native}.tool"), F.col(f"{native}.name"), F.lit("native baseline")).alias("tool"), first_filled(F.col(f"{native}.status"), F.when(F.col(f"{native}.ok"), F.lit("ok")).otherwise(F.lit("unknown"))).alias("status"), F.coalesce(f"{native}.ok", F.lit(False)).alias("ok"), F.col(f"{native}.seconds").alias("seconds"), F.coalesce(f"{native}.command", F.lit("")).alias("command"), F.col(f"{native}.metrics.definitions").alias("definitions"), F.col(f"{native}.metrics.definition_counts").alias("definition_counts"), F.col(f"{native}.metrics.expanded_definition_counts").alias("expanded_definition_counts")).alias("native"),
        F.col(f"{sub}.cold_wall_seconds").alias("index_seconds"),
        F.col(f"{sub}.reindex_wall_seconds").alias("reindex_seconds"),
        F.col(f"{sub}.index.symbols").alias("symbols"),
        F.coalesce(f"{sub}.index.edges", f"{sub}.edges").alias("edges"),
        F.coalesce(F.try_element_at(F.col(f"{sub}.index.edge_kinds"), F.lit("calls")), F.get(listed, 0)["count"], F.col(f"{sub}.index.calls"), F.col(f"{sub}.calls")).alias("subject_calls"),
        F.coalesce(f"{sub}.index.recv_typed", f"{sub}.recv_typed", f"{sub}.receiver_typed_calls").alias("typed_calls"),
        F.coalesce(f"{riv}.metrics.calls", f"{riv}.calls").alias("rival_calls"),
        F.coalesce(f"{riv}.metrics.links", f"{riv}.metrics.edges").alias("rival_edges"),
        F.coalesce(F.nullif(F.col(f"{riv}.status"), F.lit("")), F.lit("unknown")).alias("rival_status"),
        F.coalesce(f"{riv}.ok", F.lit(False)).alias("rival_ok"),
        F.col(f"{riv}.seconds").alias("rival_seconds"),
        F.col("a.commands.target_path").alias("target_path"),
        F.col("a.commands.native_baseline").alias("native_command"),
        a("optimization").alias("optimization"),
    )


def live_benchmarks(artifacts: DataFrame, sides: Sides) -> DataFrame:
    """One row per artifact with query summary, coverage, validation and status."""
    rows = artifacts.select("file", F.explode("queries").alias("q")).select("file", "q.*")
    summary = paired_summary(rows, "file")
    counted = [c for c in summary.columns if c != "file"]
    zero = {"rows": 0, "comparable_rows": 0, "subject_missing_rows": 0, "rival_missing_rows": 0}
    joined = artifacts.join(summary, "file", "left").fillna(zero).fillna(0.0, ["subject_tokens", "rival_tokens", "subject_ms", "rival_ms"]).fillna(False, ["pass_low", "token_target", "latency_target", "pass_target"])
    out = joined.withColumns(coverage_columns(F.col("coverage"), sides.subject)).withColumns(validation_columns(F.col("validation")))
    status = status_columns(F.col("coverage_ratio"), *[F.col(c) for c in ("comparable_rows", "token_ratio", "latency_ratio", "token_target", "latency_target", "pass_target")])
    return out.withColumns(status).select("file", "language", "repo", "commit", "detector_only", F.col("native.tool").alias("native_tool"), "index_seconds", "symbols", "edges", *counted, "coverage_ratio", "coverage_key", "subject_definitions", "native_definitions", "minimum_repos", "repo_count", "passed_repo_count", "validation_passed", "min_coverage_ratio", "validation_status", *status, "repos").orderBy(F.collate("language", "UNICODE"))


def core_matrix(spark: SparkSession, path: str, sides: Sides) -> DataFrame:
    """Rows of a matrix report: tools by dynamic name, with a query summary. (The schema is inferred from its readers.)"""
    tool = "struct<status:string,ok:boolean,seconds:double,metrics:struct<symbols:bigint,edges:bigint,calls:bigint,internal_calls:bigint,recv_typed:bigint,cold_seconds:double>>"
    s, r = sides.subject, sides.rival
    query = ",".join(f"{p}_{f}:{k}" for p in (s, r) for f, k in (("tokens", "double"), ("ms", "double"), ("missing", "boolean")))
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<language:string,repo:string,subdir:string,tools:map<string,{tool}>,queries:array<struct<symbol:string,{query}>>>>")).alias("m")).select("m.*")
    flat = raw.withColumn("queries", F.transform("queries", lambda q: F.struct(q["symbol"].alias("symbol"), *[q[f"{p}_{f}"].alias(f"{n}_{f}") for n, p in (("subject", s), ("rival", r)) for f in ("tokens", "ms", "missing")])))
    summary = paired_summary(flat.select("language", F.explode("queries").alias("q")).select("language", "q.*"), "language")
    own, other = F.try_element_at("tools", F.lit(s)), F.try_element_at("tools", F.lit(r))
    others = F.map_filter("tools", lambda k, _: ~k.isin(s, r))
    base = flat.select("language", "repo", "subdir", F.coalesce(own["metrics"]["cold_seconds"], own["seconds"]).alias("index_seconds"), own["metrics"]["symbols"].alias("symbols"), own["metrics"]["edges"].alias("edges"), own["metrics"]["calls"].alias("subject_calls"), own["metrics"]["recv_typed"].alias("typed_calls"), other["metrics"]["calls"].alias("rival_calls"), others.alias("native_tools"))
    return base.join(summary, "language", "left")


def coverage_audit(discovery: DataFrame, live: DataFrame) -> DataFrame:
    """Deterministic families, and detected extensions with the first live artifact of their language.

    discovery has one row with rows (array of [family, extensions, extractor, status])
    and detector_only_code_extensions.
    """
    from tidemark.functions.strings import lookup
    from tidemark.operators.classify import EXTENSION_LANGUAGE
    from tidemark.operators.joins import left_first

    known = discovery.select(F.posexplode("rows").alias("position", "r")).select(F.col("r")[0].alias("family"), F.col("r")[1].alias("extensions"), F.col("r")[2].alias("extractor"), F.col("r")[3].alias("status"), F.lit("deterministic extractor").alias("support_type"))
    detected = discovery.select(F.posexplode("detector_only_code_extensions").alias("position", "extensions")).withColumn("language", F.regexp_replace(lookup(F.col("extensions"), EXTENSION_LANGUAGE), r"^\.", ""))
    joined = left_first(detected, live.select("language", "file"), ["language"], [F.col("file")])
    shown = joined.select(F.concat(F.lit("detector-only "), "extensions").alias("family"), "extensions", F.lit("detector only").alias("extractor"), F.when(F.col("file").isNotNull(), F.lit("live benchmark evidence")).otherwise(F.lit("no live benchmark artifact")).alias("status"), F.lit("detector-only").alias("support_type"), "file")
    return known.unionByName(shown, allowMissingColumns=True)


def saturation(spark: SparkSession, path: str) -> DataFrame:
    """Languages of a saturation report with their iterations, as nested rows."""
    item = "struct<iteration:int,seconds:double,commit:string,coverage_ratio:double,artifact:string,queries:struct<equivalent_rows:bigint,token_ratio:double,latency_ratio:double>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"iterations_requested int, languages array<struct<language:string,status:string,iterations_run:int,non_improving_iterations:int,saturated:boolean,note:string,iterations:array<{item}>>>").alias("r"))
    rows = raw.select("r.iterations_requested", F.explode("r.languages").alias("l")).select("iterations_requested", "l.*")
    return rows.withColumn("saturated", F.coalesce("saturated", F.lit(False))).withColumn("iterations", F.transform("iterations", lambda x: F.struct(x["iteration"].alias("iteration"), x["seconds"].alias("seconds"), x["commit"].alias("commit"), x["coverage_ratio"].alias("coverage_ratio"), x["queries"]["equivalent_rows"].alias("comparable_rows"), x["queries"]["token_ratio"].alias("token_ratio"), x["queries"]["latency_ratio"].alias("latency_ratio"), x["artifact"].alias("artifact"))))


def supported_families(spark: SparkSession, path: str, sides: Sides) -> DataFrame:
    """Families of a fixture sweep as flat rows, with recall and precision of its oracle. (The schema is inferred from its readers.)"""
    s, r = sides.subject, sides.rival
    item = f"struct<language:string,category:string,fixture_path:string,{s}:struct<status:string,ok:boolean,seconds:double,metrics:struct<symbols:bigint,edges:bigint>>,{r}:struct<status:string,ok:boolean,support:struct<support:string>>,native_baseline:struct<tool:string,status:string,ok:boolean>,fixture_oracle:struct<recall:double,precision:double,missing_symbols:array<string>,extra_symbol_names_sample:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"results array<{item}>")["results"]).alias("x"))
    own, oracle = f"x.{s}", "x.fixture_oracle"
    return rows.select(
        F.col("x.language").alias("language"),
        F.col("x.category").alias("category"),
        F.lit("fixture sweep").alias("repo"),
        F.coalesce(F.nullif(F.col("x.fixture_path"), F.lit("")), F.lit("fixture")).alias("fixture"),
        F.col(f"{own}.seconds").alias("index_seconds"),
        F.col(f"{own}.metrics.symbols").alias("symbols"),
        F.col(f"{own}.metrics.edges").alias("edges"),
        F.col(f"{own}.metrics.symbols").alias("subject_definitions"),
        first_filled(F.col("x.native_baseline.tool"), F.col("x.native_baseline.status"), F.lit("fixture oracle")).alias("native_tool"),
        F.coalesce(F.col(f"x.{r}.support.support") == "detector_only", F.lit(False)).alias("detector_only"),
        F.col(f"{oracle}.recall").alias("oracle_recall"),
        F.col(f"{oracle}.precision").alias("oracle_precision"),
        F.col(f"{oracle}.missing_symbols").alias("missing_symbols"),
        F.col(f"{oracle}.extra_symbol_names_sample").alias("extra_symbols"),
    )


def oracle_gaps(families: DataFrame) -> DataFrame:
    """Families with missing or extra symbols."""
    return families.where((F.coalesce(F.size("missing_symbols"), F.lit(0)) > 0) | (F.coalesce(F.size("extra_symbols"), F.lit(0)) > 0))
