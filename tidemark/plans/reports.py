"""The reports: each is a set of lazy tables over one folder of artifacts, plus renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.operators import evidence, readiness
from tidemark.operators.classify import EXTENSION_LANGUAGE, FAMILY_LANGUAGE, STRUCTURED, risk_reason, truth_risk
from tidemark.operators.coverage import gap_summary, live_counts
from tidemark.operators.explore import union_tiers, with_status
from tidemark.operators.joins import unseen, upsert
from tidemark.operators.paired import near_misses, rollup, top_gaps
from tidemark.sources.artifacts import Sides, core_matrix, coverage_audit, discover_sides, live_benchmarks, oracle_gaps, read_artifacts, saturation, supported_families
from tidemark.sources.files import exists, provenance, read_json
from tidemark.sources.sinks import json_document, markdown_summary, markdown_table


class Reports:
    """All reports of one folder of raw artifacts.

    Tables are derived from the artifacts each time, so no report can be older than
    its inputs. Optional inputs (matrix and saturation reports) may be missing.
    """

    def __init__(self, spark: SparkSession, folder: str, sides: Sides | None = None):
        self.spark, self.folder = spark, folder
        self.sides = sides or discover_sides(spark, f"{folder}/LIVE_*_BENCHMARK.json")
        self.artifacts = read_artifacts(spark, folder, self.sides)
        self.live = live_benchmarks(self.artifacts, self.sides)

    def core(self) -> DataFrame | None:
        path = f"{self.folder}/MATRIX_REPORT.json"
        return core_matrix(self.spark, path, self.sides) if exists(self.spark, path) else None

    def saturation(self) -> DataFrame:
        return saturation(self.spark, f"{self.folder}/SATURATION_REPORT.json")

    def discovery(self, name: str = "LANGUAGE_DISCOVERY.json") -> DataFrame:
        return read_json(self.spark, f"{self.folder}/*{name}", "rows array<array<string>>, detector_only_code_extensions array<string>, dispatch_count int, code_extension_count int")

    def supported(self, name: str = "SUPPORTED_LANGUAGE_BENCHMARK.json") -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return supported_families(self.spark, path, self.sides) if exists(self.spark, path) else None

    def provenance(self) -> DataFrame:
        return provenance(self.spark, self.folder).orderBy("name")

    def coverage_audit(self) -> DataFrame:
        return coverage_audit(self.discovery(), self.live)

    # The gap report.

    def gap_summary(self) -> DataFrame:
        return gap_summary(self.live)

    def live_counts(self) -> DataFrame:
        return live_counts(self.live)

    def core_counts(self) -> DataFrame | None:
        core = self.core()
        return None if core is None else rollup(core)

    def gaps(self, measure: str) -> DataFrame:
        return top_gaps(self.live, f"{measure}_gap", "language")

    def near_misses(self) -> DataFrame:
        repos = self.live.select("language", F.posexplode("repos").alias("position", "r")).select("language", "position", "r.repo", "r.coverage_ratio", "r.subject_definitions", "r.native_definitions")
        return near_misses(repos, "coverage_ratio", "language", "position")

    # Evidence.

    def precision(self) -> DataFrame:
        return evidence.precision_evidence(self.artifacts, self.sides.subject)

    def precision_summary(self) -> DataFrame:
        return evidence.precision_summary(self.precision())

    def calls(self) -> DataFrame:
        return evidence.call_evidence(self.artifacts.select("language", "file", "detector_only", "subject_calls", "typed_calls", "rival_calls", "edges", "rival_edges"))

    def call_summary(self) -> DataFrame:
        live, core = self.calls(), self.core()
        core = evidence.call_evidence(core) if core is not None else live.limit(0)
        return evidence.call_summary(core, live)

    def support(self) -> DataFrame:
        found = self.discovery()
        family = F.create_map(*[F.lit(x) for kv in FAMILY_LANGUAGE.items() for x in kv])
        extension = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
        rows = found.select(F.posexplode("rows").alias("position", "r")).select("position", F.coalesce(F.try_element_at(family, F.col("r")[0]), F.col("r")[0]).alias("language"), F.col("r")[2].alias("extractor"), F.col("r")[1].alias("extensions"))
        detected = found.select(F.posexplode("detector_only_code_extensions").alias("position", "extensions")).select("position", F.coalesce(F.try_element_at(extension, F.col("extensions")), F.regexp_replace("extensions", r"^\.", "")).alias("language"), F.lit("detector only").alias("extractor"), "extensions")
        return evidence.support(self.artifacts, rows, detected)

    def support_summary(self) -> DataFrame:
        return evidence.support_summary(self.support())

    def validation(self) -> DataFrame:
        return evidence.validation_messages(self.artifacts)

    def validation_gate(self) -> DataFrame:
        return evidence.validation_gate(self.validation())

    def repo_readiness(self, rewrites: list[tuple[str, str]] | None = None) -> DataFrame:
        return readiness.repo_rows(self.artifacts, self.sides.subject, self.sides.rival, rewrites)

    def readiness(self, rewrites: list[tuple[str, str]] | None = None) -> DataFrame:
        return readiness.readiness(self.artifacts, self.repo_readiness(rewrites))

    def readiness_summary(self, rewrites: list[tuple[str, str]] | None = None) -> DataFrame:
        return readiness.readiness_summary(self.readiness(rewrites))

    # The final audit.

    def weak_truth(self) -> DataFrame:
        columns = [F.col(c) for c in ("language", "native_tool", "detector_only", "validation_passed")]
        rows = self.live.withColumn("risk", truth_risk(*columns, F.col("coverage_ratio"))).where("risk <> 'low'")
        return rows.select("language", "native_tool", "risk", "detector_only", "coverage_ratio", "validation_passed", "min_coverage_ratio", risk_reason(*columns).alias("reason"))

    def precision_gaps(self) -> DataFrame:
        return self.precision().where("status <> 'sampled-name-location'").orderBy(F.collate("language", "UNICODE"))

    def low_risk_without_gaps(self) -> DataFrame:
        columns = [F.col(c) for c in ("language", "native_tool", "detector_only", "validation_passed", "coverage_ratio")]
        return unseen(self.live.where(truth_risk(*columns) == "low").select("language"), self.precision_gaps(), ["language"])

    def pending_code(self) -> DataFrame:
        return self.live.where(~F.col("language").isin(*STRUCTURED) & ~F.col("validation_passed")).select("language")

    def tools(self, manifest: DataFrame | None = None) -> DataFrame:
        """Tools of a manifest (the last row of a tool) and of artifacts (the first, if not in the manifest)."""
        live = self.artifacts.orderBy("file").select(F.col("native.tool").alias("tool"), F.col("native.status").alias("status"), F.col("native.ok").alias("ok"), F.coalesce(F.nullif(F.col("native.command"), F.lit("")), F.col("native.status")).alias("version"), F.hash("file").alias("position"))
        base = manifest if manifest is not None else live.limit(0)
        return upsert(base, live, ["tool"], "position").orderBy(F.collate("tool", "UNICODE"))

    def final_audit(self) -> str:
        """All summaries and the weak points, as one Markdown document. Missing inputs are named, not guessed."""
        parts = ["# Final audit\n"]
        for title, table in (("Counts", self.live_counts()), ("Gap summary", self.gap_summary()), ("Validation", self.validation_gate()), ("Readiness", self.readiness_summary()), ("Sampled evidence", self.precision_summary()), ("Calls", self.call_summary()), ("Support", self.support_summary())):
            parts.append(f"## {title}\n\n{markdown_summary(table)}")
        core, supported = self.core_counts(), self.supported()
        parts.append("## Core matrix\n\n" + ("The matrix report is not present.\n" if core is None else markdown_summary(core)))
        parts.append("## Supported families\n\n" + ("The fixture sweep is not present.\n" if supported is None else markdown_table(oracle_gaps(supported).select("language", "oracle_recall", "oracle_precision", "missing_symbols", "extra_symbols").limit(80))))
        for title, table in (("Weak ground truth", self.weak_truth()), ("Evidence gaps", self.precision_gaps().select("language", "status", "proven_rows", "comparable_rows")), ("Near misses", self.near_misses()), ("Low risk without gaps", self.low_risk_without_gaps()), ("Pending code languages", self.pending_code()), ("Inputs", self.provenance())):
            parts.append(f"## {title}\n\n{markdown_table(table)}")
        return "\n".join(parts)

    # The explorer.

    def explorer(self, supported: DataFrame | None = None) -> DataFrame:
        """Flat rows of all tiers; supported families only where no other tier has the language."""
        core = self.core()
        live = self.live.withColumn("tier", F.lit("live")).withColumn("detector_only", F.col("detector_only") | F.col("language").isin("ejs", "ets", "r"))
        tiers = [live.drop("blockers", "repos")]
        if core is not None:
            tiers.insert(0, core.drop("native_tools").withColumn("tier", F.lit("core")).withColumn("detector_only", F.lit(False)))
        known = union_tiers(*tiers)
        if supported is not None:
            known = union_tiers(known, unseen(supported, known, ["language"]).withColumn("tier", F.lit("supported")))
        return with_status(known)

    def hero(self) -> DataFrame:
        """Least, median and largest subject tokens and the fastest index, with their languages (first row wins)."""
        return token_figures(self.live, "subject_tokens", "index_seconds", "language")

    def markdown(self, name: str) -> str:
        """A report as Markdown: gap, precision, calls, support, validation or readiness."""
        parts = {"gap": (self.gap_summary, lambda: self.live.select("language", "coverage_ratio", "token_ratio", "latency_ratio", "blockers")), "precision": (self.precision_summary, self.precision), "calls": (self.call_summary, self.calls), "support": (self.support_summary, self.support), "validation": (self.validation_gate, lambda: self.validation().select("language", "status", "repo_count", "passed_repo_count", "errors", "warnings")), "readiness": (self.readiness_summary, self.readiness)}
        summary, rows = parts[name]
        return f"# {name.capitalize()} report\n\n{markdown_summary(summary())}\n{markdown_table(rows().drop('validation', 'repos', 'queries'))}"

    def json(self, name: str) -> str:
        tables = {"gap": self.gap_summary, "precision": self.precision_summary, "calls": self.call_summary, "support": self.support_summary, "validation": self.validation_gate, "readiness": self.readiness_summary}
        return json_document(tables[name](), report=name)


def token_figures(rows: DataFrame, tokens: str, seconds: str, name: str) -> DataFrame:
    """One row: min, max, median (the mean of the middle two rounded half up) and who holds the ends."""
    t, s = F.col(tokens), F.col(seconds)
    median = F.median(t)
    return rows.agg(F.min(t).alias("least"), F.max(t).alias("largest"), F.when(F.count(t) % 2 == 0, F.floor(median + 0.5)).otherwise(median).cast("double").alias("median"), F.min_by(name, F.when(t.isNotNull(), F.struct(t, F.col(name)))).alias("least_name"), F.min_by(name, F.when(t.isNotNull(), F.struct(-t, F.col(name)))).alias("largest_name"), F.min(s).alias("fastest"), F.min_by(name, F.when(s.isNotNull(), F.struct(s, F.col(name)))).alias("fastest_name"))


def ratio_ends(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The names of the widest and narrowest value, nulls skipped."""
    v = F.col(value)
    kept = rows.where(v.isNotNull())
    return kept.agg(F.min_by(name, F.struct(-v, F.col(name))).alias("widest"), F.min_by(name, F.struct(v, F.col(name))).alias("narrowest"), rounded(F.max(v), 4).alias("max_ratio"), rounded(F.min(v), 4).alias("min_ratio"))
