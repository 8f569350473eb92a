"""Remeasurement readiness: replay commands, candidates for native commands, blockers, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.collections import flags
from tidemark.functions.numbers import count_true, number, rounded
from tidemark.functions.strings import after_marker, filled, first_filled, padded_index, slug
from tidemark.operators.classify import STRUCTURED, tool_class, tool_risk
from tidemark.operators.coverage import validation_columns
from tidemark.operators.evidence import command_blockers

COUNTED = ("pinned", "candidate_ready", "executable_ready", "native_ready", "fully_ready")


def local_folder(language: Column, repo: Column, position: Column) -> Column:
    """work/<language>/<01>-<owner>__<name>: only the first slash of the slug is replaced."""
    return F.concat(F.lit("work/"), language, F.lit("/"), padded_index(position), F.lit("-"), F.regexp_replace(slug(repo), r"^([^/]*)/", "$1__"))


def local_target(folder: Column, path: Column) -> Column:
    target = after_marker(path)
    return F.when(target == ".", folder).otherwise(F.concat(folder, F.lit("/"), target))


def replay_commands(repo: Column, commit: Column, folder: Column, target: Column, subject: str, rival: str) -> Column:
    """The commands that clone a repository at its commit and index it with both sides."""
    return F.array(
        F.concat(F.lit("git clone "), repo, F.lit(" "), folder),
        F.concat(F.lit("git -C "), folder, F.lit(" checkout "), commit),
        F.concat(F.lit(f"{subject} index "), target, F.lit(" --db sqlite://"), folder, F.lit(f"/.{subject}/{subject}.db --reindex --json")),
        F.concat(F.lit("rm -rf "), target, F.lit(f"/{rival}-out")),
        F.concat(F.lit("(cd "), target, F.lit(f" && uv tool run --from {rival}y {rival} update .)")),
    )


def candidate(template: Column, source: Column, target: Column, rewrites: list[tuple[str, str]]) -> Column:
    """The template with the recorded target path (also with and without /private) replaced everywhere, then the first occurrence of each known helper."""
    from tidemark.functions.strings import replace_first

    bare = F.regexp_replace(source, "^/private", "")
    out = template
    for path in (source, bare, F.concat(F.lit("/private"), source)):
        out = F.when(filled(path).isNotNull(), F.replace(out, path, target)).otherwise(out)
    for find, put in rewrites:
        out = replace_first(out, find, put)
    return out


def repo_rows(artifacts: DataFrame, subject: str, rival: str, rewrites: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per validation repository, with readiness flags and blockers."""
    base = artifacts.withColumn("tool_class", tool_class(F.col("language"), F.col("native.tool"), F.col("detector_only")))
    base = base.withColumn("risk", tool_risk(F.col("language"), F.col("tool_class"), F.col("detector_only"))).withColumn("template", first_filled(F.col("native_command"), F.col("native.command")))
    rows = base.select("language", "file", "tool_class", "risk", "template", "target_path", F.posexplode("repos").alias("position", "r"))
    folder = local_folder(F.col("language"), F.col("r.repo"), F.col("position"))
    rows = rows.withColumn("folder", folder).withColumn("target", local_target(F.col("folder"), F.col("r.target_path")))
    pinned = filled(F.col("r.repo")).isNotNull() & filled(F.col("r.commit")).isNotNull() & filled(F.col("r.target_path")).isNotNull()
    rows = rows.withColumn("pinned", pinned).withColumn("candidate", F.when(F.col("pinned") & F.col("template").isNotNull(), candidate(F.col("template"), F.col("target_path"), F.col("target"), rewrites or [])))
    rows = rows.withColumn("candidate_ready", F.col("candidate").isNotNull()).withColumn("candidate_blockers", F.when(F.col("candidate_ready"), command_blockers(F.col("candidate"), f"{subject}-")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("executable_ready", F.col("candidate_ready") & (F.size("candidate_blockers") == 0)).withColumn("native_ready", F.coalesce(filled(F.col("r.native_command")).isNotNull(), F.lit(False))).withColumn("fully_ready", F.col("pinned") & F.col("native_ready"))
    head = flags((~F.col("pinned"), "missing repo/commit/target_path"), (~F.col("native_ready"), "native_or_proxy_remeasurement_command_not_recorded"), (~F.col("candidate_ready"), "native_or_proxy_remeasurement_candidate_not_generated"))
    tail = flags((F.col("risk") == "medium", "proxy_denominator_not_full_semantic_truth"), (F.col("risk") == "high", "detector_only_or_weak_proxy_truth"), (F.lit(True), "full_symbol_name_kind_location_sets_not_persisted"))
    rows = rows.withColumn("blockers", F.array_distinct(F.concat(head, F.col("candidate_blockers"), tail)))
    return rows.withColumn("commands", F.when(F.col("pinned"), replay_commands(F.col("r.repo"), F.col("r.commit"), F.col("folder"), F.col("target"), subject, rival)))


def readiness(artifacts: DataFrame, repos: DataFrame) -> DataFrame:
    """Per artifact: counts of ready repositories, blockers, errors and status."""
    per = repos.groupBy("file").agg(
        F.count("*").alias("repo_rows"),
        *[count_true(F.col(c)).alias(f"{c}_rows") for c in COUNTED],
        count_true(F.array_contains("candidate_blockers", "native_command_contains_placeholder")).alias("placeholder_rows"),
        count_true(F.array_contains("candidate_blockers", "native_command_uses_ephemeral_helper_path")).alias("ephemeral_rows"),
        rounded(F.min(number(F.col("r.coverage_ratio"))), 4).alias("min_coverage"),
        F.array_distinct(F.flatten(F.collect_list("blockers"))).alias("row_blockers"),
    )
    cols = validation_columns(F.col("validation"))
    joined = artifacts.withColumns({k: cols[k] for k in ("minimum_repos", "validation_passed")}).join(per, "file", "left")
    present, structured = F.col("validation").isNotNull(), F.col("language").isin(*STRUCTURED)
    passed = present & (F.coalesce(F.col("validation.status"), F.lit("")) != "failed") & F.col("validation_passed")
    blockers = F.concat(F.coalesce("row_blockers", F.array().cast("array<string>")), flags((structured, "structured_format_outside_code_parser_gate"), (~present, "no_public_repo_validation_rows")))
    return joined.select(
        "language",
        "file",
        structured.alias("is_structured"),
        F.when(present & passed, F.lit("passed")).when(present, F.lit("failed")).when(structured, F.lit("structured-no-validation")).otherwise(F.lit("missing")).alias("validation_status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("repo_rows", *[f"{c}_rows" for c in COUNTED], "placeholder_rows", "ephemeral_rows")],
        "min_coverage",
        F.array_sort(F.array_distinct(blockers)).alias("blockers"),
        flags((~present & ~structured, "missing multi_repo_validation block for code language"), (present & ~passed, "multi_repo_validation does not meet minimum passing repo count")).alias("errors"),
    )


def readiness_summary(rows: DataFrame) -> DataFrame:
    """Global counts and the gate (one row)."""
    return rows.agg(F.count("*").alias("artifacts"), count_true(~F.col("is_structured")).alias("code_artifacts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repo_rows", *[f"{c}_rows" for c in COUNTED], "placeholder_rows", "ephemeral_rows")], F.coalesce(F.bool_and(F.size("errors") == 0), F.lit(True)).alias("passed"))
