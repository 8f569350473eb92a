"""Coverage ratios, validation roll-ups, status flags and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.collections import first_entry, flags
from tidemark.functions.numbers import EPSILON, count_true, number, number_or_zero, rounded


def coverage_columns(coverage: Column, subject: str) -> dict[str, Column]:
    """From a map with dynamic keys: the first ``*_definition_ratio`` and the first ``<subject>_*_definition_symbols``."""
    by_ratio = first_entry(coverage, lambda k: F.endswith(k, F.lit("_definition_ratio")))
    by_subject = first_entry(coverage, lambda k: F.startswith(k, F.lit(f"{subject}_")) & F.endswith(k, F.lit("_definition_symbols")))
    return {
        "coverage_ratio": number(by_ratio["value"]),
        "coverage_key": by_ratio["key"],
        "subject_definitions": number(by_subject["value"]).cast("long"),
        "native_definitions": number(F.try_element_at(coverage, F.lit("native_definitions"))).cast("long"),
        "coverage_scope": F.try_element_at(coverage, F.lit("coverage_scope")),
    }


def repo_passes(repo: Column) -> Column:
    """Not marked false, and a ratio of parity or more."""
    return F.coalesce(repo["ok"], F.lit(True)) & (number_or_zero(repo["coverage_ratio"]) >= 1 - EPSILON)


def validation_columns(validation: Column, default_minimum: int = 3) -> dict[str, Column]:
    """From a struct with status, minimum_repos and an array repos: counts, least ratio, passed, status."""
    repos = validation["repos"]
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    given = number_or_zero(validation["minimum_repos"]).cast("int")
    least = F.when(given != 0, given).otherwise(F.lit(default_minimum))
    n, n_passed = size(repos), size(F.filter(repos, repo_passes))
    passed = (n >= least) & (n_passed >= least)
    return {
        "minimum_repos": least,
        "repo_count": n,
        "passed_repo_count": n_passed,
        "validation_passed": passed,
        "min_coverage_ratio": rounded(F.array_min(F.transform(repos, lambda r: number(r["coverage_ratio"]))), 4),
        "validation_status": F.coalesce(F.nullif(validation["status"], F.lit("")), F.when(passed, F.lit("passed")).when(n > 0, F.lit("partial")).otherwise(F.lit("missing"))),
    }


def validation_rollup(rows: DataFrame, *keys: str, default_minimum: int = 3) -> DataFrame:
    """``validation_columns`` over plain rows (ok, coverage_ratio): counts and minima, no arrays."""
    repo = {"ok": F.col("ok"), "coverage_ratio": F.col("coverage_ratio")}
    out = rows.groupBy(*keys).agg(F.count("*").alias("repo_count"), count_true(repo_passes(repo)).alias("passed_repo_count"), rounded(F.min(number(F.col("coverage_ratio"))), 4).alias("min_coverage_ratio"))
    passed = (F.col("repo_count") >= default_minimum) & (F.col("passed_repo_count") >= default_minimum)
    return out.withColumn("validation_passed", passed).withColumn("validation_status", F.when(passed, F.lit("passed")).when(F.col("repo_count") > 0, F.lit("partial")).otherwise(F.lit("missing")))


def status_columns(ratio: Column, comparable_rows: Column, token_ratio: Column, latency_ratio: Column, token_target: Column, latency_target: Column, pass_target: Column) -> dict[str, Column]:
    """Parity and target flags with the array of blocker codes.

    ``coverage_at_parity`` also stands for a ratio below parity.
    """
    is_comparable = F.coalesce(comparable_rows > 0, F.lit(False)) & token_ratio.isNotNull() & latency_ratio.isNotNull()
    exceeds = F.coalesce(ratio > 1 + EPSILON, F.lit(False))
    return {
        "is_comparable": is_comparable,
        "coverage_parity": F.coalesce(ratio >= 1 - EPSILON, F.lit(False)),
        "coverage_exceeds": exceeds,
        "strict_target": is_comparable & exceeds & pass_target,
        "blockers": flags((~exceeds & ratio.isNull(), "coverage_missing"), (~exceeds & ratio.isNotNull(), "coverage_at_parity"), (~is_comparable, "no_comparable_query_rows"), (is_comparable & ~token_target, "token_ratio_below_target"), (is_comparable & ~latency_target, "latency_ratio_below_target")),
    }


def band(ratio: Column, epsilon: float = EPSILON) -> Column:
    """exceed, parity or below."""
    return F.when(ratio > 1 + epsilon, F.lit("exceed")).when(ratio >= 1 - epsilon, F.lit("parity")).when(ratio.isNotNull(), F.lit("below"))


def coverage_counts(rows: DataFrame, *keys: str, ratio: str = "coverage_ratio", epsilon: float = EPSILON) -> DataFrame:
    """Counts by band; the parity count holds all rows that do not exceed, so also those below."""
    r = F.col(ratio)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(r).alias("with_ratio"), count_true(r <= 1 + epsilon).alias("parity_rows"), count_true(r > 1 + epsilon).alias("exceed_rows"), count_true(r < 1 - epsilon).alias("below_rows"))


def live_counts(rows: DataFrame) -> DataFrame:
    """All conditional counts over artifact rows in one pass (one row)."""
    is_comparable, ratio, passed = F.col("comparable_rows") > 0, F.col("coverage_ratio"), F.coalesce(F.col("validation_passed"), F.lit(False))
    parity = ratio <= 1 + EPSILON
    return rows.agg(
        F.count("*").alias("artifacts"),
        count_true(is_comparable).alias("with_comparable_rows"),
        count_true(F.col("comparable_rows") == 0).alias("without_comparable_rows"),
        count_true(is_comparable & F.col("pass_low")).alias("low_comparable"),
        count_true(is_comparable & F.col("token_target")).alias("token_target_comparable"),
        count_true(is_comparable & F.col("latency_target")).alias("latency_target_comparable"),
        count_true(is_comparable & F.col("pass_target")).alias("target_comparable"),
        count_true(is_comparable & F.col("strict_target")).alias("strict_target"),
        count_true(parity).alias("coverage_parity"),
        count_true(ratio > 1 + EPSILON).alias("coverage_exceed"),
        count_true(ratio < 1 - EPSILON).alias("coverage_below"),
        count_true(parity & is_comparable).alias("parity_comparable"),
        count_true(parity & is_comparable & F.col("token_target")).alias("parity_token_target"),
        count_true(parity & is_comparable & F.col("latency_target")).alias("parity_latency_target"),
        count_true(parity & is_comparable & F.col("pass_target")).alias("parity_target"),
        count_true(F.col("detector_only")).alias("detector_only"),
        count_true(passed).alias("validated"),
        count_true(passed & F.col("strict_target")).alias("validated_strict_target"),
        count_true(~passed).alias("validation_pending"),
    )


def gap_summary(rows: DataFrame, target: float = 10.0) -> DataFrame:
    """Counts of the gap report: they compare the *rounded* ratios with the target."""
    is_comparable = (F.col("comparable_rows") > 0) & F.col("token_ratio").isNotNull() & F.col("latency_ratio").isNotNull()
    tokens, latency = F.col("token_ratio") >= target, F.col("latency_ratio") >= target
    passed = F.coalesce(F.col("validation_passed"), F.lit(False))
    return rows.agg(
        F.count("*").alias("live_languages"),
        count_true(F.col("coverage_ratio") <= 1 + EPSILON).alias("parity_languages"),
        count_true(F.col("coverage_exceeds")).alias("coverage_exceed_languages"),
        count_true(is_comparable).alias("comparable_languages"),
        count_true(is_comparable & tokens).alias("token_target_comparable"),
        count_true(is_comparable & latency).alias("latency_target_comparable"),
        count_true(is_comparable & tokens & latency).alias("performance_target_comparable"),
        count_true(passed).alias("validated"),
        count_true(passed & F.col("coverage_exceeds")).alias("validated_exceed"),
    )


def parity_model(rows: DataFrame) -> DataFrame:
    """Rows with a ratio, on the parity side (at most exactly 1) or standing out, with axis figures."""
    kept = rows.where(F.col("coverage_ratio").isNotNull()).withColumn("stands_out", F.col("coverage_ratio") > 1.0)
    figures = kept.agg(F.greatest(F.lit(1.0), F.max("coverage_ratio")).alias("max_ratio"), F.min("coverage_ratio").alias("min_ratio"), F.greatest(F.lit(1).cast("long"), F.max(F.when(F.col("stands_out"), F.col("subject_definitions")))).alias("max_definitions"))
    return kept.crossJoin(F.broadcast(figures))  # one row of figures
