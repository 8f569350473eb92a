"""Paired measurements: comparable rows, ratios of sums, roll-ups and gap reports.

A paired row has ``subject_*`` and ``rival_*`` columns: tokens, ms and missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import LOW_RATIO, TARGET_RATIO, count_true, gap_to_target, positive, ratio, rounded, total


def missing(c: str) -> Column:
    """Absent means present."""
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def comparable(strict: bool = True) -> Column:
    """Both sides present and, if strict, all four measures over zero."""
    both = ~missing("subject_missing") & ~missing("rival_missing")
    if not strict:
        return both
    for c in ("subject_tokens", "rival_tokens", "subject_ms", "rival_ms"):
        both = both & positive(F.col(c))
    return both


def paired_summary(rows: DataFrame, *keys: str, target: float = TARGET_RATIO, low: float = LOW_RATIO) -> DataFrame:
    """One row per key: counts, sums over comparable rows, ratios of sums, flags and gaps.

    Flags and gaps use the unrounded ratios. Null keys are a group of their own. Sums
    are taken in two phases, so a hot key costs one partial row per task.
    """
    ok = comparable()
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        count_true(ok).alias("comparable_rows"),
        count_true(missing("subject_missing")).alias("subject_missing_rows"),
        count_true(missing("rival_missing")).alias("rival_missing_rows"),
        *[total(F.when(ok, F.col(c))).alias(c) for c in ("subject_tokens", "rival_tokens", "subject_ms", "rival_ms")],
    )
    return with_ratios(sums, target, low)


def with_ratios(sums: DataFrame, target: float = TARGET_RATIO, low: float = LOW_RATIO) -> DataFrame:
    tokens, latency = ratio(F.col("rival_tokens"), F.col("subject_tokens")), ratio(F.col("rival_ms"), F.col("subject_ms"))
    reached = lambda c, least: F.coalesce(c >= least, F.lit(False))
    return sums.select(
        *[c for c in sums.columns if c not in ("subject_ms", "rival_ms")],
        rounded(F.col("subject_ms"), 3).alias("subject_ms"),
        rounded(F.col("rival_ms"), 3).alias("rival_ms"),
        rounded(tokens).alias("token_ratio"),
        rounded(latency).alias("latency_ratio"),
        (reached(tokens, low) & reached(latency, low)).alias("pass_low"),
        reached(tokens, target).alias("token_target"),
        reached(latency, target).alias("latency_target"),
        (reached(tokens, target) & reached(latency, target)).alias("pass_target"),
        gap_to_target(tokens, reached(tokens, target), target).alias("token_gap"),
        gap_to_target(latency, reached(latency, target), target).alias("latency_gap"),
    )


def rollup(summaries: DataFrame, *keys: str) -> DataFrame:
    """Second level over ``paired_summary``: sums of its (rounded) sums, then ratios of sums."""
    out = summaries.groupBy(*keys).agg(
        F.count("*").alias("groups"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "comparable_rows", "rival_missing_rows")],
        *[total(F.col(c)).alias(c) for c in ("subject_tokens", "rival_tokens", "subject_ms", "rival_ms")],
        *[count_true(F.col(c)).alias(f"{c}_groups") for c in ("token_target", "latency_target", "pass_target")],
    )
    return out.withColumn("token_ratio", rounded(ratio(F.col("rival_tokens"), F.col("subject_tokens")))).withColumn("latency_ratio", rounded(ratio(F.col("rival_ms"), F.col("subject_ms")))).drop("subject_tokens", "rival_tokens", "subject_ms", "rival_ms")


def top_gaps(summaries: DataFrame, gap: str, *tie: str, n: int = 12) -> DataFrame:
    """The largest gaps over 1 among comparable rows; a report of n rows."""
    return summaries.where((F.col("comparable_rows") > 0) & (F.col(gap) > 1)).orderBy(F.col(gap).desc(), *tie).limit(n)


def near_misses(rows: DataFrame, value: str, *tie: str, most: float = 1.01, n: int = 20) -> DataFrame:
    """The n rows with the lowest value up to a limit; an absent value counts as 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return rows.where(v <= most).orderBy(v.asc(), *tie).limit(n)
