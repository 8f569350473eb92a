"""Windowed paired summaries over a stream of measurements.

An extension beyond the batch operators: the same counts and sums per event-time window,
with a watermark that bounds the state. Ratios follow from the sums, so they are taken
after the aggregation and need no state of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.numbers import count_true, total
from tidemark.operators.paired import comparable, missing, with_ratios


def windowed_paired_summary(rows: DataFrame, time: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """``paired_summary`` per window and key; rows later than the watermark are left out."""
    ok = comparable()
    sums = rows.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(
        F.count("*").alias("rows"),
        count_true(ok).alias("comparable_rows"),
        count_true(missing("subject_missing")).alias("subject_missing_rows"),
        count_true(missing("rival_missing")).alias("rival_missing_rows"),
        *[total(F.when(ok, F.col(c))).alias(c) for c in ("subject_tokens", "rival_tokens", "subject_ms", "rival_ms")],
    )
    return with_ratios(sums.withColumn("start", F.col("window.start")).drop("window"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet until the available input is read."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
