from pyspark.sql import functions as F

from tidemark.operators.paired import paired_summary
from tidemark.streaming.windows import run_available, windowed_paired_summary


def test_windows_equal_the_batch_summary(spark, tmp_path):
    rows = spark.range(600).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 3).cast("string").alias("g"), F.lit(2.0).alias("subject_tokens"), (F.col("id") % 50).cast("double").alias("rival_tokens"), F.lit(1.0).alias("subject_ms"), F.lit(3.0).alias("rival_ms"), F.lit(False).alias("subject_missing"), (F.col("id") % 7 == 0).alias("rival_missing"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run_available(windowed_paired_summary(stream, "ts", "1 hour", "10 minutes", "g"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.start, r.g): (r["rows"], r.comparable_rows, r.token_ratio) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = paired_summary(rows.withColumn("start", F.date_trunc("hour", "ts")), "start", "g").collect()
    want = {(r.start, r.g): (r["rows"], r.comparable_rows, r.token_ratio) for r in batch}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 27  # the last window is still open
