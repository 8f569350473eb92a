import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import sharding as S


def test_matrix_margins_and_law():
    sources, sizes = [5, 0, 17, 40], S.shard_sizes(62, 7)
    m = S.communication_matrix(sources, sizes, 1)
    assert m.sum(1).tolist() == sources and m.sum(0).tolist() == sizes.tolist()
    draws = [S.communication_matrix([10, 10], np.array([10, 10]), s)[0, 0] for s in range(2000)]
    assert abs(np.mean(draws) - 5) < 0.1 and abs(np.var(draws) - 10 * 0.5 * 0.5 * 10 / 19) < 0.15
    large = [S._large_hypergeometric(np.random.default_rng(s), 10, 10, 10) for s in range(2000)]
    assert abs(np.mean(large) - 5) < 0.1 and abs(np.var(large) - np.var(draws)) < 0.2


def test_query(spark, sf_dir):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = S.op8_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    slots = {}
    for r in rows:
        raw = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_places_are_uniform(spark):
    """Rows of one source land in all shards and slots alike (chi-square), also with equal values."""
    df = spark.createDataFrame([(i,) for i in range(4000)], "i int").repartition(4)
    rows = S.uniform_shards(df, 8, seed=11).collect()
    for part in (range(1000), range(3000, 4000)):
        n = np.bincount([r.shard for r in rows if r.i in part], minlength=8)
        assert ((n - 125) ** 2 / 125).sum() < 30
    low = np.mean([r.slot for r in rows if r.i < 1000])
    assert abs(low - 249.5) < 20
    assert rows != S.uniform_shards(df, 8, seed=12).collect()


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x", 1)] * 50 + [(1, None, 2)] * 3, "doc_id long, text string, slot int")
    out = S.uniform_shards(df, 5).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d")).collect()
    assert sorted(r.n for r in out) == [10, 10, 11, 11, 11] and all(r.n == r.d for r in out)
    assert S.uniform_shards(df.limit(0), 5).count() == 0


def test_large_draws_follow_the_law():
    """Against the exact probabilities, and for a population beyond numpy's bound."""
    from math import comb

    draws = np.bincount([S._large_hypergeometric(np.random.default_rng(s), 12, 7, 9) for s in range(4000)], minlength=10)
    exact = np.array([comb(12, k) * comb(7, 9 - k) / comb(19, 9) for k in range(10)]) * 4000
    assert ((draws - exact)[exact > 5] ** 2 / exact[exact > 5]).sum() < 25
    good, bad, n = 3 * 10**11, 10**11, 2 * 10**10
    many = np.array([S._large_hypergeometric(np.random.default_rng(s), good, bad, n) for s in range(200)], float)
    deviation = (n * 0.75 * 0.25 * (1 - n / (good + bad))) ** 0.5
    assert abs(many.mean() - 0.75 * n) < 4 * deviation / 200**0.5 and 0.8 < many.std() / deviation < 1.2


def test_exchange_equals_the_matrix(spark, tmp_path):
    """Rows go from each source to each shard exactly as often as the drawn matrix says."""
    spark.range(0, 3000, 1, 5).withColumn("p", F.spark_partition_id()).where("id % 7 <> p").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").select("id", F.spark_partition_id().alias("source"))
    rows = S.uniform_shards(df, 6, seed=3).collect()
    sources = sorted({r.source for r in rows})
    counts = [sum(r.source == s for r in rows) for s in sources]
    want = S.communication_matrix(counts, S.shard_sizes(len(rows), 6), 3)
    got = [[sum(r.source == s and r.shard == k for r in rows) for k in range(6)] for s in sources]
    assert got == want.tolist()
