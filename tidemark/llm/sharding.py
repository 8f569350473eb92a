"""Uniform shuffle into shards of exact sizes.

1. Each source partition's counts per shard are drawn from the multivariate
   hypergeometric law, given the exact shard sizes: the counts that a uniform
   permutation of all rows would give.
2. Rows are permuted within their source partition; the first go to shard 0, the
   next to shard 1 and so on, as the counts say.
3. Rows are exchanged by shard and permuted again there; a row's place is its slot.

The matrix has at most ``MAX_SOURCES`` x shards cells, whatever the size of the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import Scratch

MAX_SOURCES = 4096
MAX_SHARDS = 4096
#: Rows that one task orders in a shard; larger shards are cut by the random key.
ROWS_PER_CUT = 1_000_000
MIN_CUTS = 16


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(sources: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Counts by (source, shard): rows sum to sources, columns to sizes; the law is exact up to rounding."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = sizes.astype(np.int64).copy(), np.zeros((len(sources), len(sizes)), np.int64)
    for i, n in enumerate(sources):
        # numpy's generator allows populations below 10**9; beyond that, split by halves.
        out[i] = _draw(rng, left, n)
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    if len(left) == 1:
        return np.array([n], np.int64)
    if left.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    half = len(left) // 2
    a, b = int(left[:half].sum()), int(left[half:].sum())
    k = _large_hypergeometric(rng, a, b, n)
    return np.concatenate([_draw(rng, left[:half], k), _draw(rng, left[half:], n - k)])


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw for populations of any size, by inversion of the weights around the mode.

    Weights are relative to the mode's, by products of their ratios, so no large logarithms
    cancel; those below 1e-20 of it are left out, which is beyond a draw's resolution.
    """
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def side(end: int, step: int) -> np.ndarray:
        parts, last, x = [], 1.0, mode
        while x != end and last > 1e-20:
            at = np.arange(x, end if abs(end - x) < 4096 else x + 4096 * step, step).astype(float)
            ratio = (good - at) * (n - at) / ((at + 1) * (bad - n + at + 1)) if step > 0 else at * (bad - n + at) / ((good - at + 1) * (n - at + 1))
            parts.append(last * np.cumprod(ratio))
            last, x = float(parts[-1][-1]), x + len(at) * step
        return np.concatenate(parts) if parts else np.zeros(0)

    up, down = side(high, 1), side(low, -1)
    total = np.cumsum(np.concatenate([[1.0], up, down]))
    k = min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(total) - 1)
    return mode + k if k <= len(up) else mode - (k - len(up))


def uniform_shards(df: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """df (all columns and rows) with ``shard`` (0 to shards - 1) and ``slot`` (0 to its size - 1).

    Shard sizes differ by one at most. A row's place follows from where it is stored,
    not from its values, so nulls, ties, repeated rows and hot keys are dealt as any
    other row. Input columns named shard or slot are replaced; an empty table gives an
    empty result.

    The rows are first written to the shared folder with their source partition and
    place in it. The draws depend on these, so a task that is run again after the
    loss of an executor deals every row to the same place.
    """
    if not 0 < shards <= MAX_SHARDS:
        raise ValueError(f"shards must be from 1 to {MAX_SHARDS}")
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = scratch.table(placed.withColumn("source", F.pmod("part", F.lit(MAX_SOURCES)).cast("int")), "placed")

    counts = sorted((r["source"], r["count"]) for r in placed.groupBy("source").count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    ends = spark.createDataFrame([(s, m.cumsum().tolist()) for (s, _), m in zip(counts, matrix, strict=True)], T.StructType([T.StructField("source", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))]))

    by_source = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.col("place")), "place")
    rank = placed.select("source", "place", (F.row_number().over(by_source) - 1).alias("rank"))
    dealt = rank.join(F.broadcast(ends), "source").select("place", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    cuts = max(MIN_CUTS, -(-total // (shards * ROWS_PER_CUT)))
    key = F.xxhash64(F.lit(seed + 1), F.col("place"))
    dealt = scratch.table(dealt.withColumn("key", key).withColumn("cut", F.pmod("key", F.lit(cuts)).cast("int")), "dealt")

    sizes: dict[int, list[int]] = {}
    for s, c, n in dealt.groupBy("shard", "cut").count().collect():
        sizes.setdefault(s, [0] * cuts)[c] = n
    offsets = spark.createDataFrame([(s, c, int(o)) for s, per in sorted(sizes.items()) for c, o in enumerate(np.cumsum([0, *per[:-1]]))], "shard int, cut int, offset long")
    in_cut = Window.partitionBy("shard", "cut").orderBy("key", "place")
    slots = dealt.join(F.broadcast(offsets), ["shard", "cut"]).select("place", "shard", (F.col("offset") + F.row_number().over(in_cut) - 1).alias("slot"))
    return placed.select("place", "row").join(slots, "place").select("row.*", "shard", "slot")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = uniform_shards(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
