"""Joins with a defined choice among several partners, and upserts.

The right side is reduced to one row per key first (a grouped minimum with partial
sums), so a key with many rows neither multiplies the left side nor gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The row that comes first (or last) by order within its key; order must be unique there."""
    rest = [c for c in df.columns if c not in keys]
    place, row = F.struct(*order), F.struct(*[F.col(c) for c in rest])
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(row, place).alias("__row")).select(*keys, "__row.*")


def left_first(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every left row with the first partner, or nulls."""
    return left.join(one_per_key(right, keys, order), keys, "left")


def left_last(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every left row with the last partner, or nulls."""
    return left.join(one_per_key(right, keys, order, last=True), keys, "left")


def unseen(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def listed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def upsert(base: DataFrame, added: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of base, the last of a key, and of added, the first of a key that base lacks.

    position orders the rows of either side. Null and empty keys are left out.
    """
    known = lambda df: df.where(" AND ".join(f"`{k}` IS NOT NULL AND CAST(`{k}` AS STRING) <> ''" for k in keys))
    ranked = known(base).withColumn("__rank", F.struct(F.lit(0).alias("source"), (-F.col(position)).cast("double").alias("place"))).unionByName(known(added).withColumn("__rank", F.struct(F.lit(1).alias("source"), F.col(position).cast("double").alias("place"))))
    rest = [c for c in base.columns if c not in keys]
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__rank").alias("__row")).select(*keys, "__row.*")


def ordered_by_list(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Listed names first, in the list's order, then the others by collation."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(F.lit(999)), F.collate(F.col(column), "UNICODE"))
