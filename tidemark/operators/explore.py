"""The explorer: one flat row model, filters, search, null-last sorting, facets and bands."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import count_true
from tidemark.functions.strings import label

FILTERS = {
    "all": lambda: F.lit(True),
    "comparable": lambda: F.col("status") == "comparable",
    "not-comparable": lambda: F.col("status") == "not-comparable",
    "detector-only": lambda: F.col("status") == "detector-only",
    "exceeds-native": lambda: F.col("exceeds_native"),
    "supported": lambda: F.col("tier") == "supported",
    "core": lambda: F.col("tier") == "core",
    "live": lambda: F.col("tier") == "live",
}
METRICS = {"coverage": "coverage_ratio", "symbols": "symbols", "index": "index_seconds", "tokens": "token_ratio", "latency": "latency_ratio"}
SORTS = METRICS | {"edges": "edges", "language": "label"}
SEARCHED = ("language", "label", "repo", "commit", "native_tool")


def default_direction(sort: str) -> str:
    return "asc" if sort in ("language", "index") else "desc"


def union_tiers(*tiers: DataFrame) -> DataFrame:
    """All rows of all tiers; columns that a tier lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiers)


def with_status(rows: DataFrame) -> DataFrame:
    """Add label, status and exceeds_native to flat rows."""
    from tidemark.operators.classify import row_status

    return rows.withColumns({"label": label(F.col("language")), "status": row_status(F.col("token_ratio"), F.coalesce(F.col("detector_only"), F.lit(False))), "exceeds_native": F.coalesce(F.col("coverage_ratio") > 1.0001, F.lit(False))})


def matches(term: str, *columns: str) -> Column:
    """Case-blind substring search over several columns; an empty term matches all rows."""
    term = term.strip().lower()
    if not term:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term)) for c in columns])


def null_last(key: str, direction: str, tie: str = "label") -> list[Column]:
    """Order with nulls at the bottom both ways; among nulls by the tie column, else by key and tie."""
    c = F.col(key)
    first = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()
    return [first, F.col(tie).asc()]


def places(rows: DataFrame, group: str, key: Column, tie: str, name: str, order: Callable[[Column], Column], width: int = 100_000) -> DataFrame:
    """rows with their place within the group by key, in the given order, and by tie, a unique integer.

    A group is cut by its key and by ranges of width of the tie, so a large group is no
    single task: rows are counted within a cut, and the sizes of the cuts before it are
    added. Rows with a null tie come first in their cut.
    """
    cut = rows.withColumns({"__key": key, "__cut": F.floor(F.col(tie) / width)})
    parts = [group, "__key", "__cut"]
    local = cut.withColumn("__place", F.row_number().over(Window.partitionBy(*parts).orderBy(tie)))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy(order(F.col("__key")), F.col("__cut").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy(*parts).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    sizes = sizes.withColumnsRenamed({c: f"__of_{i}" for i, c in enumerate(parts)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate(parts)])
    return local.join(sizes, same).withColumn(name, F.col("__place") + F.col("__before")).select(*rows.columns, name)


def explore(rows: DataFrame, chip: str = "all", term: str = "", sort: str = "language", direction: str | None = None, searched: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Filtered, searched and sorted rows."""
    kept = rows.where(FILTERS[chip]() & matches(term, *searched))
    return kept.orderBy(*null_last(SORTS.get(sort, "label"), direction or default_direction(sort)))


def facets(rows: DataFrame) -> DataFrame:
    """Counts of every filter over all rows, in one pass (one row)."""
    return rows.agg(*[(F.count("*") if name == "all" else count_true(test())).alias(name.replace("-", "_")) for name, test in FILTERS.items()])


def band_starts(rows: DataFrame, flag: str, order: list[Column], *partition: str) -> DataFrame:
    """Mark rows where the flag turns from true to false, or is false in the first row."""
    before = F.lag(flag).over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("band_start", ~F.col(flag) & F.coalesce(before, F.lit(True)))
