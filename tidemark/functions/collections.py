"""Maps, arrays and JSON with dynamic keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_entry(m: Column, test: Callable[[Column], Column]) -> Column:
    """The first entry (in document order) whose key passes, as a struct of key and value, or null."""
    return F.get(F.filter(F.map_entries(m), lambda e: test(e["key"])), 0)


def flags(*pairs: tuple[Column, str | Column]) -> Column:
    """The array of codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code if isinstance(code, Column) else F.lit(code)) for c, code in pairs]))


def union_sorted(c: Column) -> Column:
    """Aggregate: the distinct elements of all arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def sum_values(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0)))


def has_entries(m: Column) -> Column:
    return F.coalesce(F.size(m) > 0, F.lit(False))


def json_map(c: Column, value: str = "string") -> Column:
    """A JSON object as a map, null where it is none."""
    return F.from_json(c, f"map<string,{value}>")


def set_recall(expected: Column, found: Column) -> Column:
    n = F.size(F.array_distinct(expected))
    return F.when(n > 0, F.size(F.array_intersect(expected, found)) / n)


def set_precision(expected: Column, found: Column) -> Column:
    n = F.size(F.array_distinct(found))
    return F.when(n > 0, F.size(F.array_intersect(found, expected)) / n)
