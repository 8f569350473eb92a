"""Numeric rules: absent and malformed values, ratios of sums, rounding."""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tolerance of coverage comparisons: parity from 1 - EPSILON, exceeding over 1 + EPSILON.
EPSILON = 1e-4
TARGET_RATIO = 10.0
LOW_RATIO = 5.0


def number(c: Column) -> Column:
    """c as a double; null for what is no finite number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def positive(c: Column) -> Column:
    """True only for numbers over zero; null and malformed values are false."""
    return number_or_zero(c) > 0


def total(c: Column) -> Column:
    """Sum in which absent values count as zero and the sum of nothing is zero."""
    return F.coalesce(F.sum(number(c)), F.lit(0.0))


def ratio(over: Column, under: Column) -> Column:
    """over / under, null unless under is positive."""
    return F.when(under > 0, over / under)


def rounded(c: Column, digits: int = 2) -> Column:
    """Half-up rounding of the decimal text of a double; null stays null."""
    return F.round(c, digits)


@F.pandas_udf(T.DoubleType())
def _fixed(values: pd.Series, digits: pd.Series) -> pd.Series:
    out = []
    for v, d in zip(values, digits, strict=True):
        finite = v is not None and v == v and abs(v) != float("inf")
        out.append(float(decimal.Decimal(float(v)).quantize(decimal.Decimal(1).scaleb(-int(d)), decimal.ROUND_HALF_UP)) if finite else None)
    return pd.Series(out, dtype="float64")


def rounded_strict(c: Column, digits: int = 2) -> Column:
    """Rounding of the exact binary value, ties away from zero: 1.005 gives 1.0.

    An Arrow UDF, for the rare values where it differs from ``rounded``.
    """
    return _fixed(c, F.lit(digits))


def gap_to_target(value: Column, passed: Column, target: float = TARGET_RATIO, digits: int = 2) -> Column:
    """1 if the target is reached, else target / value of the unrounded value."""
    return F.when(passed, F.lit(1.0)).otherwise(rounded(ratio(F.lit(target), value), digits))


def count_true(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def every(c: Column) -> Column:
    """True also for no rows."""
    return F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))


def some(c: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))


def bar_percent(value: Column, largest: Column) -> Column:
    """Share of the largest value in percent, at least 2."""
    return F.when(value.isNotNull(), F.greatest(F.lit(2.0), value / largest * 100))


def coverage_percent(value: Column, largest: Column) -> Column:
    """Place on an axis from 1 to the largest value (rounded up to 0.05, at least 1.05), 4 to 100."""
    end = F.greatest(F.lit(1.05), F.ceil(largest * 20) / 20)
    return F.when(value.isNotNull(), 4 + (F.greatest(F.lit(1.0), value) - 1) / (end - 1) * 96)


def axis_end(largest: Column) -> Column:
    """The next 0.2 step above, at least 1.2."""
    return F.greatest(F.lit(1.2), F.ceil(largest * 5 + 0.001) / 5)


def bar_thickness(value: Column, largest: Column) -> Column:
    return 8 + F.sqrt(value / largest) * 16
