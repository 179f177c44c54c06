"""Null- and zero-safe column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENT_MONTHS = -12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division; NULL when the denominator is zero or either side is NULL."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def exact_mean(value: Column) -> Column:
    """Mean of fractions that does not depend on the order in which rows are added up.

    Each value is cut at 20 and 50 binary digits; sums of either part are exact for some million rows, so
    equal rows give equal means. Values of 2^32 and more are added as they are.
    """
    coarse = F.when(F.abs(value) < 2.0**32, F.floor(value * 2.0**20) / 2.0**20).otherwise(value)
    rest = F.floor((value - coarse) * 2.0**50) / 2.0**50
    return ratio(F.sum(coarse) + F.sum(rest), F.count(value))


def tally(condition: Column) -> Column:
    """Rows for which the condition holds; 0 when there are none."""
    return F.count_if(condition)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it fails or is NULL."""
    return F.when(condition, 1).otherwise(0)


def recent(months: Column | str = "MONTHS_BALANCE") -> Column:
    return col(months) >= RECENT_MONTHS


def at_least_zero(value: Column) -> Column:
    """Clamp at zero. A NULL counts as zero, because greatest skips NULLs."""
    return F.greatest(value, F.lit(0.0))


def present_mean(*names: str) -> Column:
    """Mean of the non-NULL columns, NULL when all are NULL."""
    total = reduce(add, (F.coalesce(F.col(n), F.lit(0.0)) for n in names))
    return ratio(total, reduce(add, (flag(F.col(n).isNotNull()) for n in names)))


def absent_count(*names: str) -> Column:
    return reduce(add, (flag(F.col(n).isNull()) for n in names))


def status_is(name: str, *values: str) -> Column:
    """Case-insensitive membership test."""
    return F.lower(name).isin(*values)


def logit(probability: Column | str) -> Column:
    """Log-odds of a probability clipped to [1e-6, 1 - 1e-6]."""
    p = F.least(F.greatest(col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def tenth(rank: Column | str, rows: Column | str) -> Column:
    """ceil(rank * 10 / rows) as an INT in 1..10.

    Not ntile(10): that fills the first bins first, this formula the last ones.
    """
    r, n = col(rank), col(rows)
    return F.ceil(r * 10 / n).cast("int")


def top_rows(rows: Column | str, rate: float) -> Column:
    """How many rows a selection rate covers: at least one."""
    if not 0 < rate <= 1:
        raise ValueError(f"A rate of {rate} selects nothing or more than all")
    return F.greatest(F.lit(1), F.ceil(col(rows) * F.lit(rate)))
