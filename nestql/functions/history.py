"""Last-n positions of history arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def tail(history: Column, n: int) -> Column:
    """The last n entries, all where there are fewer, none for n under 1. Null entries keep their position."""
    if n < 1:
        return F.slice(history, 1, 0)
    return F.slice(history, F.greatest(F.size(history) - (n - 1), F.lit(1)), F.lit(n))


def compare_with(x: Column, comparator: str, target: float) -> Column:
    """A number against the target; a comparator other than the four ranges means equal within EPSILON."""
    t = F.lit(float(target))
    ranges = {"$gte": x >= t, "$gt": x > t, "$lte": x <= t, "$lt": x < t}
    return ranges.get(comparator, F.abs(x - t) < EPSILON)


def any_in_tail(history: Column, n: int, comparator: str, target: float) -> Column:
    return F.coalesce(F.exists(tail(history, n), lambda x: F.coalesce(compare_with(x, comparator, target), F.lit(False))), F.lit(False))


def sum_of(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))
