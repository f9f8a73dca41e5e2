"""Aggregate operations, in three parts that compose at any level of nesting.

* `contribution`: what one value adds, a double that is null where the value does not count;
* `merge`: how contributions come together: sum, max, min, avg (a sum and a count) or distinct;
* `zero`: whether nothing at all means 0 or null.

A group of records folds contributions with Spark's grouped aggregates. An array inside a record folds
them with higher-order functions first, and the group folds the records' results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import months_back, within_period
from ..functions.history import any_in_tail, compare_with, sum_of, tail
from ..request import Aggregation

_MERGE = {
    "count": "sum",
    "count_rows": "sum",
    "count_distinct": "distinct",
    "sum": "sum",
    "avg": "avg",
    "min": "min",
    "max": "max",
    "worst_last_n": "max",
    "max_last_n": "max",
    "min_last_n": "min",
    "sum_last_n": "sum",
    "ever_has_last_n": "max",
    "count_last_n": "sum",
    "count_date_last_n": "sum",
    "count_since": "sum",
}
#: Operations that give 0 for nothing; the others give null.
_ZERO = {op for op, merge in _MERGE.items() if merge in ("sum", "distinct")} | {"ever_has_last_n", "min_last_n"}


def merge_of(op: str) -> str:
    """An unknown operation merges as max of nothing: null."""
    return _MERGE.get(op, "max")


def has_zero(op: str) -> bool:
    return op in _ZERO


def _null() -> Column:
    return F.lit(None).cast("double")


def contribution(a: Aggregation, v: Column, kind: T.DataType | None, today: dt.date, element: bool = False) -> Column:
    """What the value v of type kind adds under a's operation (for `distinct`: itself).

    `element` values are found even when they are null, so count_rows counts them.
    """
    op = a.op
    if kind is None:
        v, kind = F.lit(None).cast("double"), T.DoubleType()
    number = v.cast("double") if isinstance(kind, T.NumericType) else None
    history = kind.elementType if isinstance(kind, T.ArrayType) else None
    entries = v.cast("array<double>") if isinstance(history, T.NumericType) else None
    if op == "count_rows" and element:
        return F.lit(1.0)
    if op in ("count", "count_rows"):
        return F.when(v.isNotNull(), 1.0).otherwise(0.0)
    if op == "count_distinct":
        return v
    if op in ("sum", "avg", "min", "max"):
        return _null() if number is None else number
    if op in ("worst_last_n", "max_last_n", "min_last_n", "sum_last_n"):
        if number is not None:
            return number
        if entries is None:
            return _null()
        last = tail(entries, a.n)
        return {"min_last_n": F.array_min, "sum_last_n": sum_of}.get(op, F.array_max)(last)
    if op in ("ever_has_last_n", "count_last_n"):
        comparator = a.text("comparator", "$eq")
        if number is not None:
            return F.coalesce(compare_with(number, comparator, a.value), F.lit(False)).cast("double")
        return F.lit(0.0) if entries is None else any_in_tail(entries, a.n, comparator, a.value).cast("double")
    if op == "count_date_last_n" and isinstance(kind, T.StringType):
        return within_period(v, a.n, a.text("unit", "month"), a.params.get("ref_date"), today).cast("double")
    if op == "count_since" and isinstance(kind, T.StringType):
        return F.coalesce(v >= F.lit(months_back(today, a.n).isoformat()), F.lit(False)).cast("double")
    if op in ("count_date_last_n", "count_since"):
        return _null() if number is None else number
    return _null()


def fold_group(merge: str, x: Column) -> Column:
    """Grouped aggregate of contributions, one for each row."""
    return {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "distinct": F.countDistinct}[merge](x).cast("double")


def fold_array(op: str, items: Column) -> Column:
    """Contributions of one array, folded inside its record: a double, or (total, n) for avg; null for a null array."""
    merge = merge_of(op)
    if merge == "avg":
        n = F.size(F.filter(items, lambda x: x.isNotNull())).cast("double")
        folded = F.when(n > 0, F.struct(sum_of(items).alias("total"), n.alias("n")))
    elif merge == "distinct":
        folded = F.size(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).cast("double")
    else:
        folded = {"sum": sum_of, "max": F.array_max, "min": F.array_min}[merge](items)
    if has_zero(op) and merge in ("max", "min"):
        folded = F.when(F.size(items) == 0, 0.0).otherwise(folded)
    return F.when(items.isNotNull(), folded)


def is_pair(op: str, depth: int) -> bool:
    """Whether a record's result of an average over `depth` arrays is (total, n): each level collapses it in turn."""
    return merge_of(op) == "avg" and depth % 2 == 1


def fold_results(op: str, results: Column, pairs: bool) -> Column:
    """An enclosing array's fold of its elements' results; null results do not count."""
    some = F.filter(results, lambda x: x.isNotNull())
    merge = merge_of(op)
    if merge == "avg" and pairs:
        total, n = sum_of(F.transform(some, lambda x: x["total"])), sum_of(F.transform(some, lambda x: x["n"]))
        return F.when(n > 0, total / n)
    if merge == "distinct":
        return F.when(results.isNotNull(), sum_of(some))
    return fold_array(op, some)


def fold_records(op: str, result: Column, depth: int) -> Column:
    """Grouped aggregate of the records' results."""
    merge = merge_of(op)
    if is_pair(op, depth):
        return F.sum(result["total"]) / F.sum(result["n"])
    return fold_group("sum" if merge == "distinct" else merge, result)


def finish(op: str, x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0)) if has_zero(op) else x
