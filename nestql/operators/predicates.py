"""The thirteen predicates, on a record's field or an element's.

A null and a missing field are the same. They match $ne, $nin, $null and equality with null, and no range.
An unknown predicate holds for everything.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import months_back
from ..functions.text import comparable, is_number


def _equals(v: Column, kind: T.DataType, operand: Any) -> Column:
    if operand is None:
        return v.isNull()
    a, b = comparable(v, kind, operand)
    return a == b


def _any_of(v: Column, kind: T.DataType, operands: list) -> Column:
    """One test against all operands: `isin` on numbers and on texts, so that it reaches the scan."""
    numeric = isinstance(kind, T.NumericType)
    groups: dict[bool, list[Column]] = {}
    sides: dict[bool, Column] = {}
    for x in operands:
        if x is not None:
            side, literal = comparable(v, kind, x)
            as_number = numeric and is_number(x)
            sides[as_number] = side
            groups.setdefault(as_number, []).append(literal)
    tests = [sides[k].isin(*g) for k, g in groups.items()]
    if None in operands:
        tests.append(v.isNull())
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(False)


def predicate(v: Column, kind: T.DataType | None, op: str, operand: Any, today: dt.date) -> Column:
    """Null counts as false, as it does to every filter: a test that is left bare can be pushed down to the scan.

    `kind` is None for a field that is nowhere in the schema.
    """
    if kind is None:
        v, kind = F.lit(None).cast("string"), T.StringType()
    if op == "$eq":
        return _equals(v, kind, operand)
    if op == "$ne":
        return v.isNotNull() if operand is None else v.isNull() | ~_equals(v, kind, operand)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        a, b = comparable(v, kind, operand)
        return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]
    if op == "$in":
        return _any_of(v, kind, operand) if isinstance(operand, (list, tuple)) else F.lit(False)
    if op == "$nin":
        return v.isNull() | ~_any_of(v, kind, operand) if isinstance(operand, (list, tuple)) else F.lit(True)
    if op == "$contains":
        if not isinstance(kind, T.StringType) or not isinstance(operand, str):
            return F.lit(False)
        return v.contains(operand)
    if op == "$notnull":
        return v.isNotNull()
    if op == "$null":
        return v.isNull()
    if op == "$within_months":
        if not isinstance(kind, T.StringType) or not is_number(operand):
            return F.lit(False)
        return v >= F.lit(months_back(today, int(operand)).isoformat())
    if op == "$between":
        ok = isinstance(kind, T.NumericType) and isinstance(operand, (list, tuple)) and len(operand) == 2 and all(map(is_number, operand))
        if not ok:
            return F.lit(False)
        (low, a), (high, b) = comparable(v, kind, operand[0]), comparable(v, kind, operand[1])
        return (low >= a) & (high <= b)
    return F.lit(True)


def all_of(conditions: Mapping[str, Mapping[str, Any]], value: Callable[[str], tuple[Column, T.DataType | None]], today: dt.date) -> Column | None:
    """Every predicate of every field; None where there is none."""
    tests = [predicate(*value(field), op, operand, today) for field, ops in conditions.items() for op, operand in ops.items()]
    return reduce(lambda a, b: a & b, tests) if tests else None
