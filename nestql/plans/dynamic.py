"""Requests over records whose types differ from row to row.

Records are JSON texts. Tasks decode them, fold each record in Python and add up what they can by group, so
what is shuffled is one row for each group, aggregation and batch (and each distinct text, for distinct
counts over records); Spark merges those. This lane is exact where the typed one cannot be: null and
missing differ, numbers and texts may share a field, and a path through a scalar ends there.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterator, Mapping
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cut_off, months_back, parse_date
from ..functions.history import EPSILON
from ..functions.text import NULL_TEXT, is_number, literal_text
from ..operators.aggregates import has_zero, merge_of
from ..request import Aggregation, Request
from .planner import Options

#: Text of a missing group field, and what stands between group fields.
MISSING_TEXT, KEY_SEPARATOR = "__nil__", "|||"
#: Records from which array levels are learnt.
SAMPLE = 10

for _module in ("nestql.plans.dynamic", "nestql.functions.dates", "nestql.functions.history", "nestql.functions.text", "nestql.operators.aggregates", "nestql.request"):
    if _module in sys.modules:
        cloudpickle.register_pickle_by_value(sys.modules[_module])


def text_of(v: Any) -> str:
    if isinstance(v, list):
        return "[" + " ".join(map(text_of, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{text_of(v[k])}" for k in sorted(v)) + "]"
    return literal_text(v)


def find(record: Any, path: str) -> tuple[Any, bool]:
    """(value, found): whatever stands where the walk ends or can go no further; else a literal dotted name of the record."""
    now = record
    for name in path.split("."):
        if not isinstance(now, dict):
            return now, True
        if name not in now:
            return (record[path], True) if isinstance(record, dict) and path in record else (None, False)
        now = now[name]
    return now, True


def holder(record: dict, path: str) -> tuple[dict | None, str]:
    """The object that holds the last name of a path; None if the way there leaves objects."""
    *way, last = path.split(".")
    now: Any = record
    for name in way:
        now = now.get(name) if isinstance(now, dict) else None
    return (now, last) if isinstance(now, dict) else (None, last)


def array_paths(value: Any, prefix: str = "") -> set[str]:
    """Paths of arrays whose first element is an object."""
    found: set[str] = set()
    if isinstance(value, dict):
        for name, v in value.items():
            found |= array_paths(v, f"{prefix}.{name}" if prefix else name)
    elif isinstance(value, list) and value and isinstance(value[0], dict):
        found = {prefix} | array_paths(value[0], prefix)
    return found


def _compare(a: Any, b: Any) -> int:
    x, y = (float(a), float(b)) if is_number(a) and is_number(b) else (text_of(a).encode(), text_of(b).encode())
    return (x > y) - (x < y)


def holds(v: Any, found: bool, op: str, operand: Any, today: dt.date) -> bool:
    if op in ("$in", "$nin"):
        among = isinstance(operand, list) and found and any(_compare(v, x) == 0 for x in operand)
        return among if op == "$in" else not found or v is None or not isinstance(operand, list) or not among
    if op == "$contains":
        return isinstance(v, str) and isinstance(operand, str) and operand in v
    if op in ("$null", "$notnull"):
        return (v is None) == (op == "$null")
    if op == "$within_months":
        return isinstance(v, str) and is_number(operand) and v >= months_back(today, int(operand)).isoformat()
    if op == "$between":
        return isinstance(operand, list) and len(operand) == 2 and all(map(is_number, [v, *operand])) and operand[0] <= v <= operand[1]
    tests = {"$eq": lambda c: c == 0, "$gt": lambda c: c > 0, "$gte": lambda c: c >= 0, "$lt": lambda c: c < 0, "$lte": lambda c: c <= 0}
    if op == "$ne":
        return not found or _compare(v, operand) != 0
    return tests[op](_compare(v, operand)) if op in tests and found else op not in tests


def matches(record: Any, conditions: Mapping[str, Mapping[str, Any]], today: dt.date) -> bool:
    return all(holds(*find(record, f), op, x, today) for f, ops in conditions.items() for op, x in ops.items())


class _Window:
    def __init__(self, a: Aggregation, today: dt.date):
        given = parse_date(a.params.get("ref_date"))
        self.end, self.closed = given or today, given is not None
        self.begin = cut_off(self.end, a.n, a.text("unit", "month"))

    def has(self, text: str) -> bool:
        day = parse_date(text)
        return day is not None and day <= self.end and (day >= self.begin if self.closed else day > self.begin)


def _hits(a: Aggregation, x: Any) -> bool:
    if not is_number(x):
        return False
    tests = {"$gte": x >= a.value, "$gt": x > a.value, "$lte": x <= a.value, "$lt": x < a.value}
    return tests.get(a.text("comparator", "$eq"), abs(x - a.value) < EPSILON)


def contribution(a: Aggregation, v: Any, today: dt.date) -> float | str | None:
    """What one value adds; None where it does not count."""
    if a.op == "count_rows":
        return 1.0
    if a.op == "count":
        return float(v is not None)
    if a.op == "count_distinct":
        return None if v is None else text_of(v)
    number = float(v) if is_number(v) else None
    if a.op in ("sum", "avg", "min", "max"):
        return number
    if a.op in ("count_date_last_n", "count_since"):
        if isinstance(v, str):
            return float(v >= months_back(today, a.n).isoformat() if a.op == "count_since" else _Window(a, today).has(v))
        return number
    if a.op not in ("worst_last_n", "max_last_n", "min_last_n", "sum_last_n", "ever_has_last_n", "count_last_n"):
        return None
    if isinstance(v, list):
        last = [x for x in (v[-a.n :] if a.n > 0 else []) if is_number(x)]
        if a.op in ("ever_has_last_n", "count_last_n"):
            return float(any(_hits(a, x) for x in last))
        if a.op == "sum_last_n":
            return float(sum(last))
        return float((min if a.op == "min_last_n" else max)(last)) if last else None
    if a.op in ("ever_has_last_n", "count_last_n"):
        return float(_hits(a, v))
    return number


def fold(op: str, items: list, merge: str | None = None) -> Any:
    """Contributions, or results of inner arrays, of one array: a number, a (total, n) pair, or None."""
    merge = merge or merge_of(op)
    if not items:
        return 0.0 if has_zero(op) else None
    some = [x for x in items if x is not None]
    if merge == "avg":
        pairs = [x for x in some if isinstance(x, tuple)]
        total = sum(p[0] for p in pairs) + sum(x for x in some if not isinstance(x, tuple))
        n = sum(p[1] for p in pairs) + len(some) - len(pairs)
        return None if not n else total / n if pairs else (total, n)
    if merge == "distinct":
        return float(len(set(some)))
    if merge == "sum":
        return float(sum(some))
    return {"max": max, "min": min}[merge](some, default=None)


class DynamicPlan:
    """One request over a DataFrame of JSON texts `value` with an id whose order is the records' order."""

    def __init__(self, lines: DataFrame, row_id: str, request: Request, today: dt.date, options: Options = Options()):
        if replace(options, ordered=True) != Options():
            raise ValueError("datasets whose types differ from row to row have no other option than `ordered`")
        self.lines, self.row_id, self.request, self.today, self.ordered = lines, row_id, request, today, options.ordered
        sample = [json.loads(r.value) for r in lines.orderBy(row_id).limit(SAMPLE).collect()]
        levels = [array_paths(r) for r in sample]
        self.arrays = next((x for x in levels if x), levels[0] if levels else set())
        self.empty = not sample
        for a in request.aggregations:
            if a.field in self.arrays:
                raise ValueError(f"field {a.field!r} is an array of objects; aggregate one of its fields")
        self._route()
        grouped = [p for f in request.group_by if (p := self._around(f))]
        self.explode = min(grouped, key=len) if grouped else ""

    def _around(self, field: str) -> str:
        """The nearest array of objects around a field."""
        names = field.split(".")
        return next((p for i in range(len(names) - 1, 0, -1) if (p := ".".join(names[:i])) in self.arrays), "")

    def _ancestors(self, field: str) -> list[str]:
        names = field.split(".")
        return [p for i in range(1, len(names)) if (p := ".".join(names[:i])) in self.arrays]

    def _route(self) -> None:
        r = self.request
        self.where: dict = {}
        self.element: dict[str, dict] = {}
        for field, ops in r.where.items():
            path = self._around(field) if r.filter_mode != "manual" else ""
            (self.element.setdefault(path, {}) if path else self.where)[field] = ops
        for path, fields in r.local_filter.items():
            self.element.setdefault(path, {}).update(fields)
        self.element = {p: {f.removeprefix(f"{p}."): ops for f, ops in fields.items()} for p, fields in self.element.items() if fields}

    # In a task ---------------------------------------------------------------------------------------------

    def _filtered(self, record: dict) -> dict | None:
        for path, conditions in self.element.items():
            at, name = holder(record, path)
            if at is not None and isinstance(at.get(name), list):
                at[name] = [e for e in at[name] if isinstance(e, dict) and matches(e, conditions, self.today)]
        return record if matches(record, self.where, self.today) else None

    def _record_result(self, record: dict, field: str, ancestors: list[str], a: Aggregation, deep: bool) -> Any:
        outer, *rest = ancestors
        at, name = holder(record, outer)
        array = at.get(name) if at is not None else None
        if not isinstance(array, list):
            return None
        objects = [e for e in array if isinstance(e, dict)]
        if rest:
            below = [p.removeprefix(f"{outer}.") for p in rest]
            results = [self._record_result(e, field.removeprefix(f"{outer}."), below, a, True) for e in objects]
            merge = "sum" if merge_of(a.op) == "distinct" else None
            return fold(a.op, [x for x in results if x is not None], merge)
        if deep and array and not objects:
            return fold(a.op, [contribution(a, v, self.today) for v in array])
        date = a.text("date_field") if deep else ""
        if date:
            window = _Window(a, self.today)
            objects = [e for e in objects if not isinstance(d := find(e, date)[0], str) or window.has(d)]
        values = [v for v, found in (find(e, field.removeprefix(f"{outer}.")) for e in objects) if found]
        return fold(a.op, [contribution(a, v, self.today) for v in values])

    def _rows(self, record: dict) -> Iterator[tuple[int, dict]]:
        """The record itself, or one row for each element of the exploded array and at least one."""
        at, name = holder(record, self.explode) if self.explode else (None, "")
        if at is None:
            yield 0, record
            return
        array = at.get(name)
        for i, e in enumerate(array if isinstance(array, list) and array else [None]):
            at[name] = e
            yield i, record

    def _key(self, row: dict) -> tuple[str, str]:
        found = [find(row, f) for f in self.request.group_by]
        return KEY_SEPARATOR.join(text_of(v) if ok else MISSING_TEXT for v, ok in found), json.dumps([v if ok else None for v, ok in found])

    def _emit(self, record: dict) -> Iterator[tuple[str, str, int, int, Any]]:
        """(group, its fields, place in the record, aggregation or -1, what it adds)."""
        for place, row in self._rows(record):
            group, shown = self._key(row)
            yield group, shown, place, -1, None
            for k, a in enumerate(self.request.aggregations):
                ancestors = [] if self.explode else self._ancestors(a.field)
                if ancestors:
                    result = self._record_result(row, a.field, ancestors, a, len(ancestors) > 1)
                    if result is not None:
                        yield group, shown, place, k, result
                    continue
                v, found = find(row, a.field)
                # an exploded row leaves nulls out; a field outside its array counts for the group's first row only
                outside = bool(self.explode) and not a.field.startswith(f"{self.explode}.")
                if outside or found and not (self.explode and v is None):
                    x = contribution(a, v, self.today) if found and not (outside and v is None) else None
                    if outside or x is not None:
                        yield group, shown, place, k, x

    def _first_only(self, a: Aggregation) -> bool:
        return bool(self.explode) and not a.field.startswith(f"{self.explode}.")

    def _merge(self, a: Aggregation) -> str:
        """How results merge across records."""
        inside = not self.explode and self._ancestors(a.field)
        return "sum" if inside and merge_of(a.op) == "distinct" else merge_of(a.op)

    def _task(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = [self._merge(a) for a in self.request.aggregations]
        first_only = [self._first_only(a) for a in self.request.aggregations]
        for batch in batches:
            state: dict[tuple, list] = {}
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = json.loads(text)
                if not isinstance(record, dict) or (record := self._filtered(record)) is None:
                    continue
                for group, shown, place, k, x in self._emit(record):
                    merge = merges[k] if k >= 0 else "max"
                    distinct = x if merge == "distinct" and not (k >= 0 and first_only[k]) else None
                    known = state.get((group, k, distinct))
                    total, n = x if isinstance(x, tuple) else (None, 0) if x is None or isinstance(x, str) else (x, 1)
                    if k >= 0 and first_only[k] and isinstance(x, str):
                        total, n = 1.0, 1
                    if known is None:
                        state[group, k, distinct] = [shown, row_id, place, total, n]
                    elif k >= 0 and first_only[k]:
                        continue
                    elif total is not None:
                        known[3] = total if known[3] is None else {"max": max, "min": min}.get(merge, lambda p, q: p + q)(known[3], total)
                        known[4] += n
            rows = [(g, s, r, p, k, d, t, float(n)) for (g, k, d), (s, r, p, t, n) in state.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _PARTIAL_NAMES)

    # Merging -----------------------------------------------------------------------------------------------

    def build(self) -> DataFrame:
        """The result; group columns are VARIANT, as their types may differ from row to row."""
        r = self.request
        plan = _Sendable(self)
        source = self.lines.select(F.col(self.row_id).cast("long").alias("id"), F.col("value"))
        partial = source.mapInArrow(lambda batches: plan.task(batches), ", ".join(f"{n} {t}" for n, t in zip(_PARTIAL_NAMES, _PARTIAL_TYPES, strict=True)))
        place = F.struct("id", "place")
        values: dict[str, Any] = {}
        for k, a in enumerate(r.aggregations):
            own = F.col("k") == k
            total, n, merge = F.when(own, F.col("total")), F.when(own, F.col("n")), self._merge(a)
            if self._first_only(a):
                folded = F.min_by(F.col("total"), F.when(own, place))
            elif merge == "distinct":
                folded = F.countDistinct(F.when(own, F.col("distinct"))).cast("double")
            elif merge == "avg":
                folded = F.try_divide(F.sum(total), F.sum(n))
            else:
                folded = {"sum": F.sum, "max": F.max, "min": F.min}[merge](total)
            values[a.name] = F.coalesce(folded, F.lit(0.0)) if has_zero(a.op) else folded
        names = list(dict.fromkeys([*r.group_by, *values]))
        grouped = partial.groupBy("group") if r.group_by else partial
        out = grouped.agg(
            F.min(place).alias("first"), F.min_by("shown", place).alias("shown"), *[c.alias(f"v{i}") for i, c in enumerate(values.values())]
        )
        if not r.group_by and self.empty:
            out = out.limit(0)
        if r.group_by and self.ordered:
            out = out.orderBy("first")
        shown = {f: F.variant_get(F.parse_json("shown"), f"$[{i}]", "variant") for i, f in enumerate(r.group_by)}
        columns = shown | {n: F.col(f"v{i}") for i, n in enumerate(values)}
        return out.select(*[columns[n].alias(n) for n in names])


_PARTIAL_NAMES = ["group", "shown", "id", "place", "k", "distinct", "total", "n"]
_PARTIAL_TYPES = ["string", "string", "long", "long", "int", "string", "double", "double"]


class _Sendable:
    """What a task needs of a plan: all but its DataFrame."""

    def __init__(self, plan: DynamicPlan):
        self.state = {k: v for k, v in plan.__dict__.items() if k != "lines"}

    def task(self, batches):
        plan = DynamicPlan.__new__(DynamicPlan)
        plan.__dict__.update(self.state)
        return plan._task(batches)
