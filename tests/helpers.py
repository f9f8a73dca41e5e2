"""Shorthand for requests, and an evaluator of their semantics in plain Python that shares no code with the planner."""

import datetime as dt

from nestql.catalog import Catalog, result_rows


def agg(field, op, alias="", **params):
    return {"field": field, "op": op, "alias": alias, "params": params}


def run(spark, data, options=None, today=None, **request):
    catalog = Catalog(spark)
    return result_rows(catalog.aggregate({"data": data, **request}, today=today or dt.date(2026, 4, 30), options=options))


def number(v):
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) else None


SUMS = {"sum", "count", "count_rows", "count_distinct", "count_last_n", "sum_last_n"}
ZEROS = SUMS | {"ever_has_last_n", "min_last_n"}


def apply(op, values, params):
    n, target = params.get("n", 6), params.get("value", 0)

    def tail(h):
        return [x for x in (h[-n:] if n > 0 else []) if number(x) is not None]

    numbers = [number(v) for v in values if number(v) is not None]
    if op == "count":
        return float(sum(v is not None for v in values))
    if op == "count_rows":
        return float(len(values))
    if op == "count_distinct":
        return float(len({str(v) for v in values if v is not None}))
    if op == "sum":
        return float(sum(numbers))
    if op == "avg":
        pairs = [v for v in values if isinstance(v, tuple)]
        total = sum(p[0] for p in pairs) + sum(numbers)
        count = sum(p[1] for p in pairs) + len(numbers)
        return None if not count else total / count if pairs else (total, count)
    if op in ("min", "max"):
        return float({"min": min, "max": max}[op](numbers)) if numbers else None
    pooled = [x for v in values for x in (tail(v) if isinstance(v, list) else [v] if number(v) is not None else [])]
    hits = [any(abs(x - target) < 1e-9 for x in tail(v)) if isinstance(v, list) else number(v) is not None and abs(v - target) < 1e-9 for v in values]
    if op == "worst_last_n":
        return float(max(pooled)) if pooled else None
    if op == "min_last_n":
        return float(min(pooled)) if pooled else None
    if op == "sum_last_n":
        return float(sum(pooled))
    if op == "ever_has_last_n":
        return float(any(hits))
    if op == "count_last_n":
        return float(sum(hits))
    raise ValueError(op)


def across(op):
    return "sum" if op in SUMS else "max" if op == "ever_has_last_n" else op


def fold(record, path, op, params):
    """A record's result for a path given as names, of which lists are crossed; None for a missing array."""
    array = record.get(path[0])
    if array is None:
        return None
    inner = [e.get(path[1]) for e in array] if len(path) == 2 else [r for e in array if (r := fold(e, path[1:], op, params)) is not None]
    if not inner:
        return 0.0 if op in ZEROS else None
    return apply(op if len(path) == 2 else across(op), inner, params)


def expected(records, path, op, params):
    if len(path) == 1:
        result = apply(op, [r.get(path[0]) for r in records], params)
    else:
        results = [x for r in records if (x := fold(r, path, op, params)) is not None]
        result = apply(across(op), results, params) if results else None
    if isinstance(result, tuple):
        result = result[0] / result[1]
    return 0.0 if result is None and op in ZEROS else result
