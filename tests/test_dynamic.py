"""Records whose types differ from row to row, and the same requests in both lanes."""

import datetime as dt
import random

import pytest

from nestql.catalog import Catalog, result_rows
from nestql.plans.dynamic import text_of
from nestql.sources.samples import employees

from helpers import agg
from test_semantics import NESTED, OPS, random_records

TODAY = dt.date(2026, 4, 30)


def both(spark, data, **request):
    c = Catalog(spark)
    c.register_json("typed", data)
    c.register_dynamic("free", data)
    return [result_rows(c.aggregate({"dataset": d, **request}, today=TODAY)) for d in ("typed", "free")]


def free(spark, data, **request):
    c = Catalog(spark)
    c.register_dynamic("free", data)
    return result_rows(c.aggregate({"dataset": "free", **request}, today=TODAY))


def test_texts():
    values = [None, True, 42.0, 25000000.0, "x", [1, "a", None], {"b": 1, "a": [2]}]
    assert list(map(text_of, values)) == ["<nil>", "true", "42", "2.5e+07", "x", "[1 a <nil>]", "map[a:[2] b:1]"]


def test_mixed_types_nulls_and_missing(spark):
    data = [{"k": 1, "v": 10}, {"k": "1", "v": "20"}, {"k": None, "v": 5}, {"v": True}, {"k": [1, 2], "v": None}, {"k": 1.0}]
    got = free(spark, data, groupBy=["k"], aggregations=[agg("v", "sum", "s"), agg("v", "count", "n"), agg("v", "count_rows", "r"), agg("v", "count_distinct", "d")])
    assert got == [
        {"k": 1, "s": 10.0, "n": 2.0, "r": 2.0, "d": 2.0},
        {"k": None, "s": 5.0, "n": 1.0, "r": 1.0, "d": 1.0},
        {"k": None, "s": 0.0, "n": 1.0, "r": 1.0, "d": 1.0},
        {"k": [1, 2], "s": 0.0, "n": 0.0, "r": 1.0, "d": 0.0},
    ]

    def count(**condition):
        return free(spark, data, where={"k": condition}, aggregations=[agg("v", "count_rows", "n")])[0]["n"]

    assert (count(**{"$eq": None}), count(**{"$null": 1}), count(**{"$gt": 5}), count(**{"$ne": 1})) == (1, 2, 2, 3)


def test_path_through_a_scalar_ends_there(spark):
    assert free(spark, [{"a": 7}, {"a": {"b": 1}}], aggregations=[agg("a.b", "sum", "s")]) == [{"s": 8.0}]
    assert free(spark, [{"x": [{"k": 1}], "a.b": 3}], aggregations=[agg("a.b", "sum", "s")]) == [{"s": 3.0}]


def test_shapes(spark):
    assert free(spark, [], aggregations=[agg("a", "sum", "s")]) == []
    assert free(spark, [{"a": 1}], where={"a": {"$gt": 5}}, aggregations=[agg("a", "sum", "s"), agg("a", "max", "m")]) == [{"s": 0.0, "m": None}]
    assert free(spark, [{"a": 1, "b": 2}, {"a": 1, "b": 3}], groupBy=["a"]) == [{"a": 1}]
    with pytest.raises(ValueError):
        free(spark, [{"x": [{"v": 1}]}], aggregations=[agg("x", "count")])


@pytest.mark.parametrize(
    "request_",
    [
        {"aggregations": [agg("f.r.v", op, op) for op in ("sum", "avg", "max", "count", "count_distinct", "min_last_n")]},
        {"groupBy": ["n"], "where": {"n": {"$lte": 2}}, "aggregations": [agg("f.r.v", "avg", "a")]},
    ],
)
def test_nested_arrays_in_both_lanes(spark, request_):
    typed, dynamic = both(spark, NESTED, **request_)
    assert typed == dynamic


def test_sample_in_both_lanes(spark):
    delq, coll = "credits.last_24_delq_hist", "credits.last_24_coll_hist"
    aggregations = [
        agg("salary", "sum", "a"),
        agg("credits.outstanding_balance", "avg", "b"),
        agg(delq, "worst_last_n", "c", n=6),
        agg(coll, "count_last_n", "d", n=6, value=3, comparator="$gte"),
        agg("credits.outstanding_balance", "min_last_n", "e"),
        agg("credits.open_date", "count_date_last_n", "f", n=12, ref_date="2026-04-30"),
        agg("credits.product_type", "count_distinct", "g"),
    ]
    for request in ({"groupBy": ["department"]}, {"groupBy": ["department", "credits.product_type"]}, {}):
        typed, dynamic = both(spark, employees(), where={"credits.loan_status": {"$eq": "active"}}, aggregations=aggregations, **request)
        assert [list(r.values()) for r in dynamic] == [[v if v is None or isinstance(v, str) else pytest.approx(v) for v in r.values()] for r in typed]


def test_random_records_in_both_lanes(spark):
    records = [{"g": "z", "v": 1, "h": [1], "x": [{"v": 1, "h": [1], "y": [{"v": 1, "h": [1]}]}]}, *random_records(random.Random(9), 50)]
    asked = [agg(f, op, f"{f} {op}", n=3, value=2) for f in ("v", "h", "x.v", "x.h", "x.y.v") for op in OPS if not (f.endswith("h") and op == "count_distinct")]
    typed, dynamic = both(spark, records, groupBy=["g"], aggregations=asked)
    assert len(typed) == len(dynamic)
    for t, d in zip(typed, dynamic, strict=True):
        assert {k: v if v is None or isinstance(v, str) else pytest.approx(v) for k, v in t.items()} == d
