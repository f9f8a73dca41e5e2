"""Small datasets, edge cases, and random records against the plain-Python evaluator."""

import datetime as dt
import random

import pytest

from nestql.plans.planner import Options

from helpers import agg, expected, run


def test_struct_and_array_without_doubling(spark):
    data = [
        {
            "inquiry": {"nik": "1"},
            "summary": {"total": 50e6, "limit": 100e6, "worst": 0},
            "items": [{"status": "active", "left": 10e6, "limit": 20e6}, {"status": "active", "left": 40e6, "limit": 80e6}],
        }
    ]
    got = run(
        spark,
        data,
        groupBy=["inquiry.nik"],
        localFilter={"items": {"status": {"$eq": "active"}}},
        aggregations=[agg("summary.worst", "max", "a"), agg("summary.limit", "sum", "b"), agg("items.limit", "sum", "c"), agg("items.left", "sum", "d"), agg("summary.total", "sum", "e")],
    )
    assert got == [{"inquiry.nik": "1", "a": 0.0, "b": 100e6, "c": 100e6, "d": 50e6, "e": 50e6}]


def test_array_inside_object_groups_and_filters(spark):
    data = [
        {"nik": "1", "list": {"item": [{"kind": "KPR", "left": 320}, {"kind": "KMG", "left": 85}]}},
        {"nik": "2", "list": {"item": [{"kind": "KPR", "left": 200}]}},
    ]
    got = run(spark, data, groupBy=["list.item.kind"], aggregations=[agg("list.item.left", "sum", "s"), agg("list.item.left", "count", "n")])
    assert got == [{"list.item.kind": "KPR", "s": 520.0, "n": 2.0}, {"list.item.kind": "KMG", "s": 85.0, "n": 1.0}]
    assert run(spark, data, where={"list.item.kind": {"$eq": "KMG"}}, aggregations=[agg("list.item.left", "sum", "s")]) == [{"s": 85.0}]


def test_empty_first_record_and_weighted_average(spark):
    data = [{"n": "D", "c": []}, {"n": "A", "c": [{"b": 15}, {"b": 45}]}]
    assert run(spark, data, groupBy=["n"], aggregations=[agg("c.b", "sum", "s")]) == [{"n": "D", "s": 0.0}, {"n": "A", "s": 60.0}]
    assert run(spark, [{"c": [{"b": 0}]}, {"c": [{"b": 100}] * 3}], aggregations=[agg("c.b", "avg", "a")]) == [{"a": 75.0}]


NESTED = [{"n": 1, "f": [{"r": [{"v": 1}, {"v": 3}, {"v": 5}]}, {"r": [{"v": 11}]}]}, {"n": 2, "f": [{"r": [{"v": 100}]}]}, {"n": 3, "f": []}]


def test_nested_average_is_a_mean_of_means_unless_weighted(spark):
    request = {"aggregations": [agg("f.r.v", "avg", "a")]}
    assert run(spark, NESTED, **request) == [{"a": 52.5}]
    assert run(spark, NESTED, Options(nested_avg="weighted"), **request) == [{"a": 24.0}]


def test_nested_date_field_keeps_elements_without_date(spark):
    months = [("2026-04", 0), ("2026-03", 0), ("2026-02", 35), ("2026-01", 0), ("2025-05", 45), (None, 7)]
    data = [{"l": {"f": [{"h": [{"m": m, "d": d} for m, d in months]}]}}]
    got = run(
        spark, data, aggregations=[agg("l.f.h.d", "max", "all"), agg("l.f.h.d", "max", "last", n=3, date_field="m", ref_date="2026-04-30"), agg("l.f.h.d", "count", "n", n=1, date_field="m", ref_date="2026-04-30")]
    )
    assert got == [{"all": 45.0, "last": 35.0, "n": 2.0}]
    flat = [{"h": [{"m": m, "d": d} for m, d in months]}]
    request = {"aggregations": [agg("h.d", "max", "x", n=1, date_field="m", ref_date="2026-04-30")]}
    assert run(spark, flat, **request) == [{"x": 45.0}]
    assert run(spark, flat, Options(date_field_anywhere=True), **request) == [{"x": 7.0}]


def test_filters_in_nested_arrays_need_the_option(spark):
    request = {"localFilter": {"f.r": {"v": {"$gt": 2}}}, "aggregations": [agg("f.r.v", "sum", "s"), agg("f.r.v", "count", "n")]}
    assert run(spark, NESTED, **request) == [{"s": 120.0, "n": 5.0}]
    assert run(spark, NESTED, Options(nested_filter=True), **request) == [{"s": 119.0, "n": 4.0}]


def test_three_levels(spark):
    data = [{"a": [{"b": [{"c": [{"v": 1}, {"v": 3}]}, {"c": [{"v": 20}]}]}, {"b": [{"c": [{"v": 6}]}]}]}, {"a": [{"b": [{"c": []}]}]}]
    ops = ("sum", "count", "max", "min", "avg", "count_distinct", "min_last_n")
    (got,) = run(spark, data, aggregations=[agg("a.b.c.v", op, op) for op in ops])
    for op in ops:
        assert got[op] == pytest.approx(expected(data, ["a", "b", "c", "v"], op, {})), op


def test_date_windows(spark):
    dates = ["2026-03-15", "2026-04-01", "2025-12-01", "2026-01-30", "2026-04", "junk", "2026-13-01", None, "2026-05-01", "2026-03-02", "2026-03-01"]
    data = [{"c": [{"d": x} for x in dates]}]

    def count(**params):
        return run(spark, data, aggregations=[agg("c.d", "count_date_last_n", "n", **params)], today=dt.date(2026, 4, 30))[0]["n"]

    assert count(n=3, ref_date="2026-04-30") == 6  # both ends count
    assert count(n=3) == 5  # today is a moment: the first day has just passed
    assert count(n=2, ref_date="2026-04-30") == 4  # 30 April - 2 months runs over to 2 March
    assert count(n=1, unit="year", ref_date="2026-04-30") == 7
    assert count(n=30, unit="day", ref_date="2026-04-30") == 2
    assert count(n=3, ref_date="no date") == 5
    assert count(ref_date="2026-04-30", n="many") == 7  # no number: six
    assert run(spark, data, aggregations=[agg("c.d", "count_since", "n", n=3)], today=dt.date(2026, 4, 30))[0]["n"] == 9  # texts, no upper end


def test_numbers_in_date_operations_are_added(spark):
    assert run(spark, [{"c": [{"d": 2}, {"d": 3}]}], aggregations=[agg("c.d", "count_date_last_n", "a"), agg("c.d", "count_since", "b")]) == [{"a": 5.0, "b": 5.0}]


def test_histories_with_gaps_and_odd_n(spark):
    data = [{"h": [5, None, 1, None, None]}, {"h": []}, {"h": None}, {"h": [2]}]

    def value(op, **params):
        return run(spark, data, aggregations=[agg("h", op, "x", **params)])[0]["x"]

    assert value("worst_last_n", n=3) == 2 and value("worst_last_n", n=99999) == 5
    assert value("worst_last_n", n=0) is None and value("worst_last_n", n=-1) is None
    assert value("sum_last_n", n=4) == 3 and value("min_last_n", n=5) == 1
    assert value("count_last_n", n=9, value=2, comparator="$gte") == 2 and value("ever_has_last_n", n=1, value=5) == 0
    assert value("ever_has_last_n", n=9, value=5, comparator="$ne") == 1  # an unknown comparator means equal


def test_shapes_of_requests(spark):
    data = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}, {"a": 3, "b": "x"}, {"b": None}]
    assert run(spark, data, groupBy=["b"]) == [{"b": "x"}, {"b": "y"}, {"b": None}]
    assert run(spark, data, where={"a": {"$gt": 99}}, aggregations=[agg("a", "sum", "s"), agg("a", "max", "m")]) == [{"s": 0.0, "m": None}]
    assert run(spark, data, where={"a": {"$gt": 99}}, groupBy=["b"], aggregations=[agg("a", "sum", "s")]) == []
    assert run(spark, data, groupBy=["b"], aggregations=[agg("a", "sum", "v"), agg("a", "count", "n"), agg("a", "max", "v"), agg("a", "min", "b")])[0] == {"b": 1.0, "v": 3.0, "n": 2.0}
    assert run(spark, data, aggregations=[agg("nowhere", "sum", "s"), agg("nowhere.deep", "max", "m"), agg("a", "median", "u")]) == [{"s": 0.0, "m": None, "u": None}]
    assert run(spark, [{"a.b": 5, "a": {"c": 1}}], aggregations=[agg("a.b", "sum", "s")]) == [{"s": 5.0}]
    assert run(spark, [{"a": 1, "A": 5}], aggregations=[agg("a", "sum", "x"), agg("A", "sum", "y")]) == [{"x": 1.0, "y": 5.0}]


def test_sibling_and_deeper_arrays_when_exploded(spark):
    data = [{"p": 7, "x": [{"k": "a", "in": [{"v": 1}]}, {"k": "b", "in": None}], "y": [{"w": 3}]}]
    got = run(spark, data, groupBy=["x.k"], aggregations=[agg("x.in.v", "sum", "s"), agg("x.in.v", "count", "n"), agg("y.w", "sum", "t"), agg("y.w", "count", "m"), agg("p", "sum", "p")])
    assert got == [{"x.k": "a", "s": 0.0, "n": 1.0, "t": 0.0, "m": 1.0, "p": 7.0}, {"x.k": "b", "s": 0.0, "n": 0.0, "t": 0.0, "m": 1.0, "p": 7.0}]
    with pytest.raises(ValueError, match="neither array"):
        run(spark, data, groupBy=["x.k", "y.w"])


def random_records(rng, n):
    def value():
        return rng.choice([None, rng.randint(-3, 9), rng.randint(0, 3)])

    def maybe(make, k):
        return None if rng.random() < 0.1 else [make() for _ in range(rng.randint(0, k))]

    def leaf():
        return {"v": value(), "h": maybe(value, 5)}

    return [{"g": rng.choice("abc"), "v": value(), "h": maybe(value, 8), "x": maybe(lambda: leaf() | {"y": maybe(leaf, 3)}, 3)} for _ in range(n)]


OPS = ["count", "count_distinct", "sum", "avg", "min", "max", "worst_last_n", "min_last_n", "sum_last_n", "ever_has_last_n", "count_last_n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_records_equal_the_plain_evaluator(spark, seed):
    rng = random.Random(seed)
    records = random_records(rng, 60)
    # types are inferred over all records; one full record fixes them
    records.append({"g": "z", "v": 1, "h": [1], "x": [{"v": 1, "h": [1], "y": [{"v": 1, "h": [1]}]}]})
    params = {"n": 3, "value": 2}
    asked = [(path, op) for path in (["v"], ["h"], ["x", "v"], ["x", "h"], ["x", "y", "v"], ["x", "y", "h"]) for op in OPS if not (path[-1] == "h" and op == "count_distinct")]
    got = run(spark, records, groupBy=["g"], aggregations=[agg(".".join(p), op, f"{'.'.join(p)} {op}", **params) for p, op in asked])
    assert len(got) == len({r["g"] for r in records})
    for row in got:
        own = [r for r in records if r["g"] == row["g"]]
        for p, op in asked:
            want = expected(own, p, op, params)
            assert row[f"{'.'.join(p)} {op}"] == (want if want is None else pytest.approx(want)), (row["g"], p, op)


def test_folding_equals_exploding_for_additive_operations(spark):
    records = [{"g": "a", "x": [{"v": i % 5, "k": "k"} for i in range(j)]} for j in range(6)]
    ops = [agg("x.v", op, op) for op in ("sum", "count", "avg", "max")]
    (folded,) = run(spark, records, localFilter={"x": {"k": {"$eq": "k"}}}, aggregations=ops)
    exploded = [r for r in run(spark, records, groupBy=["x.k"], aggregations=ops) if r["x.k"] == "k"]
    assert exploded == [{"x.k": "k", **folded}]


@pytest.mark.parametrize(
    "request_",
    [
        {"aggregations": [agg("v", "nope")]},
        {"aggregations": [agg("", "sum")]},
        {"aggregations": [agg("x.h", "worst_last_n", n=-1)]},
        {"aggregations": [agg("x.h", "worst_last_n", n=99999)]},
        {"where": {"v": {"$gt": "text"}}},
        {"where": {"v": {"$in": "no array"}}},
        {"where": {"missing": {"$eq": 1}}},
        {"where": {"x.v": {"$between": [1]}}},
        {"localFilter": {"nowhere": {"v": {"$eq": 1}}, "x": {}, "v": {"w": {"$eq": 1}}}},
        {"groupBy": ["missing", "x.missing"], "aggregations": [agg("v", "sum")]},
        {"groupBy": ["x.y.v"], "aggregations": [agg("x.v", "sum"), agg("x.y.h", "sum_last_n")]},
        {"filterMode": "manual", "where": {"x.v": {"$eq": 1}}, "aggregations": [agg("v", "count")]},
    ],
)
def test_odd_requests_do_not_fail(spark, request_):
    run(spark, random_records(random.Random(5), 10), **request_)
