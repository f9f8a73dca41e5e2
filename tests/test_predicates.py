"""Every predicate on records and on elements, and the text forms they compare."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nestql.functions.dates import cut_off, months_back, parse_date
from nestql.functions.text import literal_text, number_text
from nestql.operators.predicates import predicate

from helpers import agg, run

ROWS = [
    {"i": 1, "s": "apple", "n": 1, "b": True, "d": "2026-04-01"},
    {"i": 2, "s": "Banana", "n": 2.5, "b": False, "d": "2026-01"},
    {"i": 3, "s": "", "n": 42, "b": None, "d": "zzz"},
    {"i": 4, "s": None, "n": None, "b": None, "d": None},
]
CASES = [
    ("n", "$eq", 42, {3}),
    ("n", "$eq", "42", {3}),
    ("n", "$eq", "2.5", {2}),
    ("s", "$eq", "apple", {1}),
    ("b", "$eq", True, {1}),
    ("b", "$eq", "true", {1}),
    ("n", "$eq", None, {4}),
    ("n", "$ne", 1, {2, 3, 4}),
    ("s", "$ne", None, {1, 2, 3}),
    ("n", "$gt", 1, {2, 3}),
    ("n", "$gte", 1.0, {1, 2, 3}),
    ("n", "$lt", 2.5, {1}),
    ("n", "$lte", 2.5, {1, 2}),
    ("s", "$gt", "Banana", {1}),
    ("n", "$gt", "2", {2, 3}),
    ("n", "$in", [1, "42", None], {1, 3, 4}),
    ("n", "$in", [], set()),
    ("n", "$in", 1, set()),
    ("n", "$nin", [1, 2.5], {3, 4}),
    ("n", "$nin", 1, {1, 2, 3, 4}),
    ("s", "$contains", "an", {2}),
    ("s", "$contains", "", {1, 2, 3}),
    ("n", "$contains", "4", set()),
    ("s", "$notnull", False, {1, 2, 3}),
    ("s", "$null", False, {4}),
    ("nowhere", "$null", True, {1, 2, 3, 4}),
    ("nowhere", "$ne", 1, {1, 2, 3, 4}),
    ("nowhere", "$eq", 1, set()),
    ("d", "$within_months", 3, {1, 3}),
    ("d", "$within_months", 4, {1, 2, 3}),
    ("n", "$within_months", 3, set()),
    ("n", "$between", [1, 2.5], {1, 2}),
    ("n", "$between", [1], set()),
    ("n", "$between", ["1", "3"], set()),
    ("s", "$between", [1, 3], set()),
    ("n", "$like", 1, {1, 2, 3, 4}),
]


def test_on_values(spark):
    today = dt.date(2026, 4, 30)
    rows = spark.createDataFrame([tuple(r[k] for k in "isnbd") for r in [{**r, "n": r["n"] and float(r["n"])} for r in ROWS]], "i int, s string, n double, b boolean, d string")
    tests = [predicate(F.col(f) if f in rows.columns else F.lit(None), rows.schema[f].dataType if f in rows.columns else None, op, x, today) for f, op, x, _ in CASES]
    got = rows.select("i", *[t.alias(f"t{k}") for k, t in enumerate(tests)]).collect()
    for k, (field, op, operand, want) in enumerate(CASES):
        assert {r.i for r in got if r[f"t{k}"]} == want, (field, op, operand)


@pytest.mark.parametrize("case", [CASES[0], CASES[9], CASES[15], CASES[18]])
def test_on_records_and_on_elements(spark, case):
    field, op, operand, want = case
    assert {int(r["i"]) for r in run(spark, ROWS, where={field: {op: operand}}, groupBy=["i"])} == want
    routed = run(spark, [{"x": ROWS}], where={f"x.{field}": {op: operand}}, aggregations=[agg("x.i", "count", "n")])
    assert routed == [{"n": float(len(want))}]


def test_explicit_element_filter_wins_over_a_routed_one(spark):
    got = run(spark, [{"x": ROWS}], where={"x.n": {"$gt": 1}}, localFilter={"x": {"x.n": {"$eq": 1}}}, aggregations=[agg("x.i", "count", "n")])
    assert got == [{"n": 1.0}]


@pytest.mark.parametrize(
    ("number", "text"),
    [(42.0, "42"), (2.5e7, "2.5e+07"), (1e6, "1e+06"), (123456.0, "123456"), (1234567.0, "1.234567e+06"), (0.5, "0.5"), (0.0001, "0.0001"), (0.00012, "0.00012"), (0.00001, "1e-05"), (-3.25, "-3.25"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (0.0, "0"), (-1e-7, "-1e-07"), (0.001, "0.001"), (100.0, "100")],
)
def test_number_texts(spark, number, text):
    assert literal_text(number) == text
    assert spark.range(1).select(number_text(F.lit(number))).first()[0] == text


def test_dates():
    assert parse_date("2026-04") == dt.date(2026, 4, 1) and parse_date("2026-4-1") is None and parse_date("2026-02-30") is None
    assert months_back(dt.date(2026, 4, 30), 2) == dt.date(2026, 3, 2)
    assert months_back(dt.date(2026, 1, 15), 13) == dt.date(2024, 12, 15)
    assert cut_off(dt.date(2024, 2, 29), 1, "year") == dt.date(2023, 3, 1)
    assert cut_off(dt.date(2026, 3, 1), 1, "day") == dt.date(2026, 2, 28)
