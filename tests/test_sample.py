"""The built-in sample against hand-computed results."""

import pytest

from nestql.catalog import Catalog, result_rows, to_json
from nestql.plans.planner import Options
from nestql.sources.samples import register_samples

from helpers import agg


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    register_samples(c)
    return c


def rows(catalog, options=None, **request):
    return result_rows(catalog.aggregate({"dataset": "employees", **request}, options=options))


def test_global(catalog):
    (r,) = rows(
        catalog,
        aggregations=[agg("salary", "sum"), agg("credits.outstanding_balance", "sum"), agg("credits.account_no", "count"), agg("credits.outstanding_balance", "avg"), agg("name", "count"), agg("name", "count_rows")],
    )
    assert list(r.items())[:3] == [("sum_salary", 229e6), ("sum_credits_outstanding_balance", 3647e6), ("count_credits_account_no", 38.0)]
    assert r["avg_credits_outstanding_balance"] == pytest.approx(95973684.21052632)
    assert r["count_name"] == r["count_rows_name"] == 9


def test_by_department_in_order_of_appearance(catalog):
    got = rows(
        catalog,
        groupBy=["department"],
        aggregations=[
            agg("salary", "sum", "s"),
            agg("salary", "avg", "a"),
            agg("credits.outstanding_balance", "sum", "os"),
            agg("credits.account_no", "count", "n"),
            agg("credits.product_type", "count_distinct", "kinds"),
            agg("credits.last_24_delq_hist", "sum_last_n", "late", n=3),
            agg("credits.last_24_coll_hist", "count_last_n", "good", n=6, value=1),
            agg("credits.outstanding_balance", "min", "least"),
            agg("credits.outstanding_balance", "min_last_n", "least_n"),
        ],
    )
    assert [tuple(r.values()) for r in got] == [
        ("Risk Management", 55e6, 27.5e6, 1285e6, 12.0, 8.0, 1400.0, 10.0, 0.0, 0.0),
        ("IT", 72e6, 24e6, 1159e6, 19.0, 11.0, 1435.0, 19.0, 0.0, 0.0),
        ("Finance", 42e6, 21e6, 93e6, 3.0, 3.0, 60.0, 3.0, 8e6, 8e6),
        ("Marketing", 60e6, 30e6, 1110e6, 4.0, 3.0, 450.0, 3.0, 60e6, 0.0),
    ]


HISTORIES = {
    "Andi": (100, 100, 3, 3, 1, 1, 1, 513e6, 0),
    "Budi": (150, 150, 4, 4, 1, 1, 2, 1014e6, 1),
    "Citra": (0, 0, 1, 1, 0, 0, 0, 8e6, 0),
    "Dewi": (None, None, None, None, 0, 0, 0, 0, 0),
    "Eka": (30, 30, 2, 2, 0, 0, 0, 57e6, 1),
    "Fajar": (200, 200, 5, 5, 1, 1, 3, 772e6, 0),
    "Gina": (30, 30, 2, 2, 0, 0, 0, 85e6, 0),
    "Hendra": (150, 150, 4, 4, 0, 1, 1, 1110e6, 0),
    "Irfan": (100, 100, 3, 3, 1, 1, 1, 88e6, 1),
}


def test_histories_by_name(catalog):
    delq, coll = "credits.last_24_delq_hist", "credits.last_24_coll_hist"
    got = rows(
        catalog,
        groupBy=["name"],
        aggregations=[
            agg(delq, "worst_last_n", "a", n=6),
            agg(delq, "max_last_n", "b", n=12),
            agg(coll, "worst_last_n", "c", n=3),
            agg(coll, "worst_last_n", "d", n=12),
            agg(coll, "ever_has_last_n", "e", n=3, value=3),
            agg(coll, "ever_has_last_n", "f", n=3, value=3, comparator="$gte"),
            agg(coll, "count_last_n", "g", n=6, value=3, comparator="$gte"),
            agg("credits.outstanding_balance", "sum", "h"),
            agg("credits.open_date", "count_date_last_n", "i", n=12, ref_date="2026-04-30"),
        ],
    )
    assert {r.pop("name"): tuple(r.values()) for r in got} == HISTORIES
    assert list(HISTORIES) == [n for n in HISTORIES]


EXPLODED = [
    ("Risk Management", "credit card", 140e6, 4, 25e6, 55e6),
    ("Risk Management", "personal loan", 135e6, 2, 25e6, 55e6),
    ("Risk Management", "mortgage", 920e6, 2, 25e6, 55e6),
    ("Risk Management", "paylater", 5e6, 1, 25e6, 25e6),
    ("IT", "credit card", 176e6, 7, 35e6, 72e6),
    ("IT", "personal loan", 308e6, 6, 35e6, 72e6),
    ("IT", "mortgage", 650e6, 1, 35e6, 35e6),
    ("IT", "multipurpose", 20e6, 2, 35e6, 50e6),
    ("IT", "paylater", 5e6, 2, 35e6, 57e6),
    ("Finance", "credit card", 38e6, 2, 18e6, 42e6),
    ("Marketing", None, 0, 0, 20e6, 20e6),
    ("Risk Management", "multipurpose", 10e6, 1, 30e6, 30e6),
    ("Finance", "personal loan", 55e6, 1, 24e6, 24e6),
    ("Marketing", "credit card", 130e6, 2, 40e6, 40e6),
    ("Marketing", "personal loan", 180e6, 1, 40e6, 40e6),
    ("Marketing", "mortgage", 800e6, 1, 40e6, 40e6),
]


@pytest.mark.parametrize(("options", "column"), [(Options(), 4), (Options(parent_dedup="record"), 5)])
def test_exploded_in_order_of_appearance(catalog, options, column):
    got = rows(
        catalog,
        options,
        localFilter={"credits": {"loan_status": {"$eq": "active"}}},
        groupBy=["department", "credits.product_type"],
        aggregations=[agg("credits.outstanding_balance", "sum", "os"), agg("credits.account_no", "count", "n"), agg("salary", "sum", "s")],
    )
    assert [tuple(r.values()) for r in got] == [(*e[:4], e[column]) for e in EXPLODED]


def test_routed_filter_keeps_people_without_active_credits(catalog):
    got = rows(catalog, where={"credits.loan_status": {"$eq": "active"}, "department": {"$eq": "IT"}}, groupBy=["name"], aggregations=[agg("credits.account_no", "count", "n")])
    assert got == [{"name": "Budi", "n": 9.0}, {"name": "Eka", "n": 3.0}, {"name": "Irfan", "n": 6.0}]


def test_array_itself_is_rejected(catalog):
    with pytest.raises(ValueError, match="credits"):
        rows(catalog, aggregations=[agg("credits", "count")])


def test_columns_keep_request_order_and_json_has_dots(catalog):
    df = catalog.aggregate({"dataset": "employees", "groupBy": ["department", "credits.loan_status"], "aggregations": [agg("salary", "sum", "z"), agg("credits.account_no", "count", "a")]})
    assert df.columns == ["department", "credits.loan_status", "z", "a"]
    assert to_json(df).startswith('[{"department": "Risk Management", "credits.loan_status": "active", "z": ')


def test_catalog(catalog, spark):
    assert catalog.names() == ["employees"]
    assert [f.path for f in catalog.schema("employees")][:3] == ["age", "city", "credits"]
    assert {f.path: (f.type, f.array_path) for f in catalog.schema("employees")}["credits.last_24_coll_hist"] == ("array_number", "credits")
    assert catalog.schema("none") == []
    assert catalog.rows("employees").count() == 9
    with pytest.raises(KeyError):
        catalog.aggregate({"dataset": "none"})
    c = Catalog(spark)
    c.register_json("ds", [{"name": "a", "value": 100}, {"name": "b", "value": 200}])
    request = {"dataset": "ds", "aggregations": [agg("value", "sum", "s")]}
    assert result_rows(c.aggregate(request)) == [{"s": 300.0}]
    c.register_json("ds", b'{"name": "a", "value": 999}')
    assert result_rows(c.aggregate(request)) == [{"s": 999.0}]
