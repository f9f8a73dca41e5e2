"""The built-in sample: nine employees and their 38 credits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

#: Name, employee_id, department, city, age, years_of_service, salary.
EMPLOYEES = """
Andi, EMP-001, Risk Management, Jakarta, 35, 8, 25000000
Budi, EMP-002, IT, Bandung, 42, 15, 35000000
Citra, EMP-003, Finance, Jakarta, 28, 3, 18000000
Dewi, EMP-004, Marketing, Surabaya, 31, 5, 20000000
Eka, EMP-005, IT, Jakarta, 29, 4, 22000000
Fajar, EMP-006, Risk Management, Bandung, 38, 12, 30000000
Gina, EMP-007, Finance, Surabaya, 33, 6, 24000000
Hendra, EMP-008, Marketing, Jakarta, 45, 20, 40000000
Irfan, EMP-009, IT, Surabaya, 26, 2, 15000000
"""

#: Owner, account_no, open_date, initial_limit, outstanding_balance, product_type, loan_status and the
#: last 24 months, oldest first, as marks of days past due.
CREDITS = """
Andi, CC-001, 2022-01-15, 50000000, 15000000, credit card, active, 000000000000000000000000
Andi, PL-002, 2021-06-20, 100000000, 45000000, personal loan, active, 000000000000000000000000
Andi, MG-003, 2019-03-10, 500000000, 420000000, mortgage, active, 000000000000000000000000
Andi, CC-004, 2023-08-05, 30000000, 28000000, credit card, active, 00000000000000000000aaa
Andi, PY-005, 2025-03-10, 10000000, 5000000, paylater, active, 000000000000000000000000
Budi, CC-010, 2020-03-15, 80000000, 25000000, credit card, active, 000000000000000000000000
Budi, CC-011, 2021-07-22, 60000000, 55000000, credit card, active, 00000000000000000005aaa
Budi, CC-012, 2022-11-30, 40000000, 38000000, credit card, active, 000000000000000000066fff
Budi, CC-013, 2023-04-18, 25000000, 0, credit card, paid-off, a0a060300000000000000000
Budi, PL-014, 2020-09-01, 200000000, 120000000, personal loan, active, 000000000000000000000000
Budi, PL-015, 2022-02-14, 75000000, 60000000, personal loan, active, 000000000000000000000555
Budi, PL-016, 2023-10-05, 50000000, 48000000, personal loan, active, 000000000000000000000066
Budi, MG-017, 2018-05-20, 800000000, 650000000, mortgage, active, 000000000000000000000000
Budi, MP-018, 2025-04-01, 30000000, 15000000, multipurpose, active, 000000000000000000000000
Budi, PY-019, 2025-05-15, 5000000, 3000000, paylater, active, 000000000000000000000000
Citra, CC-020, 2025-01-15, 20000000, 8000000, credit card, active, 000000000000000000000000
Eka, CC-030, 2022-05-20, 35000000, 20000000, credit card, active, 000000000000000000000000
Eka, PL-031, 2023-03-15, 50000000, 35000000, personal loan, active, 000000000000000000000333
Eka, PY-032, 2025-05-20, 8000000, 2000000, paylater, active, 000000000000000000000000
Fajar, CC-040, 2019-08-10, 70000000, 45000000, credit card, active, 606003000000000000000000
Fajar, CC-041, 2020-12-05, 55000000, 52000000, credit card, active, 000000000000000000356aaa
Fajar, CC-042, 2022-04-18, 40000000, 0, credit card, written-off, 000000000000000666aaahhh
Fajar, PL-043, 2021-01-25, 150000000, 90000000, personal loan, active, 000000000000000000000000
Fajar, PL-044, 2022-09-30, 80000000, 75000000, personal loan, restructured, 000000000000000000055aaa
Fajar, MG-045, 2017-11-15, 600000000, 500000000, mortgage, active, 000000000000000000000000
Fajar, MP-046, 2025-03-30, 25000000, 10000000, multipurpose, active, 000000000000000000000000
Gina, CC-050, 2021-03-08, 45000000, 30000000, credit card, active, 000000000000000000000000
Gina, PL-051, 2025-04-25, 60000000, 55000000, personal loan, active, 000000000000000000000033
Hendra, CC-060, 2018-06-12, 100000000, 60000000, credit card, active, 000000000000000000000000
Hendra, CC-061, 2020-09-25, 75000000, 70000000, credit card, active, 000000000000000000666fff
Hendra, PL-062, 2019-12-01, 250000000, 180000000, personal loan, active, 000000000000000000000000
Hendra, MG-063, 2016-04-15, 1000000000, 800000000, mortgage, active, 000000000000000000000000
Irfan, CC-070, 2024-06-01, 15000000, 12000000, credit card, active, 000000000000000000000000
Irfan, CC-071, 2024-09-15, 10000000, 8000000, credit card, active, 000000000000000000003333
Irfan, CC-072, 2025-01-20, 20000000, 18000000, credit card, active, 0000000000000000000036aa
Irfan, PL-073, 2024-03-10, 30000000, 25000000, personal loan, active, 000000000000000000000000
Irfan, PL-074, 2025-04-05, 25000000, 20000000, personal loan, active, 000000000000000000000036
Irfan, MP-075, 2025-05-10, 15000000, 5000000, multipurpose, active, 000000000000000000000000
"""

#: Days past due of each mark, and the highest days of collectability 1 to 4 (beyond: 5).
DAYS_OF_MARK = {"0": 0.0, "3": 30.0, "5": 45.0, "6": 60.0, "9": 90.0, "a": 100.0, "c": 120.0, "f": 150.0, "h": 200.0}
COLLECTABILITY_LIMITS = (0.0, 90.0, 120.0, 180.0)
MONTHS = 24

_TEXT, _NUMBER = T.StringType(), T.DoubleType()
SCHEMA = T.StructType(
    [
        *[T.StructField(n, _TEXT) for n in ("name", "employee_id", "department", "city")],
        *[T.StructField(n, _NUMBER) for n in ("age", "years_of_service", "salary")],
        T.StructField(
            "credits",
            T.ArrayType(
                T.StructType(
                    [
                        *[T.StructField(n, _TEXT) for n in ("account_no", "open_date", "product_type", "loan_status")],
                        *[T.StructField(n, _NUMBER) for n in ("initial_limit", "outstanding_balance", "collectability_code", "delinquency")],
                        *[T.StructField(n, T.ArrayType(_NUMBER)) for n in ("last_24_delq_hist", "last_24_coll_hist")],
                    ]
                )
            ),
        ),
    ]
)


def _collectability(days: float | None) -> float:
    return 1.0 + sum((days or 0.0) > limit for limit in COLLECTABILITY_LIMITS)


def _credit(cells: list[str]) -> dict[str, Any]:
    _, account, opened, limit, balance, product, status, marks = cells
    days = [DAYS_OF_MARK[m] for m in marks] + [None] * (MONTHS - len(marks))
    return {
        "account_no": account,
        "open_date": opened,
        "product_type": product,
        "loan_status": status,
        "initial_limit": float(limit),
        "outstanding_balance": float(balance),
        "collectability_code": _collectability(days[-1]),
        "delinquency": days[-1] or 0.0,
        "last_24_delq_hist": days,
        "last_24_coll_hist": [_collectability(d) for d in days],
    }


def employees() -> list[dict[str, Any]]:
    rows = [line.split(", ") for line in CREDITS.strip().splitlines()]
    out = []
    for line in EMPLOYEES.strip().splitlines():
        name, number, department, city, *numbers = line.split(", ")
        record = {"name": name, "employee_id": number, "department": department, "city": city}
        record |= dict(zip(("age", "years_of_service", "salary"), map(float, numbers), strict=True))
        out.append(record | {"credits": [_credit(r) for r in rows if r[0] == name]})
    return out


def register_samples(catalog) -> None:
    """Register the sample as `employees`."""
    catalog.register_df("employees", catalog.spark.createDataFrame(employees(), SCHEMA).coalesce(1))
