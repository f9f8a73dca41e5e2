"""Calendar windows over date strings. Cut-offs are constants, computed when a request is planned."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = re.compile(r"([0-9]{4})-([0-9]{2})(?:-([0-9]{2}))?")
_SHAPE = r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z"


def parse_date(text: object) -> dt.date | None:
    """YYYY-MM-DD, or YYYY-MM for the first of the month; None for anything else."""
    m = _DATE.fullmatch(text) if isinstance(text, str) else None
    try:
        return dt.date(int(m[1]), int(m[2]), int(m[3] or 1)) if m else None
    except ValueError:
        return None


def months_back(day: dt.date, n: int) -> dt.date:
    """The same day of the month n months before; days beyond that month's end run on into the next."""
    months = day.year * 12 + day.month - 1 - n
    return dt.date(months // 12, months % 12 + 1, 1) + dt.timedelta(days=day.day - 1)


def cut_off(reference: dt.date, n: int, unit: str) -> dt.date:
    if unit == "day":
        return reference - dt.timedelta(days=n)
    return months_back(reference, 12 * n if unit == "year" else n)


def within_period(text: Column, n: int, unit: str, reference: object, today: dt.date) -> Column:
    """Whether a date string lies from n units before the reference up to it.

    Both ends count with a reference date; without one (or with one that is no date) the reference is this
    moment of today, so the day n units ago has just left the window.
    """
    given = parse_date(reference)
    end = given or today
    begin = F.lit(cut_off(end, n, unit).isoformat())
    # dates of four-digit years are in the order of their texts, so only texts inside the window are parsed
    day = F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    inside = ((day >= begin) if given else (day > begin)) & (day <= F.lit(end.isoformat()))
    return F.coalesce(inside & text.rlike(_SHAPE) & day.try_cast("date").isNotNull(), F.lit(False))
