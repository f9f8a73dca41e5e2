"""A request as a streaming aggregation.

Standard mode is a projection and one grouped aggregate, so it runs on a stream as it is; a request that
explodes an array does too. The result is complete after each batch (output mode `complete`): groups have
no event time by which they could be dropped, so state grows with the number of groups.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import ROW_ID, Options, Plan
from ..request import Request
from ..schema import walk


def aggregate_stream(
    stream: DataFrame, request: Request | Mapping[str, Any] | str, row_id: str | None = None, today: dt.date | None = None, options: Options = Options()
) -> DataFrame:
    """The request's result as a streaming DataFrame, to be written in complete mode.

    `row_id` names a column whose order is the records' order; without one all records tie, and groups come
    in no particular order. Distinct counts over records need exact sets of values, which Spark does not
    keep for streams; over arrays inside records they work. A request without groupBy needs an aggregation.
    """
    r = Request.of(request)
    if not stream.isStreaming:
        raise ValueError("not a stream; use aggregate()")
    if any(a.op == "count_distinct" and "." not in a.field for a in r.aggregations):
        raise ValueError("count_distinct over records is not possible on a stream")
    if not r.aggregations:
        raise ValueError("a stream needs an aggregation")
    ordered = stream.withColumn(ROW_ID, walk(None, (row_id,)) if row_id else F.lit(0).cast("long"))
    return Plan(ordered, r, today or dt.date.today(), options).build()
