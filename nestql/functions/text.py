"""Text forms of values, and comparing a column with a literal of another type."""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a null is in a comparison of texts.
NULL_TEXT = "<nil>"


def number_text(x: Column) -> Column:
    """A double's shortest digits: plain for decimal exponents -4 to 5, else d.ddde+XX (42, 0.0001, 2.5e+07)."""
    java = x.cast("double").cast("string")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    bare = F.ltrim(java, F.lit("-"))
    scientific = bare.contains("E")
    mantissa = F.split_part(bare, F.lit("E"), F.lit(1))
    digits = F.regexp_replace(F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+(?=.)", ""), "(?<=.)0+$", "")
    exponent = (
        F.when(scientific, F.split_part(bare, F.lit("E"), F.lit(2)).try_cast("int"))
        .when(bare.startswith("0."), -F.length(F.regexp_extract(bare, r"^0\.(0*)", 1)) - 1)
        .otherwise(F.length(F.split_part(bare, F.lit("."), F.lit(1))) - 1)
    )
    shown = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
    power = F.concat(F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    long_power = F.concat(F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))
    tiny = F.concat(F.lit("0.000"), digits)
    return (
        F.when(F.isnan(x.cast("double")), "NaN")
        .when(bare == "Infinity", F.when(sign == "-", "-Inf").otherwise("+Inf"))
        .when(x == 0, F.lit("0"))
        .when(exponent == -4, F.concat(sign, tiny))
        .when((exponent < -4) | (exponent >= 6), F.concat(sign, shown, F.when(F.abs(exponent) > 99, long_power).otherwise(power)))
        .otherwise(F.concat(sign, F.regexp_replace(bare, r"\.0$", "")))
    )


def literal_text(value: Any) -> str:
    """The same for a literal."""
    if value is None:
        return NULL_TEXT
    if isinstance(value, bool):
        return "true" if value else "false"
    if not isinstance(value, (int, float)):
        return str(value)
    x = float(value)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "0"
    shortest = Decimal(repr(abs(x)))
    raw, exp = "".join(map(str, shortest.as_tuple().digits)).rstrip("0"), shortest.adjusted()
    sign = "-" if x < 0 else ""
    if -4 <= exp < 6:
        if exp < 0:
            return f"{sign}0.{'0' * (-exp - 1)}{raw}"
        return sign + (raw[: exp + 1].ljust(exp + 1, "0") + ("." + raw[exp + 1 :] if raw[exp + 1 :] else ""))
    body = raw[0] + ("." + raw[1:] if raw[1:] else "")
    return f"{sign}{body}e{'-' if exp < 0 else '+'}{abs(exp):02d}"


def text_of(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return number_text(v)
    return v.cast("string")


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def comparable(v: Column, kind: T.DataType, literal: Any) -> tuple[Column, Column]:
    """The two sides of a comparison: as numbers if both are, else as texts in byte order.

    Whole literals meet whole columns uncast, so that the comparison can be pushed down to the scan.
    """
    if isinstance(kind, T.NumericType) and is_number(literal):
        if isinstance(kind, T.IntegralType) and float(literal).is_integer() and abs(literal) < 1 << 53:
            return v, F.lit(int(literal))
        return v.cast("double"), F.lit(float(literal))
    return text_of(v, kind), F.lit(literal_text(literal))
