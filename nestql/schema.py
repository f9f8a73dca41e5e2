"""The data model: nested struct and array columns, walked as dotted field paths."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldInfo(NamedTuple):
    """A leaf: its path, type, and the path of the nearest array of objects around it ('' for none)."""

    path: str
    type: str
    array_path: str


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NullType):
        return "null"
    return "string"


def field_infos(schema: T.StructType, prefix: str = "", array_path: str = "") -> list[FieldInfo]:
    """All leaves and arrays in name order; an object itself is no field."""
    found: list[FieldInfo] = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        path = f"{prefix}{f.name}"
        kind = f.dataType
        if isinstance(kind, T.StructType):
            found += field_infos(kind, f"{path}.", array_path)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found.append(FieldInfo(path, "array_object", array_path))
            found += field_infos(kind.elementType, f"{path}.", path)
        elif isinstance(kind, T.ArrayType):
            inner = _type_name(kind.elementType)
            name = {"number": "array_number", "string": "array_string", "null": "array_empty"}.get(inner, "array_primitive")
            found.append(FieldInfo(path, name, array_path))
        else:
            found.append(FieldInfo(path, _type_name(kind), array_path))
    return found


@dataclass(frozen=True)
class Path:
    """A resolved field path: names from one array of objects to the next, and the type of what it ends at.

    `steps` has one list of names for each array of objects on the way, and the names behind the last
    (empty where the path ends at an array of objects). `kind` is None where the path does not resolve.
    """

    text: str
    steps: tuple[tuple[str, ...], ...]
    kind: T.DataType | None

    @property
    def arrays(self) -> list[str]:
        out: list[str] = []
        for step in self.steps[:-1]:
            out.append(".".join([*out[-1:], *step]))
        return out

    @property
    def array_path(self) -> str:
        return self.arrays[-1] if self.arrays else ""


def resolve(schema: T.StructType, text: str) -> Path:
    """Walk a dotted path through objects and arrays of objects; a literal dotted top-level name also counts."""
    names = text.split(".") if text else []
    kind: T.DataType = schema
    steps: list[tuple[str, ...]] = []
    now: list[str] = []
    for i, name in enumerate(names):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            if text in schema.names:
                return Path(text, ((text,),), schema[text].dataType)
            return Path(text, (*steps, tuple([*now, *names[i:]])), None)
        kind = kind[name].dataType
        now.append(name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            steps.append(tuple(now))
            now = []
            if i < len(names) - 1:
                kind = kind.elementType
    return Path(text, (*steps, tuple(now)), kind if names else None)


def walk(start: Column | None, names: tuple[str, ...]) -> Column:
    """The field that names lead to, from a column or from the record itself."""
    if start is None:
        start, names = F.col(f"`{names[0].replace('`', '``')}`"), names[1:]
    return reduce(lambda c, n: c.getField(n), names, start)


def leaf(v: Column, kind: T.DataType | None) -> tuple[Column, T.DataType | None]:
    """A value as the data model has it: dates, times and other scalars are strings; numbers keep their type
    until they are computed with, so that comparing them reaches the scan."""
    kept = (T.NumericType, T.BooleanType, T.StringType, T.ArrayType, T.StructType)
    if kind is None or isinstance(kind, kept):
        return v, kind
    return v.cast("string"), T.StringType()


def shown(v: Column, kind: T.DataType | None) -> Column:
    """A value in a result, where every number is a double."""
    v, kind = leaf(v, kind)
    if isinstance(kind, T.NumericType):
        return v.cast("double")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return v.cast("array<double>")
    return v


def narrowed(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The schema with only the fields that lie on one of the dotted paths; a path's end keeps all it holds."""
    tails: dict[str, list[str]] = {}
    for p in paths:
        if p in schema.names:
            tails.setdefault(p, []).append("")
        head, _, tail = p.partition(".")
        tails.setdefault(head, []).append(tail)

    def inner(kind: T.DataType, rest: list[str]) -> T.DataType:
        if "" in rest:
            return kind
        if isinstance(kind, T.StructType):
            return narrowed(kind, rest) if any(r.split(".")[0] in kind.names for r in rest) else kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(inner(kind.elementType, rest), kind.containsNull)
        return kind

    kept = [f for f in schema.fields if f.name in tails]
    return T.StructType([T.StructField(f.name, inner(f.dataType, tails[f.name]), f.nullable) for f in kept])
