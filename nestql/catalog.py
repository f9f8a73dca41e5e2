"""Named datasets and the engine's entry points."""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.dynamic import DynamicPlan
from .plans.planner import ROW_ID, Options, Plan, quoted
from .request import Request
from .schema import FieldInfo, field_infos, narrowed, walk
from .sources.json import json_lines, json_records
from .sources.xml import XmlOptions, xml_records
from .sources.xsd import Hints, merge_hints, parse_xsd, strip_root


@dataclass(frozen=True)
class Dataset:
    """A registered DataFrame with ROW_ID; `reread` reads its source again with a narrower schema, where that is possible,
    and has to read `keys`."""

    df: DataFrame
    reread: Callable[[T.StructType], DataFrame] | None = None
    keys: tuple[str, ...] = ()
    dynamic: bool = False


class Catalog:
    """Datasets by name. Registering a name again replaces its dataset.

    Field names differ by case, so the session is set to tell them apart. A dataset whose name is an identifier is
    also a temporary view of the session, unless `views` is False.
    """

    def __init__(self, spark: SparkSession, options: Options = Options(), views: bool = True):
        self.spark, self.options, self.views = spark, options, views
        self._data: dict[str, Dataset] = {}
        self._hints: dict[str, Hints] = {}
        self._lock = threading.RLock()
        spark.conf.set("spark.sql.caseSensitive", "true")

    # Registration ------------------------------------------------------------------------------------------

    def register_df(self, name: str, df: DataFrame, row_id: str | None = None) -> DataFrame:
        """Register a DataFrame. `row_id` names the column whose order is the records' order; without one it
        is the order in which Spark reads the rows."""
        return self._keep(name, Dataset(_with_row_id(df, row_id)))

    def _keep(self, name: str, dataset: Dataset) -> DataFrame:
        with self._lock:
            self._data[name] = dataset
            if self.views and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                dataset.df.drop(ROW_ID).createOrReplaceTempView(name)
        return dataset.df

    def register_parquet(self, name: str, path: str, row_id: str | None = None) -> DataFrame:
        """Register Parquet files. Each request reads just the leaves that it names, in arrays at any depth:
        the optimizer narrows a scan no deeper than the first array inside an array."""

        def reread(schema: T.StructType) -> DataFrame:
            return _with_row_id(self.spark.read.schema(schema).parquet(path), row_id)

        whole = self.spark.read.parquet(path)
        return self._keep(name, Dataset(_with_row_id(whole, row_id), reread, (row_id,) if row_id else ()))

    def register_json(self, name: str, source: str | bytes | list, is_path: bool = False, mixed: bool = False) -> DataFrame:
        """Register JSON text, decoded values, or files of it (any path that Spark reads): a record for each line where the
        path ends in .jsonl or .ndjson, else whole documents. `mixed` files have paths that are an array in some records and
        an object in others."""
        return self.register_df(name, json_records(self.spark, source, is_path, mixed))

    def register_dynamic(self, name: str, source: DataFrame | str | bytes | list) -> DataFrame:
        """Register records whose types differ from row to row: decoded values, JSON text, or a DataFrame of JSON texts
        in a column `value`. Requests then run in Python on the executors; see nestql.plans.dynamic."""
        lines = source if isinstance(source, DataFrame) else json_lines(self.spark, source)
        return self._keep(name, Dataset(_with_row_id(lines.select("value"), None), dynamic=True))

    def register_xml(
        self,
        name: str,
        source: DataFrame | str | bytes,
        is_path: bool = False,
        xsd: str | bytes | None = None,
        many: bool = False,
        options: XmlOptions | None = None,
        row_tag: str | None = None,
    ) -> DataFrame:
        """Register an XML document, every document under a path or in the column `value` of a DataFrame, read with the
        hints of its XSD, if any. `row_tag` makes each element of that name under a path a record, so that one large
        file is read by many tasks."""
        hints = self._hints.get(name, Hints())
        if xsd is not None:
            hints = self.register_xsd(name, xsd)
        return self.register_df(name, xml_records(self.spark, source, is_path, hints, many, options or XmlOptions(), row_tag))

    def register_file(self, name: str, path: str, xsd_path: str | None = None) -> DataFrame:
        """Register a JSON or XML file, told apart by suffix."""
        xsd = self._read_text(xsd_path) if xsd_path else None
        if path.lower().endswith((".xml", ".xml.gz")):
            return self.register_xml(name, path, is_path=True, xsd=xsd)
        return self.register_json(name, path, is_path=True)

    def upload(self, body: bytes, content_type: str = "", name: str | None = None) -> str:
        """Register a body that is XML by its type or first byte, else JSON; returns its name."""
        name = name or f"uploaded_{int(dt.datetime.now().timestamp() * 1e9)}"
        if "xml" in content_type.lower() or body.lstrip()[:1] == b"<":
            self.register_xml(name, body)
        else:
            self.register_json(name, body)
        return name

    def register_xsd(self, name: str, xsd: str | bytes) -> Hints:
        """Remember an XSD's hints for the dataset's next XML, united with those it has."""
        with self._lock:
            self._hints[name] = merge_hints(self._hints.get(name, Hints()), strip_root(parse_xsd(xsd)))
            return self._hints[name]

    def _read_text(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(path).collect())

    # Lookup ------------------------------------------------------------------------------------------------

    def get(self, name: str) -> DataFrame | None:
        with self._lock:
            found = self._data.get(name)
        return found and found.df

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._data)

    def hints(self, name: str) -> Hints:
        return self._hints.get(name, Hints())

    def schema(self, name: str) -> list[FieldInfo]:
        df = self.get(name)
        return [] if df is None else field_infos(T.StructType([f for f in df.schema.fields if f.name != ROW_ID]))

    def rows(self, name: str) -> DataFrame:
        """All records, as one column of JSON texts in the records' order."""
        df = self.get(name)
        if df is None:
            raise KeyError(f"dataset {name!r} not found")
        fields = [F.col(quoted(c)) for c in df.columns if c != ROW_ID]
        return df.orderBy(ROW_ID).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))

    # Queries -----------------------------------------------------------------------------------------------

    def aggregate(self, request: Request | Mapping[str, Any] | str, today: dt.date | None = None, options: Options | None = None) -> DataFrame:
        """Run a request: inline data if it has some, else its dataset."""
        r = Request.of(request)
        if r.data:
            df = _with_row_id(json_records(self.spark, r.data), None)
        else:
            with self._lock:
                found = self._data.get(r.dataset)
            if found is None:
                raise KeyError(f"dataset {r.dataset!r} not found")
            df = found.df
            if found.dynamic:
                return DynamicPlan(df, ROW_ID, r, today or dt.date.today(), options or self.options).build()
            if found.reread is not None:
                used = narrowed(T.StructType([f for f in df.schema.fields if f.name != ROW_ID]), [*r.paths(), *found.keys])
                df = found.reread(used) if used.fields else df
        return Plan(df, r, today or dt.date.today(), options or self.options).build()


def _with_row_id(df: DataFrame, row_id: str | None) -> DataFrame:
    return df.withColumn(ROW_ID, walk(None, (row_id,)) if row_id else F.monotonically_increasing_id())


def aggregate(df: DataFrame, request: Request | Mapping[str, Any] | str, row_id: str | None = None, today: dt.date | None = None, options: Options = Options()) -> DataFrame:
    """Run a request against a DataFrame that is in no catalog."""
    return Plan(_with_row_id(df, row_id), Request.of(request), today or dt.date.today(), options).build()


def iterate_rows(df: DataFrame) -> Iterator[dict[str, Any]]:
    """A result's rows, read one partition at a time, with columns in order and numbers that JSON cannot hold as null."""
    for row in df.toLocalIterator():
        item = {}
        for name, v in zip(df.columns, row, strict=True):
            bad = isinstance(v, float) and (v != v or v in (float("inf"), float("-inf")))
            item[name] = None if bad else v.toPython() if isinstance(v, T.VariantVal) else v.asDict(True) if hasattr(v, "asDict") else v
        yield item


def result_rows(df: DataFrame) -> list[dict[str, Any]]:
    """All of a result's rows, for results that the caller can hold."""
    return list(iterate_rows(df))


def json_chunks(texts: Iterable[str], size: int = 1 << 16) -> Iterator[str]:
    """A JSON array of the texts, in chunks of about `size` characters."""
    part, length = ["["], 0
    for i, text in enumerate(texts):
        part.append("," + text if i else text)
        length += len(text)
        if length >= size:
            yield "".join(part)
            part, length = [], 0
    yield "".join([*part, "]"])


def to_json(df: DataFrame) -> str:
    return "".join(json_chunks(json.dumps(r, ensure_ascii=False) for r in iterate_rows(df)))
