"""JSON records: an array's elements, or any other value as one record."""

from __future__ import annotations

import json
import re
import sys
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # helpers run on executors, which may not have the package


def inferred_schema(lines: DataFrame) -> T.StructType:
    """The schema of all JSON texts in the only column of lines, inferred on the executors' side of the JVM."""
    spark = lines.sparkSession
    texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return T.StructType.fromJson(json.loads(spark.read._jreader.json(texts).schema().json()))


def json_lines(spark: SparkSession, source: str | bytes | list) -> DataFrame:
    """The records of JSON text or decoded values as JSON texts, in order, in a column `value`."""
    values: Any = json.loads(source) if isinstance(source, (str, bytes)) else source
    records = [v for v in (values if isinstance(values, list) else [values]) if isinstance(v, dict)]
    return spark.createDataFrame(pa.table({"value": pa.array([json.dumps(r) for r in records], pa.string())}))


def repeated_paths(value: Any, path: str = "") -> set[str]:
    """Paths whose value is an array."""
    if isinstance(value, list):
        return {path}.union(*[repeated_paths(v, path) for v in value])
    if isinstance(value, dict):
        return set().union(*[repeated_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()])
    return set()


def with_arrays(value: Any, paths: set[str], path: str = "") -> Any:
    """The value with every object that stands on one of the paths in an array of its own."""
    if isinstance(value, list):
        return [with_arrays(v, paths - {path}, path) for v in value]
    if isinstance(value, dict):
        inner = {k: with_arrays(v, paths, f"{path}.{k}" if path else k) for k, v in value.items()}
        return [inner] if path and path in paths else inner
    return value


def _with_arrays_in_all(lines: DataFrame) -> DataFrame:
    """JSON texts in which every path that is an array in any of them is one in all. Only the distinct paths reach the driver."""

    def paths(batches):
        for batch in batches:
            found = set().union(*[repeated_paths(json.loads(t)) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["value"])

    arrays = {r.value for r in lines.mapInArrow(paths, "value string").distinct().collect()}

    def run(batches):
        for batch in batches:
            texts = [json.dumps(with_arrays(json.loads(t), arrays)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    return lines.mapInArrow(run, "value string")


def _document_lines(texts: DataFrame) -> DataFrame:
    """The records of documents in the column `value`: an array's elements, or the document."""

    def run(batches):
        for batch in batches:
            values = [json.loads(t) for t in batch.column(0).to_pylist() if t.strip()]
            records = [r for v in values for r in (v if isinstance(v, list) else [v]) if isinstance(r, dict)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in records], pa.string())], ["value"])

    return texts.mapInArrow(run, "value string")


def json_records(spark: SparkSession, source: str | bytes | list, is_path: bool = False, mixed: bool = False) -> DataFrame:
    """One row for each record; what is no object is left out, as it has no fields. Types are inferred over all records.

    Where a path is an array in some records and an object in others, in values and texts the object becomes an array of one,
    as it does in files if they are said to be `mixed`: those are parsed in Python, all others by Spark's own reader.

    Files of lines (.jsonl, .ndjson, or compressed so) are split; any other file is read whole, so a large dataset should be
    many files or lines.
    """
    if is_path:
        by_line = re.search(r"\.(jsonl|ndjson)(\.\w+)?$", source, re.I) is not None
        if not mixed:
            return spark.read.option("multiLine", not by_line).json(source)
        lines = _with_arrays_in_all(_document_lines(spark.read.option("wholetext", not by_line).text(source)))
        return lines.select(F.from_json("value", inferred_schema(lines)).alias("r")).select("r.*")
    values = json.loads(source) if isinstance(source, (str, bytes)) else source
    records = values if isinstance(values, list) else [values]
    paths = set().union(*[repeated_paths(r) for r in records if isinstance(r, dict)])
    lines = json_lines(spark, [with_arrays(r, paths) for r in records])
    schema = inferred_schema(lines)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*") if schema.fields else lines.select()
