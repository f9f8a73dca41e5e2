"""Lossless XML: a document becomes one record of nested objects, arrays and scalars."""

from __future__ import annotations

import json
import math
import re
import sys
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json import inferred_schema, json_records, repeated_paths
from .xsd import Hints

# parsers run on executors, which may not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INT = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


@dataclass(frozen=True)
class XmlOptions:
    attribute_prefix: str = "@"
    text_key: str = "#text"


def coerce(text: str) -> Any:
    """true and false to booleans, numbers to floats; codes with a leading zero and integers of over 15 digits stay text.

    The words for infinity and not-a-number stay text too, since JSON has no such numbers.
    """
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if len(text) > 1 and text[0] == "0" and text[1] != ".":
        return text
    if _INT.fullmatch(text):
        return float(text) if len(text.lstrip("-")) <= 15 else text
    if _FLOAT.fullmatch(text) and math.isfinite(float(text)):
        return float(text)
    return text


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ET.Element) -> str:
    """Own text chunks, each trimmed, joined without separator."""
    return "".join((t or "").strip() for t in [node.text, *[c.tail for c in node]])


def to_value(node: ET.Element, hints: Hints = Hints(), options: XmlOptions = XmlOptions(), path: str = "") -> Any:
    """The value of an element whose path from below the root is `path`: null, a scalar, or an object."""
    text = _text(node)
    children = [c for c in node if isinstance(c.tag, str)]

    def scalar() -> Any:
        return text if path in hints.text_paths else coerce(text)

    if not children and not node.attrib:
        return scalar() if text else None
    out: dict[str, Any] = {options.attribute_prefix + _name(k): coerce(v) if v else v for k, v in node.attrib.items()}
    if text:
        out[options.text_key] = scalar()
    groups: dict[str, list[Any]] = {}
    for c in children:
        name = _name(c.tag)
        groups.setdefault(name, []).append(to_value(c, hints, options, f"{path}.{name}" if path else name))
    for name, values in groups.items():
        here = f"{path}.{name}" if path else name
        out[name] = values if len(values) > 1 or here in hints.array_paths else values[0]
    return out


def parse_xml(xml: str | bytes, hints: Hints = Hints(), options: XmlOptions = XmlOptions()) -> list[Any]:
    """One document as one record: the value of its root. Comments and instructions are ignored."""
    if not xml.strip():
        return []
    value = to_value(ET.fromstring(xml), hints, options)
    return [] if value is None else [value]


def parse_xml_many(xml: str | bytes, hints: Hints = Hints(), options: XmlOptions = XmlOptions()) -> list[Any]:
    """The elements of the root's only child array as records; else the document as one."""
    records = parse_xml(xml, hints, options)
    if records and isinstance(records[0], dict) and len(records[0]) == 1:
        (only,) = records[0].values()
        if isinstance(only, list):
            return only
    return records


_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")


def row_documents(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """A document for each element `row_tag` in the files under a path, in the column `value`.

    Files are split at the element's end tags, so that many tasks read one file. The element must not contain itself,
    and its tags must not stand in comments or character data. Prefixes that are declared further out are declared anew.
    """
    begin = re.compile(rf"<{re.escape(row_tag)}(?=[\s/>])")
    empty = re.compile(rf"<{re.escape(row_tag)}(?:\s[^<>]*)?/>")

    def run(batches):
        for batch in batches:
            found = []
            for part in batch.column(0).to_pylist():
                found += empty.findall(part)
                m = begin.search(empty.sub("", part))
                if m:
                    found.append(m.string[m.start() :] + f"</{row_tag}>")
            whole = []
            for text in found:
                names = sorted(set(_PREFIX.findall(text)) - {"xml", "xmlns"})
                declared = "".join(f' xmlns:{n}="urn:{n}"' for n in names if f"xmlns:{n}=" not in text)
                whole.append(begin.sub(lambda m, d=declared: m[0] + d, text, count=1))
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.string())], ["value"])

    parts = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    return parts.mapInArrow(run, "value string")


def xml_records(
    spark: SparkSession,
    source: DataFrame | str | bytes,
    is_path: bool = False,
    hints: Hints = Hints(),
    many: bool = False,
    options: XmlOptions = XmlOptions(),
    row_tag: str | None = None,
) -> DataFrame:
    """Records of one document, or of all documents under a path or in the column `value` of a DataFrame, whose types are
    inferred over all of them.

    Executors parse documents to JSON: a file each, or with `row_tag` an element of a file each. A first pass finds the paths that are arrays in
    any document, so that those are arrays in all, single children included; only those distinct paths reach the driver.
    """
    if isinstance(source, DataFrame):
        documents = source.select(F.col("value"))
    elif row_tag is not None:
        documents = row_documents(spark, source, row_tag)
    elif is_path:
        documents = spark.read.format("binaryFile").load(source).select("content")
    else:
        return json_records(spark, (parse_xml_many if many else parse_xml)(source, hints, options))

    def paths(batches):
        for batch in batches:
            found = [repeated_paths(r) for body in batch.column(0).to_pylist() for r in parse_xml(body or "", hints, options)]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*found)), pa.string())], ["value"])

    arrays = frozenset(r.value for r in documents.mapInArrow(paths, "value string").distinct().collect())
    known = Hints(hints.text_paths, hints.array_paths | arrays)
    parse = parse_xml_many if many else parse_xml

    def run(batches):
        for batch in batches:
            texts = [json.dumps(r) for body in batch.column(0).to_pylist() for r in parse(body or "", known, options) if isinstance(r, dict)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    lines = documents.mapInArrow(run, "value string")
    return lines.select(F.from_json("value", inferred_schema(lines)).alias("r")).select("r.*")
