"""XSD hints for reading XML: which paths hold text, and which repeat."""

from __future__ import annotations

import sys
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # hints go to executors

#: Schema types whose values stay text, in lower case, as names are compared without case.
TEXT_TYPES = frozenset(
    "string normalizedstring token language name ncname id idref idrefs anyuri date time datetime gyearmonth gyear gmonthday gday gmonth duration hexbinary base64binary".split()
)


@dataclass(frozen=True)
class Hints:
    text_paths: frozenset[str] = frozenset()
    array_paths: frozenset[str] = frozenset()


def _local(name: str) -> str:
    return name.rpartition("}")[2].rpartition(":")[2]


def parse_xsd(xsd: str | bytes) -> Hints:
    """Paths from the root element down. Named types, bases of simple types, attributes and repeats of
    groups are not followed. An element repeats if maxOccurs is given and is neither 0 nor 1."""
    texts: set[str] = set()
    arrays: set[str] = set()

    def visit(node: ET.Element, path: str) -> None:
        for child in node:
            if not isinstance(child.tag, str):
                continue
            here = path
            if _local(child.tag) == "element":
                name = child.get("name") or _local(child.get("ref") or "")
                if name:
                    here = f"{path}.{name}" if path else name
                    if child.get("maxOccurs", "1") not in ("", "0", "1"):
                        arrays.add(here)
                    if _local(child.get("type") or "").lower() in TEXT_TYPES:
                        texts.add(here)
            visit(child, here)

    visit(ET.fromstring(xsd), "")
    return Hints(frozenset(texts), frozenset(arrays))


def strip_root(hints: Hints) -> Hints:
    """The paths below the root element."""

    def below(paths: frozenset[str]) -> frozenset[str]:
        return frozenset(p.partition(".")[2] for p in paths if "." in p)

    return Hints(below(hints.text_paths), below(hints.array_paths))


def merge_hints(a: Hints, b: Hints) -> Hints:
    return Hints(a.text_paths | b.text_paths, a.array_paths | b.array_paths)
