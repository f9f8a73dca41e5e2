"""The request: element filters, record filters, grouping and aggregations, as decoded from JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .functions.text import is_number


@dataclass(frozen=True)
class Aggregation:
    field: str
    op: str
    alias: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.alias or f"{self.op}_{self.field.replace('.', '_')}"

    @property
    def n(self) -> int:
        n = self.params.get("n")
        return int(n) if is_number(n) else 6

    @property
    def value(self) -> float:
        v = self.params.get("value")
        return float(v) if is_number(v) else 0.0

    def text(self, name: str, default: str = "") -> str:
        v = self.params.get(name)
        return v if isinstance(v, str) and v else default


@dataclass(frozen=True)
class Request:
    dataset: str = ""
    data: list | None = None
    local_filter: Mapping[str, Mapping[str, Mapping[str, Any]]] = field(default_factory=dict)
    where: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    filter_mode: str = "auto"

    @staticmethod
    def of(request: Request | Mapping[str, Any] | str) -> Request:
        """From a request, its JSON text, or that decoded."""
        if isinstance(request, Request):
            return request
        raw = json.loads(request) if isinstance(request, str) else request
        aggregations = tuple(
            Aggregation(a.get("field") or "", a.get("op") or "", a.get("alias") or "", a.get("params") or {}) for a in raw.get("aggregations") or ()
        )
        return Request(
            raw.get("dataset") or "",
            raw.get("data") or None,
            raw.get("localFilter") or {},
            raw.get("where") or {},
            tuple(raw.get("groupBy") or ()),
            aggregations,
            raw.get("filterMode") or "auto",
        )

    def paths(self) -> list[str]:
        """Every dotted path that the request can read; conditions may be relative to their array or not."""
        found = [*self.group_by, *self.where, *[a.field for a in self.aggregations]]
        for path, conditions in self.local_filter.items():
            found += [f if f.startswith(f"{path}.") else f"{path}.{f}" for f in conditions]
        for a in self.aggregations:
            date = a.text("date_field")
            around = a.field.split(".")
            found += [".".join([*around[:i], date]) for i in range(1, len(around))] if date else []
        return found
