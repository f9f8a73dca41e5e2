"""Compiles a request to DataFrame operations.

Standard mode folds arrays inside each record with higher-order functions and then aggregates the records
once, so a record is never multiplied and partial aggregation runs before the only shuffle; where all that is asked for
are sums, counts and extremes of one array's elements, these are exploded and aggregated as they are. Grouping by a
field inside an array instead explodes that array, keeping records whose array is empty. Only the element
fields that a request names are read: arrays are narrowed to them before any lambda sees an element,
since the scan prunes fields it can name but not through lambdas.
"""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import within_period
from ..operators import aggregates as ops
from ..operators.predicates import all_of
from ..request import Aggregation, Request
from ..schema import Path, leaf, resolve, shown, walk

log = logging.getLogger("nestql")

ROW_ID = "__row_id"


@dataclass(frozen=True)
class Options:
    """How to treat what is done differently than one might expect; the defaults are the compatible choices.

    parent_dedup: in explode mode, fields outside the exploded array count for the group's first row only
      ("first") or once for each record of the group ("record").
    nested_avg: an average over arrays in arrays is the mean of the records' means ("mean") or weighs
      every element alike ("weighted").
    nested_filter: whether element filters reach arrays inside arrays; otherwise they are ignored there.
    date_field_anywhere: whether the date_field parameter also holds for arrays that are not in arrays.
    ordered: whether groups come in order of first appearance.
    """

    parent_dedup: str = "first"
    nested_avg: str = "mean"
    nested_filter: bool = False
    date_field_anywhere: bool = False
    ordered: bool = True


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _passing(array: Column, test) -> Column:
    """The elements that pass a test of _element_test."""
    return F.filter(array, lambda e: test(lambda f: walk(e, f)))


def _place(order: list[Column], id_type: T.DataType) -> Column:
    """The order of an exploded row: the record's, then the positions in the arrays, -1 where an array is empty.

    Up to two positions behind a whole number are one decimal, which is aggregated by hashing; Spark sorts to aggregate structs.
    """
    if not isinstance(id_type, T.IntegralType) or len(order) > 3:
        return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    # 19 digits of the record and 9.4 of each position are within 38
    kind = "decimal(38,0)"
    place = order[0].cast(kind)
    for position in order[1:]:
        place = (place * F.lit(1 << 31).cast("decimal(10,0)") + (position + 1).cast("decimal(10,0)")).cast(kind)
    return place


class Plan:
    """One request against one dataset. `df` has ROW_ID, whose order is the records' order."""

    def __init__(self, df: DataFrame, request: Request, today: dt.date, options: Options = Options()):
        self.df, self.request, self.today, self.options = df, request, today, options
        self.schema = T.StructType([f for f in df.schema.fields if f.name != ROW_ID])
        self.paths = {a.field: resolve(self.schema, a.field) for a in request.aggregations}
        self.group = [resolve(self.schema, g) for g in request.group_by]
        self._validate()
        self._route_filters()

    def _validate(self) -> None:
        for a in self.request.aggregations:
            p = self.paths[a.field]
            if p.kind is not None and p.arrays and not p.steps[-1]:
                raise ValueError(f"field {a.field!r} is an array of objects; aggregate one of its fields")

    # Filters -----------------------------------------------------------------------------------------------

    def _route_filters(self) -> None:
        """Conditions on fields inside arrays filter elements, unless the mode is manual; explicit ones win."""
        r = self.request
        element: dict[str, dict[str, dict]] = {}
        self.where: dict[str, dict] = {}
        for field, conditions in r.where.items():
            p = resolve(self.schema, field)
            path = p.array_path if p.kind is not None and p.steps[-1] else ""
            if path and r.filter_mode != "manual":
                element.setdefault(path, {})[field] = dict(conditions)
            else:
                self.where[field] = dict(conditions)
        for path, fields in r.local_filter.items():
            element.setdefault(path, {}).update({f: dict(c) for f, c in fields.items()})
        self.element_filters: dict[str, dict[str, dict]] = {}
        for path, fields in element.items():
            p = resolve(self.schema, path)
            relative = {f.removeprefix(f"{path}."): c for f, c in fields.items()}
            if p.kind is None or not p.arrays or p.steps[-1] or not relative:
                continue
            if len(p.arrays) > 1 and not self.options.nested_filter:
                log.warning("the filter on %s is ignored: it lies inside another array", path)
                continue
            self.element_filters[path] = relative

    def _record_filter(self) -> Column | None:
        def value(field: str):
            p = resolve(self.schema, field)
            inside = p.kind is None or len(p.steps) > 1 and bool(p.steps[-1])
            return (F.lit(None), None) if inside else leaf(walk(None, p.steps[0]), p.kind)

        return all_of(self.where, value, self.today)

    def _element_test(self, path: str, element_type: T.StructType):
        """A test of an element, or None; with the names of the fields it reads."""
        conditions = self.element_filters.get(path)
        if not conditions:
            return None, []
        resolved = {f: resolve(element_type, f) for f in conditions}
        names = [p.steps[0] for p in resolved.values() if p.kind is not None and len(p.steps) == 1]

        def test(get):
            def value(field: str):
                p = resolved[field]
                usable = p.kind is not None and len(p.steps) == 1
                return leaf(get(p.steps[0]), p.kind) if usable else (F.lit(None), None)

            return all_of(conditions, value, self.today)

        return test, names

    # Arrays inside records ---------------------------------------------------------------------------------

    def _elements(self, path: str, needed: list[tuple[str, ...]]) -> tuple[Column, dict[tuple[str, ...], str]]:
        """The array at a path of one array, filtered and narrowed to the needed fields, and the fields' names in it."""
        p = resolve(self.schema, path)
        array = walk(None, p.steps[0])
        test, tested = self._element_test(path, p.kind.elementType)
        fields = list(dict.fromkeys([*needed, *tested]))
        if not fields:
            return F.transform(array, lambda _: F.struct(F.lit(1).alias("f"))), {}
        names = {f: f"f{i}" for i, f in enumerate(fields)}
        zipped = F.arrays_zip(*[walk(array, f).alias(n) for f, n in names.items()])
        if test is not None:
            zipped = F.filter(zipped, lambda e: test(lambda f: e[names[f]]))
        return zipped, names

    def _dated(self, a: Aggregation, deep: bool) -> tuple[str, ...] | None:
        field = a.text("date_field")
        return tuple(field.split(".")) if field and (deep or self.options.date_field_anywhere) else None

    def _in_window(self, a: Aggregation, date: Column, kind: T.DataType | None) -> Column:
        """Elements whose date is missing or is no string stay."""
        date, kind = leaf(date, kind)
        if not isinstance(kind, T.StringType):
            return F.lit(True)
        return date.isNull() | within_period(date, a.n, a.text("unit", "month"), a.params.get("ref_date"), self.today)

    def _record_result(self, a: Aggregation, p: Path, shared: dict[str, tuple[Column, dict]]) -> Column:
        """The aggregation over the arrays of one record."""
        outer = p.arrays[0]
        array, names = shared[outer]
        if len(p.arrays) == 1:
            rel = p.steps[1]
            date = self._dated(a, deep=False)
            if date and date in names:
                kind = resolve(resolve(self.schema, outer).kind.elementType, ".".join(date)).kind
                array = F.filter(array, lambda e: self._in_window(a, e[names[date]], kind))
            if p.kind is None:
                return ops.fold_array(a.op, F.when(array.isNotNull(), F.array().cast("array<double>")))
            plain = array[names[rel]]
            if a.op in ("sum", "avg", "min", "max") and isinstance(p.kind, T.NumericType):
                return ops.fold_array(a.op, plain if isinstance(p.kind, T.DoubleType) else plain.cast("array<double>"))
            items = F.transform(plain, lambda v: ops.contribution(a, *leaf(v, p.kind), self.today, element=True))
            return ops.fold_array(a.op, items)
        element = resolve(self.schema, outer).kind.elementType
        first = p.steps[1]
        inner = F.transform(array[names[first]], lambda x: self._nested(a, p, 1, x, outer, element))
        return ops.fold_results(a.op, inner, ops.is_pair(a.op, len(p.arrays) - 1))

    def _nested(self, a: Aggregation, p: Path, depth: int, array: Column, outer: str, element: T.StructType) -> Column:
        """The aggregation over the array that is `depth` arrays deep, for one element of the array around it."""
        path = p.arrays[depth]
        own = resolve(element, path.removeprefix(f"{outer}.")).kind.elementType
        test, _ = self._element_test(path, own)
        if test is not None:
            array = _passing(array, test)
        rel = p.steps[depth + 1]
        if depth == len(p.arrays) - 1:
            if p.kind is None:  # no element has such a field
                return ops.fold_array(a.op, F.when(array.isNotNull(), F.array().cast("array<double>")))
            date = self._dated(a, deep=True)
            if date:
                kind = resolve(own, ".".join(date)).kind
                array = F.filter(array, lambda e: self._in_window(a, walk(e, date), kind)) if kind is not None else array
            items = F.transform(array, lambda e: ops.contribution(a, *leaf(walk(e, rel), p.kind), self.today, element=True))
            return ops.fold_array(a.op, items)
        inner = F.transform(array, lambda e: self._nested(a, p, depth + 1, walk(e, rel), path, own))
        return ops.fold_results(a.op, inner, ops.is_pair(a.op, len(p.arrays) - depth - 1))

    def _weighted(self, a: Aggregation) -> list[Aggregation]:
        """A weighted average over nested arrays is a sum over a count of numbers."""
        return [Aggregation(a.field, "sum", "total", a.params), Aggregation(a.field, "count", "n", a.params)]

    # Modes -------------------------------------------------------------------------------------------------

    def build(self) -> DataFrame:
        rows = self.df
        keep = self._record_filter()
        if keep is not None:
            rows = rows.where(keep)
        exploded = [p for p in self.group if p.kind is not None and p.arrays and p.steps[-1]]
        return self._explode_mode(rows, exploded) if exploded else self._standard_mode(rows)

    def _keys(self, columns: list[Column]) -> dict[str, Column]:
        return dict(zip([p.text for p in self.group], columns, strict=True))

    def _aggregate(self, rows: DataFrame, keys: dict[str, Column], values: dict[str, Column], first: Column) -> DataFrame:
        """Group, then put columns in request order: keys, then aggregates; a later equal name takes the earlier one's place."""
        names = list(dict.fromkeys([*keys, *values]))
        if not keys:
            out = self._one_row(rows, values)
        else:
            grouped = rows.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())])
            order = [first.alias("__first")] if self.options.ordered or not values else []
            out = grouped.agg(*order, *[c.alias(f"v{i}") for i, c in enumerate(values.values())])
            out = out.orderBy("__first") if self.options.ordered else out
        at = {n: f"k{i}" for i, n in enumerate(keys)} | {n: f"v{i}" for i, n in enumerate(values)}
        return out.select(*[F.col(at[n]).alias(n) for n in names])

    def _one_row(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """One aggregate row, or none for an empty dataset: nothing was selected from nothing.

        Where a filter may have left no row, a second one-row aggregate that reads no column tells whether the dataset has any.
        """
        names = [f"v{i}" for i in range(len(values))]
        out = rows.agg(*[c.alias(n) for n, c in zip(names, values.values(), strict=True)], F.count("*").alias("__n"))
        if self._record_filter() is not None:
            # a distinct constant needs none of the dataset's columns, so the optimizer drops the joins that make them
            held = self.df.select(F.lit(1).cast("long").alias("__n")).distinct()
            both = out.unionByName(held, allowMissingColumns=True)
            out = both.agg(*[F.max(n).alias(n) for n in names], F.max("__n").alias("__n"))
        return out.where(F.col("__n") > 0).drop("__n")

    def _plain_elements(self) -> tuple[str, ...] | None:
        """The arrays around all aggregated fields, if these are the same and elements can be aggregated as they are: then no
        record needs a result of its own. Averages over arrays in arrays are of records, and last-n operations have zeros for records."""
        chains = {tuple(self.paths[a.field].arrays) for a in self.request.aggregations}
        if len(chains) != 1 or not (chain := chains.pop()):
            return None
        for a in self.request.aggregations:
            weighted = len(chain) == 1 or self.options.nested_avg == "weighted"
            if a.op not in ("sum", "count", "count_rows", "min", "max") and not (a.op == "avg" and weighted):
                return None
        return chain

    def _element_mode(self, rows: DataFrame, chain: tuple[str, ...]) -> DataFrame:
        """Explode the arrays and aggregate their elements, which generated code does faster than higher-order functions fold them."""
        outer = chain[0]
        keys = self._keys([shown(walk(None, p.steps[0]), p.kind) if p.kind is not None else F.lit(None).cast("string") for p in self.group])
        deep = len(chain) > 1
        element = resolve(self.schema, outer).kind.elementType
        fields = []
        for a in self.request.aggregations:
            p, date = self.paths[a.field], self._dated(a, deep)
            if deep or p.kind is not None:
                fields.append(p.steps[1])
            if not deep and date and resolve(element, ".".join(date)).kind is not None:
                fields.append(date)
        array, names = self._elements(outer, fields)
        named = {f"__key{i}": c for i, c in enumerate(keys.values())}
        rows = rows.select(ROW_ID, *[c.alias(n) for n, c in named.items()], F.posexplode_outer(array).alias("__pos", "__element"))
        for depth, path in enumerate(chain[1:], 1):
            field = self.paths[self.request.aggregations[0].field].steps[depth]
            inner = F.col("__element")[names[field]] if depth == 1 else walk(F.col("__element"), field)
            element = resolve(element, ".".join(field)).kind.elementType
            test, _ = self._element_test(path, element)
            if test is not None:
                inner = _passing(inner, test)
            rows = rows.select(ROW_ID, *named, F.posexplode_outer(inner).alias("__pos", "__element"))

        def get(field: tuple[str, ...]) -> Column:
            return walk(F.col("__element"), field) if deep else F.col("__element")[names[field]]

        values: dict[str, Column] = {}
        for a in self.request.aggregations:
            p, date = self.paths[a.field], self._dated(a, deep)
            value, kind = leaf(get(p.steps[-1]), p.kind) if p.kind is not None else (F.lit(None).cast("double"), None)
            there = F.col("__pos").isNotNull() if p.kind is not None else F.lit(False)
            if date and (dated := resolve(element, ".".join(date)).kind) is not None:
                there &= self._in_window(a, get(date), dated)
            item = F.when(there, ops.contribution(a, value, kind, self.today, element=True))
            values[a.name] = ops.finish(a.op, ops.fold_group(ops.merge_of(a.op), item))
        return self._aggregate(rows, {k: F.col(n) for k, n in zip(keys, named, strict=True)}, values, F.min(ROW_ID))

    def _standard_mode(self, rows: DataFrame) -> DataFrame:
        chain = self._plain_elements()
        if chain is not None:
            return self._element_mode(rows, chain)
        needed: dict[str, list[tuple[str, ...]]] = {}
        for a in self.request.aggregations:
            p = self.paths[a.field]
            if p.arrays:
                fields = needed.setdefault(p.arrays[0], [])
                if p.kind is not None:
                    fields.append(p.steps[1])
                date = self._dated(a, deep=False)
                if len(p.arrays) == 1 and date and resolve(resolve(self.schema, p.arrays[0]).kind.elementType, ".".join(date)).kind is not None:
                    fields.append(date)
        keys = self._keys([shown(walk(None, p.steps[0]), p.kind) if p.kind is not None else F.lit(None).cast("string") for p in self.group])
        shared = {path: self._elements(path, fields) for path, fields in needed.items()}
        # arrays are narrowed and filtered once, in a projection of their own, however many aggregations fold them
        columns = {path: f"__array{i}" for i, path in enumerate(shared)}
        if shared:
            rows = rows.withColumns({columns[path]: array for path, (array, _) in shared.items()})
            shared = {path: (F.col(columns[path]), names) for path, (_, names) in shared.items()}
        results: dict[str, Column] = {}
        values: dict[str, Column] = {}

        def result(a: Aggregation, p: Path) -> Column:
            name = f"__record{len(results)}"
            results[name] = self._record_result(a, p, shared)
            return F.col(name)

        for a in self.request.aggregations:
            p = self.paths[a.field]
            if not p.arrays:
                value, kind = leaf(walk(None, p.steps[0]), p.kind) if p.kind is not None else (None, None)
                if a.op == "count_rows" and value is not None:
                    around = walk(None, p.steps[0][:-1]) if len(p.steps[0]) > 1 else None
                    item = F.lit(1.0) if around is None else F.when(around.isNotNull(), 1.0)
                else:
                    item = ops.contribution(a, value, kind, self.today)
                folded = ops.fold_group(ops.merge_of(a.op), item)
            elif a.op == "avg" and len(p.arrays) > 1 and self.options.nested_avg == "weighted":
                total, n = (F.sum(result(part, p)) for part in self._weighted(a))
                folded = F.when(n > 0, total / n)
            else:
                folded = ops.fold_records(a.op, result(a, p), len(p.arrays))
            values[a.name] = ops.finish(a.op, folded)
        if results:
            rows = rows.withColumns(results)
        return self._aggregate(rows, keys, values, F.min(ROW_ID))

    def _explode_mode(self, rows: DataFrame, exploded: list[Path]) -> DataFrame:
        """Explode the arrays on the longest grouped path, outermost first, then aggregate the elements once."""
        chain = max((p.arrays for p in exploded), key=len)
        for p in exploded:
            if p.arrays != chain[: len(p.arrays)]:
                raise ValueError(f"cannot group by {p.text!r} together with fields of {chain[-1]!r}: neither array holds the other")
        outer = chain[0]
        inside = [p for p in [*self.group, *self.paths.values()] if p.arrays and p.arrays[0] == outer and p.kind is not None]
        array, names = self._elements(outer, [p.steps[1] for p in inside])
        rows = rows.select("*", F.posexplode_outer(array).alias("__pos0", "__element0"))
        element = resolve(self.schema, outer).kind.elementType
        order = [F.col(ROW_ID), F.coalesce("__pos0", F.lit(-1))]
        for depth, path in enumerate(chain[1:], 1):
            field = tuple(path.removeprefix(f"{chain[depth - 1]}.").split("."))
            before = F.col(f"__element{depth - 1}")
            inner = before[names[field]] if depth == 1 else walk(before, field)
            element = resolve(element, ".".join(field)).kind.elementType
            test, _ = self._element_test(path, element)
            if test is not None:
                inner = _passing(inner, test)
            rows = rows.select("*", F.posexplode_outer(inner).alias(f"__pos{depth}", f"__element{depth}"))
            order.append(F.coalesce(f"__pos{depth}", F.lit(-1)))

        def value(p: Path) -> tuple[Column, T.DataType | None]:
            """The field of an exploded row; a path into an array that is not exploded ends at that array."""
            if p.kind is None:
                return F.lit(None).cast("double"), None
            shared = 0
            while shared < min(len(p.arrays), len(chain)) and p.arrays[shared] == chain[shared]:
                shared += 1
            if shared == 0:
                kind = p.kind if not p.arrays else resolve(self.schema, p.arrays[0]).kind
                return leaf(walk(None, p.steps[0]), kind)
            if shared == len(p.arrays):
                kind, rel = p.kind, p.steps[shared]
            else:
                kind, rel = resolve(self.schema, p.arrays[shared]).kind, p.steps[shared]
            start = F.col(f"__element{shared - 1}")
            return leaf(start[names[rel]] if shared == 1 else walk(start, rel), kind)

        rows = rows.withColumn("__place", _place(order, self.df.schema[ROW_ID].dataType))
        keys = self._keys([shown(*value(p)) if p.kind is not None else F.lit(None).cast("string") for p in self.group])
        by_record = self.options.parent_dedup == "record" and any(not p.text.startswith(f"{outer}.") for p in self.paths.values())
        if by_record and not any(p.text.startswith(f"{outer}.") and ops.merge_of(a.op) == "distinct" for a in self.request.aggregations for p in [self.paths[a.field]]):
            return self._by_record(rows, keys, outer, value)
        if by_record:
            rows = self._mark_first(rows, keys)
            keys = {n: F.col(f"__key{i}") for i, n in enumerate(keys)}
        values: dict[str, Column] = {}
        for a in self.request.aggregations:
            p = self.paths[a.field]
            v, kind = value(p)
            merge = ops.merge_of(a.op)
            if p.text.startswith(f"{outer}."):
                folded = ops.fold_group(merge, self._seen(a, v, kind))
            elif by_record:
                folded = ops.fold_group(merge, F.when(F.col("__first_of_record"), self._seen(a, v, kind)))
            else:
                # such a field is the same in all rows of a record, so the record's order decides
                one = self._seen(a, F.min_by(v, F.col(ROW_ID)), kind)
                folded = F.when(one.isNotNull(), 1.0) if merge == "distinct" else one
            values[a.name] = ops.finish(a.op, folded)
        return self._aggregate(rows, keys, values, F.min("__place"))

    def _seen(self, a: Aggregation, v: Column, kind: T.DataType | None) -> Column:
        """Nulls are left out before any operation, so they add nothing, not even a row."""
        item = ops.contribution(a, v, kind, self.today)
        return F.when(v.isNotNull(), item)

    def _by_record(self, rows: DataFrame, keys: dict[str, Column], outer: str, value) -> DataFrame:
        """Fields outside the exploded array from each record of a group once: aggregate by group and record, then by group."""
        names = [f"__key{i}" for i in range(len(keys))]
        first: list[Column] = [F.min("__place").alias("__place")]
        values: dict[str, Column] = {}
        for i, a in enumerate(self.request.aggregations):
            p = self.paths[a.field]
            v, kind = value(p)
            merge, part = ops.merge_of(a.op), F.col(f"__part{i}")
            if not p.text.startswith(f"{outer}."):
                # such a field is the same in all rows of a record
                first.append(F.any_value(v).alias(f"__part{i}"))
                folded = ops.fold_group(merge, self._seen(a, part, kind))
            elif merge == "avg":
                item = self._seen(a, v, kind)
                first += [F.sum(item).alias(f"__part{i}"), F.count(item).alias(f"__count{i}")]
                folded = F.try_divide(F.sum(part), F.sum(f"__count{i}"))
            else:
                first.append(ops.fold_group(merge, self._seen(a, v, kind)).alias(f"__part{i}"))
                folded = ops.fold_group(merge, part)
            values[a.name] = ops.finish(a.op, folded)
        each = rows.groupBy(*[c.alias(n) for n, c in zip(names, keys.values(), strict=True)], ROW_ID).agg(*first)
        return self._aggregate(each, {k: F.col(n) for k, n in zip(keys, names, strict=True)}, values, F.min("__place"))

    def _mark_first(self, rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
        """Mark one row of each record in each group: the one with the smallest place. Only distinct counts inside the array need it."""
        named = rows.withColumns({f"__key{i}": c for i, c in enumerate(keys.values())})
        # one key column and the record: an aggregate with a struct of the least place, joined back on the null-safe keys
        columns = [f"__key{i}" for i in range(len(keys))]
        least = named.groupBy(*columns, ROW_ID).agg(F.min("__place").alias("__least")).select(*[F.col(c).alias(f"l{c}") for c in columns], F.col(ROW_ID).alias("l_id"), "__least")
        same = F.col(ROW_ID) == F.col("l_id")
        for c in columns:
            same &= F.col(c).eqNullSafe(F.col(f"l{c}"))
        return named.join(least, same).withColumn("__first_of_record", F.col("__place") == F.col("__least"))
