"""Near-duplicate embeddings by an exact metric range join.

Cosine at least t between unit vectors is Euclidean distance at most r = sqrt(2 - 2t). Pivots, drawn by
hash from each label's vectors, split a label into cells: a vector's home is its nearest pivot. By the
triangle inequality a vector can only have neighbours in a cell j if its distance to pivot j is at most its
distance to its own pivot + 2r, and at most the cell's radius + r; it is copied to just those of these cells that come
before its own, so that each pair meets once, in the earlier of its two cells. Cells join independently.

How many pivots a label has, up to the square root of its vectors, is chosen on the drawn vectors by what they save:
comparisons, against copies. Any number gives the same links.

Equal vectors collapse first, by 128 bits of hash. A cell is cut into blocks of bounded rows, and each pair of blocks
with a home block is one task, so a label or cell that holds a third of all rows is spread, and no task holds more than
two blocks. A task returns, for each vector, the number of its links there and a link of a spanning forest: never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spanning_forest
from .components import connected_components

#: Least vectors of a cell on average, and rows of a block.
CELL_ROWS, BLOCK_ROWS = 512, 4096
#: Bytes of pivots that are sent to every task, and the most labels that get any: the largest. A label without pivots is
#: one cell, joined in blocks as well.
MAX_PIVOT_BYTES, MAX_LABELS = 32 << 20, 2048
#: Most rows of a table of cells that is sent to every task; a larger one is joined by a shuffle.
MAX_CELLS = 50_000
#: What copying a vector costs, in comparisons of two vectors.
COPY_COST = 300
_EPS = 1e-7


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _vectors(column) -> np.ndarray:
    """The rows of a column of lists of one length as doubles."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _by_label(batch, pivots: dict):
    """(places of the rows of a label that has pivots, their distances to these), for each such label of a batch, a part at a time."""
    groups = batch.column(1).to_numpy(zero_copy_only=False)
    for g in np.unique(groups).tolist():
        if g in pivots:
            at = np.flatnonzero(groups == g)
            for part in np.array_split(at, -(-len(at) * len(pivots[g]) // (1 << 22)) or 1):
                yield g, part, _distances(_unit(_vectors(batch.column(2).take(pa.array(part)))), pivots[g])


def _homes(shared):
    """Adds each vector's home cell and its distance to the pivot."""

    def run(batches):
        for batch in batches:
            cell, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for _, at, d in _by_label(batch, shared.value):
                cell[at] = d.argmin(1)
                dist[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], [*batch.schema.names, "cell", "dist"])

    return run


def _reach(d: np.ndarray, home: np.ndarray, dist: np.ndarray, radii: np.ndarray, radius: float) -> np.ndarray:
    """True for the cells before its own in which a vector can have neighbours, given distances to all pivots."""
    near = (d <= dist[:, None] + 2 * radius + _EPS) & (d <= radii[None, :] + radius + _EPS)
    return near & (np.arange(d.shape[1])[None, :] < home[:, None])


def _guests(shared, shared_radii, radius):
    """Adds the other cells to which each vector is copied."""

    def run(batches):
        for batch in batches:
            home, dist = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            n, where, cells = np.zeros(batch.num_rows, np.int64), [], []
            for g, at, d in _by_label(batch, shared.value):
                i, j = np.nonzero(_reach(d, home[at], dist[at], shared_radii.value[g], radius))
                n[at] = np.bincount(i, minlength=len(at))
                where.append(at[i])
                cells.append(j)
            order = np.argsort(np.concatenate(where), kind="stable") if where else []
            flat = np.concatenate(cells)[order].astype(np.int32) if where else np.zeros(0, np.int32)
            guest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], guest], [*batch.schema.names[:5], "guest"])

    return run


def links_of(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """True where the cosine in double precision reaches the threshold."""
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    linked = np.empty((len(x), len(y)), bool)
    for i in range(0, len(x), 512):
        linked[i : i + 512] = (x[i : i + 512] @ y.T) / (nx[i : i + 512, None] * ny[None, :]) >= threshold
    return linked


def _sums(linked: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row the weights of its true cells, added up a part at a time."""
    parts = [linked[i : i + 512].astype(np.int64) @ weight for i in range(0, len(linked), 512)]
    return np.concatenate(parts)


def _block_joiner(threshold: float):
    def run(key, table):
        first, within = key[3].as_py(), key[2].as_py() == "home" and key[3].as_py() == key[4].as_py()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        mine = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        if key[2].as_py() == "home":
            mine = table.column("block").to_numpy() == first
        v = _vectors(table.column("v"))
        a = np.flatnonzero(mine)
        b = a if within else np.flatnonzero(~mine)
        out_id, out_n, src, dst = [], [], [], []
        if len(a) and len(b):
            linked = links_of(v[a], v[b], threshold)
            linked &= ids[a][:, None] != ids[b][None, :]
            # a pair meets in one task only, and counts for both its vectors
            for x, n in [(a, _sums(linked, copies[b]))] if within else [(a, _sums(linked, copies[b])), (b, _sums(linked.T, copies[a]))]:
                out_id += ids[x][n > 0].tolist()
                out_n += n[n > 0].tolist()
            for i, j in spanning_forest(linked, within):
                src.append(int(ids[a[i]]))
                dst.append(int(ids[b[j]]))
        return pa.table(
            [pa.array(out_id + src, pa.int64()), pa.array([None] * len(out_id) + dst, pa.int64()), pa.array([int(n) for n in out_n] + [0] * len(src), pa.int64())],
            ["id", "other", "n"],
        )

    return run


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` places: each next one is the vector farthest from all before it."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.array(chosen)


def _cells_worth(x: np.ndarray, order: np.ndarray, n: int, radius: float) -> int:
    """Of how many pivots, the first so many of `order`, joining n vectors like x costs least."""
    best, choice = None, 1
    all_d, k = _distances(x, x[order]), 1
    while k <= len(order):
        d = all_d[:, :k]
        home, dist = d.argmin(1), d.min(1)
        radii = np.full(k, -np.inf)
        np.maximum.at(radii, home, dist)
        reach = _reach(d, home, dist, radii, radius)
        held, guests = np.bincount(home, minlength=k) / len(x), reach.sum(0) / len(x)
        compared = n * (held * (held / 2 + guests)).sum()
        # home blocks go to each other and to every block of guests
        blocks = np.ceil(n * held / BLOCK_ROWS)
        copied = (held * (blocks + np.ceil(n * guests / BLOCK_ROWS)) + guests * blocks).sum()
        cost = compared + COPY_COST * copied + 2 * k
        if best is None or cost < best:
            best, choice = cost, k
        k *= 2
    return choice


def _pivots(vectors: DataFrame, sizes: dict[int, int], cell_rows: int, radius: float, width: int) -> dict[int, np.ndarray]:
    """For each label the pivots that are worth their cost, of vectors drawn by the hash of the id."""
    budget = MAX_PIVOT_BYTES // (8 * max(1, width) * max(1, len(sizes)))  # each label's share
    most = {g: max(1, min(int(n**0.5), n // cell_rows, budget)) for g, n in sizes.items()}
    rates = vectors.sparkSession.createDataFrame([(g, min(1.0, (4 * k + 40) / sizes[g])) for g, k in most.items()], "label long, rate double")
    drawn = (
        vectors.join(F.broadcast(rates), "label")  # MAX_LABELS rows at most
        .where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
        .select("label", "id", "v")
        .toArrow()  # about four times as many vectors as pivots can be
    )
    labels, ids = drawn.column("label").to_numpy(), drawn.column("id").to_numpy()
    out = {}
    for g, k in most.items():
        at = np.flatnonzero(labels == g)
        if len(at) and k > 1:
            x = _unit(_vectors(drawn.column("v").take(pa.array(at[np.argsort(ids[at])]))))
            order = _spread(x, k)
            out[g] = x[order[: _cells_worth(x, order, sizes[g], radius)]]
    return {g: x for g, x in out.items() if len(x) > 1}


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row of vectors.

    Rows are linked where their labels are equal and not null and the cosine, in double precision, reaches
    the threshold. Finite vectors of any size count: those whose squares would be too large or small are scaled.
    Null and zero vectors, those with a null or non-finite component, and rows with a null id or label link with nothing. Ids are taken to be unique; a repeated row is one node, and links of a
    repeated id are those of all its vectors. Vectors of different lengths in a label never link.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("of"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")
    )
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    finite = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (largest > 0) & (largest < float("inf"))
    usable = plain.where("id is not null and of is not null").where(F.coalesce(finite, F.lit(False)))
    if not single:  # squares of single floats are doubles; those of doubles may be too large or small to be
        far = (largest > 1e150) | (largest < 1e-150)
        usable = usable.withColumn("v", F.when(far, F.transform("v", lambda x: x / largest)).otherwise(F.col("v")))
    usable = usable.select("id", F.xxhash64("of", F.size("v")).alias("label"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    # equal vectors are one: its smallest id stands for all, and links to a copy count as often as it has copies
    keys = ["label", "h1", "h2"]
    nodes = usable.select("id", *keys).distinct()
    same = nodes.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    stood = cut(nodes.join(same, keys).select("id", "rep", "copies"))
    # the vectors themselves are shuffled once here, by the keys that `same` is shuffled by too
    distinct = cut(usable.groupBy(*keys).agg(F.any_value("v").alias("v")).join(same, keys).select(F.col("rep").alias("id"), "label", "v", "copies"))

    radius = float(np.sqrt(2 - 2 * threshold))
    large = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).where(F.col("n") > cell_rows)
    top = large.orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()
    sizes = {r.label: r.n for r in top}
    pivots = _pivots(distinct, sizes, cell_rows, radius, max(r.width for r in top)) if sizes else {}
    shared = spark.sparkContext.broadcast(pivots)
    of_v = "array<float>" if single else "array<double>"
    homed = cut(distinct.mapInArrow(_homes(shared), f"id long, label long, v {of_v}, copies long, cell int, dist double")) if pivots else distinct.selectExpr("*", "0 cell", "0D dist")
    radii = {g: np.full(len(p), -np.inf) for g, p in pivots.items()}
    if pivots:
        known = spark.createDataFrame([(g,) for g in pivots], "label long")
        for r in homed.join(F.broadcast(known), "label", "left_semi").groupBy("label", "cell").agg(F.max("dist").alias("r")).collect():  # a row for each pivot
            radii[r.label][r.cell] = r.r
    placed = homed.mapInArrow(
        _guests(shared, spark.sparkContext.broadcast(radii), radius), f"id long, label long, v {of_v}, copies long, cell int, guest array<int>"
    )
    # what lies in each cell, counted without the vectors
    held = placed.select("label", F.explode(F.concat(F.array(F.struct("cell", F.lit(1).alias("h"))), F.transform("guest", lambda c: F.struct(c.alias("cell"), F.lit(0).alias("h"))))).alias("x"))
    counts = cut(
        held.groupBy("label", F.col("x.cell").alias("cell")).agg(
            F.ceil(F.sum("x.h") / block_rows).cast("int").alias("homes"), F.ceil(F.sum(1 - F.col("x.h")) / block_rows).cast("int").alias("guests")
        )
    )
    counts = F.broadcast(counts) if counts.count() <= MAX_CELLS else counts

    def upto(n):
        """0 to n - 1; nothing for 0."""
        return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)

    def cell(kind, first, second):
        return F.struct(F.lit(kind).alias("kind"), first.alias("lo"), second.alias("hi"))

    lies = placed.select("id", "label", "v", "copies", F.explode(F.concat(F.array(F.struct("cell", F.lit(True).alias("home"))), F.transform("guest", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))).alias("x"))
    numbered = lies.select("id", "label", "v", "copies", "x.cell", "x.home").join(counts, ["label", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    )
    b = F.col("block")
    at_home = F.concat(F.transform(upto(F.col("homes")), lambda o: cell("home", F.least(b, o), F.greatest(b, o))), F.transform(upto(F.col("guests")), lambda o: cell("guest", b, o)))
    blocked = numbered.withColumn("x", F.explode(F.when(F.col("home"), at_home).otherwise(F.transform(upto(F.col("homes")), lambda o: cell("guest", o, b))))).select(
        "label", "cell", "x.kind", "x.lo", "x.hi", "id", "v", "home", "copies", "block"
    )
    found = cut(blocked.groupBy("label", "cell", "kind", "lo", "hi").applyInArrow(_block_joiner(threshold), "id long, other long, n long"))

    degree = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    own = stood.join(degree, "rep", "left").select("id", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    edges = found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")).union(stood.where("id <> rep").select("id", "rep"))
    component = connected_components(edges)
    per_id = own.groupBy("id").agg(F.sum("n").cast("long").alias("n"))
    return (
        plain.select("id")
        .join(per_id, "id", "left")
        .join(component.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
