"""Near-duplicate documents by MinHash.

Many universal hash minima are cut into bands; texts that agree in a band are candidates; signatures
verify them; full shingle sets confirm every link; alternating large-star and small-star finds components.

How it stays linear in rows and bounded in memory:

* Equal shingle sets collapse into one class before anything is compared, so exact copies cost one row each.
* A band's bucket never becomes pairs: each member links to the bucket's smallest member only. Components of
  those links are *families*; two texts that agree in any band are always in the same family.
* A family is cut into blocks of bounded rows and bounded shingles, and each pair of blocks is one task,
  so a family of any size is compared whole without one task holding it. A task returns a spanning forest
  of its confirmed links, at most one row per member, never its pairs. Comparing costs the square of a
  family's *different* texts.

Recall: with the default 42 bands of 7 minima, a pair at similarity 0.85 shares no band with probability
1e-7, at 0.8 with 6e-5. Nothing below the threshold is ever linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, cut, free_name, spanning_forest
from .components import connected_components
from .shingles import band_keys, set_key, shingle_sets, signatures, universal_hashes

#: Bytes of text hashed at once.
CHUNK = 1 << 21
#: Most members, and most shingles, that one block of a family holds on average.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000


def _sketcher(width: int, bands: int, rows: int):
    def run(batches):
        a, b = universal_hashes(bands * rows)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            keys, counts, bandings = [], [], []
            for i, j in chunks_by_size(texts, CHUNK):
                sets = shingle_sets(texts[i:j], width)
                some = [s for s in sets if len(s)]
                found = iter(band_keys(signatures(some, a, b), bands) if some else ())
                for s in sets:
                    counts.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    bandings.append(next(found) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bandings, pa.list_(pa.int64()))],
                ["id", "n_shingles", "set_key", "bands"],
            )

    return run


def confirmed_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, hashes, slack: float = 0.14) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, of one block or of two.

    Signatures drop the pairs whose estimate lies `slack` (over five standard errors) under the threshold;
    intersections of full sets decide the rest. Numbers from len(left) on mean right's members.
    """
    sets = left + (right or [])
    sig = signatures(sets, *hashes).astype(np.uint16)
    n = len(left)
    first, second = sig[:n], sig[n:] if right is not None else sig
    agree = np.zeros((len(first), len(second)), np.uint16)
    for k in range(sig.shape[1]):
        agree += first[:, k, None] == second[None, :, k]
    near = agree >= (percent / 100 - slack) * sig.shape[1]
    if right is None:
        near &= np.tri(n, k=-1, dtype=bool).T
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return []
    shift = n if right is not None else 0
    used = np.union1d(rows, cols + shift)
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    values, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[where]
    where, owner = number[where[keep]], owner[keep]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    at_row, at_col = np.searchsorted(used, rows), np.searchsorted(used, cols + shift)
    common = np.zeros((len(rows), len(cols)), np.float32)
    width = max(256, (1 << 22) // max(1, len(used)))
    for begin in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(where, (begin, begin + width))
        part = np.zeros((len(used), width), np.float32)
        part[owner[lo:hi], where[lo:hi] - begin] = 1
        common += part[at_row] @ part[at_col].T
    inter = common.astype(np.int64)
    size = np.array([len(s) for s in sets])
    union = size[rows][:, None] + size[cols + shift][None, :] - inter
    linked = near[np.ix_(rows, cols)] & (100 * inter >= percent * union)
    if right is None:  # rows and columns must be the same items
        whole = np.zeros((n, n), bool)
        whole[np.ix_(rows, cols)] = linked
        return spanning_forest(whole, True)
    return [(int(rows[x]), int(cols[y]) + n) for x, y in spanning_forest(linked, False)]


def _cell_linker(width: int, percent: int, bands: int, rows: int):
    def run(key, table):
        hashes = universal_hashes(bands * rows)
        ids = table.column("id").to_pylist()
        block = np.array(table.column("block").to_pylist())
        texts = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        sets = []
        for i, j in chunks_by_size(texts, CHUNK):
            sets += shingle_sets(texts[i:j], width)
        full = [i for i in range(len(sets)) if len(sets[i])]
        lo, hi = key[1].as_py(), key[2].as_py()
        a = [i for i in full if block[i] == lo]
        b = [i for i in full if block[i] == hi] if hi != lo else None
        names = a + (b or [])
        found = confirmed_links([sets[i] for i in a], None if b is None else [sets[i] for i in b], percent, hashes) if a and (b is None or b) else []
        return pa.table(
            [pa.array([ids[names[x]] for x, _ in found], pa.int64()), pa.array([ids[names[y]] for _, y in found], pa.int64())], ["src", "dst"]
        )

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = 42, rows: int = 7
) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of docs.

    Words are runs without space and \\x09-\\x0D after A-Z became lower case; a text's set is its distinct
    `width`-word shingles, or its whole word sequence where it has fewer words. Rows are linked where
    100 * intersection >= percent * union of full sets.

    Null, empty and blank texts have no shingles and link with nothing. A null id is kept and links with
    nothing. Rows that repeat an id are one node: it has the links of all its texts. Other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(plain.mapInArrow(_sketcher(width, bands, rows), "id long, n_shingles long, set_key binary, bands array<bigint>"))
    usable = sketched.where("id is not null and set_key is not null")
    classes = usable.groupBy("set_key").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    copies = usable.select("id", "set_key").join(classes.select("set_key", "rep"), "set_key").where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))

    banded = classes.select("rep", F.explode("bands").alias("band"))
    lowest = banded.groupBy("band").agg(F.min("rep").alias("low"))
    candidates = banded.join(lowest, "band").where("rep <> low").select("rep", "low").distinct()
    families = cut(connected_components(candidates, "rep", "low").select(F.col("node").alias("id"), F.col("component").alias("family")))

    sized = families.join(usable.groupBy("id").agg(F.max("n_shingles").alias("n")), "id")
    blocks = sized.groupBy("family").agg(
        # never more blocks than members
        F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES))).cast("int").alias("n_blocks")
    )
    members = families.join(blocks, "family").select("id", "family", "n_blocks", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int").alias("block"))
    cells = (
        plain.where("id is not null and text is not null")
        .join(members, "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "block", "text")
    )
    links = cells.groupBy("family", "lo", "hi").applyInArrow(_cell_linker(width, percent, bands, rows), "src long, dst long")

    component = connected_components(copies.union(links))
    return (
        sketched.select("id", "n_shingles")
        .join(component.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, without those whose group has a smaller id.

    Rows that repeat a kept id are compared too: of equal texts and of near copies within an id one stays, other
    texts all stay, and a row without text only where its id has none with text. Null ids all stay. An id whose
    group has a smaller one goes with all its rows, as rows of one id are one node of the groups.
    """
    key, text, number = free_name(docs, "kept_id"), free_name(docs, "kept_text"), free_name(docs, "kept_number")
    kept = near_duplicates(docs, id_col, text_col, **how).where("kept").select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).distinct()
    stay = docs.join(kept, docs[id_col].cast("long") == F.col(key), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    said = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    once = stay.groupBy(F.col(id_col).cast("long").alias(key)).agg(F.min_by(row, F.struct(said == "", said)).alias("row"))
    nulls = docs.where(F.col(id_col).isNull())

    digest = F.xxhash64(said)
    several = cut(
        docs.where(F.col(id_col).isNotNull() & (said != ""))
        .groupBy(F.col(id_col).cast("long").alias(key))
        .agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
        .where("low <> high")
        .select(key)
    )
    if several.isEmpty():
        return once.select("row.*").unionByName(nulls)
    texts = cut(
        stay.where(said != "")
        .select(F.col(id_col).cast("long").alias(key), said.alias(text), row.alias("row"))
        .join(several, key, "left_semi")
        .groupBy(key, text)
        .agg(F.min_by("row", F.to_json("row")).alias("row"))
        .withColumn(number, F.xxhash64(key, text))
    )
    # kept ids are near copies of no other kept id, so these groups stay within an id
    other = near_duplicates(texts, number, text, **how).where("kept").select(number)
    rows = texts.join(other, number, "left_semi").select("row.*")
    return once.join(several, key, "left_anti").select("row.*").unionByName(rows).unionByName(nulls)
