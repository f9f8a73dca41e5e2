"""Shared plumbing: reading tables, cutting lineage, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir. Only a session in one process may do without: it gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="nestql-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """Rows written as a Parquet table under the shared checkpoint folder, and read again as `df`.

    The table is deleted by `drop`, else when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}.parquet"
        df.write.parquet(path)
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._files.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._files.delete(self._path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table that lasts as long as the driver."""
    return Stored(df, name).df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with any of df's, compared as Spark does without case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def crc_mod(col: str, n: int):
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def held_out(col: str = "doc_id", n: int = 5):
    """True where crc32(id as text) mod n is 0; a null id counts as held out, so nothing is learnt from it."""
    return F.coalesce(crc_mod(col, n) == 0, F.lit(True))


# Vectorised word hashing over UTF-8 bytes ---------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3
MASK64 = (1 << 64) - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base modulo 2**64 and of its inverse."""
    inv = pow(_PRIME, -1, 1 << 64)
    up, down = np.full(n + 1, _PRIME, np.uint64), np.full(n + 1, inv, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: True for the bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordHashes:
    """Words of many texts at once: 64-bit hashes in order, and where each text's words begin and end.

    Texts are joined by a line feed, words are runs of bytes outside `sep`. `byte_start`/`byte_end` are
    offsets into `data`; `first[d]`..`first[d+1]` are the words of text d.
    """

    def __init__(self, texts: list[bytes], sep: np.ndarray = SPACE, lower: bool = True):
        joined = b"\n".join(texts)
        if lower:
            joined = joined.translate(LOWER)
        self.data = data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        text_start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        inside = np.concatenate(([False], ~sep[data], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.byte_start, self.byte_end = edge[0::2], edge[1::2]
        self.text_start, self.text_end = text_start, text_start + lengths
        self.first = np.concatenate((np.searchsorted(self.byte_start, text_start), [len(self.byte_start)]))
        if len(self.byte_start):
            up, down = powers(len(data))
            prefix = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
            raw = (prefix[self.byte_end] - prefix[self.byte_start]) * down[self.byte_start]
            self.hash = mix(raw + _ODD * (self.byte_end - self.byte_start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def chunks_by_size(texts: list, limit: int):
    """Index ranges of consecutive texts of at most `limit` bytes together; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def spanning_forest(linked: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """(row, column) of enough true cells to connect what all true cells connect.

    Rows and columns are the same items if `within`, else column j is item len(linked) + j.
    """
    n, m = linked.shape
    shift = 0 if within else n
    tree = np.arange(n if within else n + m)
    found = []
    for i in np.flatnonzero(linked.any(1)).tolist():
        partners = np.flatnonzero(linked[i])
        trees, at = np.unique(tree[partners + shift], return_index=True)
        for t, j in zip(trees.tolist(), partners[at].tolist(), strict=True):
            if t != tree[i]:
                tree[tree == t] = tree[i]
                found.append((i, j))
    return found
