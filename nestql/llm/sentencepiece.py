"""SentencePiece encoding and decoding over a relational lattice.

Text is a sequence of chunks, each a run of the meta symbol and what follows up to the next, or a white space
character that is in no piece; where no piece spans two chunks (checked when a model is read) each chunk is encoded by itself. The lattice of frequent
chunks is relational: their substrings of bounded length are exploded, joined to the piece table, grouped
by chunk and folded with Spark's `aggregate`. The fold depends on the model's kind:

* unigram: Viterbi, the path of greatest score;
* BPE: the best-scored piece that joins two neighbours, leftmost first, until there is none. Viterbi cannot
  give a BPE model's ids, as its scores are merge ranks and not log probabilities.

Frequent chunks (at most `max_frequent`) go to every task; any other chunk is folded in the task that meets
it by the same rules, so the bound changes where a chunk is encoded and never its ids.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

META = "▁"
#: Chunks of more characters than this have no bit mask of their boundaries and are folded in the tasks.
MASK_CHARS = 60
MAX_FREQUENT = 100_000
#: Different chunks that a task counts before it passes them on, and most pieces that are sent to every task for the join.
MAX_COUNTED, MAX_JOINED = 100_000, 500_000


class Pieces(NamedTuple):
    """A model: score and id of each piece that text can become, and the ids of bytes and of the unknown piece."""

    kind: str
    piece: dict[str, tuple[float, int]]
    byte: list[int] | None
    unknown: int
    text: list[str | int | None]  # of each id: its text, its byte value, or None where it stands for no text
    longest: int
    worst: float
    lone: str = ""  # white space that is in no piece, so that no piece reaches across it

    @staticmethod
    def read(path: str | None) -> Pieces:
        """From a .model file; the file must be readable on the driver only."""
        import sentencepiece

        if not path:
            raise ValueError("no SentencePiece model: name its file in NESTQL_PIECE_MODEL")

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        piece, text, at_byte = {}, [], {}
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                at_byte[int(p[1:-1], 16)] = i
                text.append(int(p[1:-1], 16))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                text.append(None)
            else:
                piece[p] = (m.get_score(i), i)
                text.append(p)
        if any(META in p.lstrip(META) for p in piece):
            raise ValueError("a piece spans chunks")
        # a BPE model's pieces are numbered in the order of their merges, as their scores are
        scored = [s for s, _ in piece.values() if s > -1e8]
        bpe = all(float(s).is_integer() for s in scored)
        byte = [at_byte[b] for b in range(256)] if len(at_byte) == 256 else None
        return Pieces("bpe" if bpe else "unigram", piece, byte, m.unk_id(), text, max(map(len, piece)), min(scored), "".join(c for c in "\n\r\t" if not any(c in p for p in piece)))


def _leaf_ids(model: Pieces, piece: str) -> list[int]:
    if piece in model.piece:
        return [model.piece[piece][1]]
    return [model.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if model.byte else [model.unknown]


def fold_bpe(chunk: str, model: Pieces) -> list[int]:
    """Join the neighbours whose piece has the best score, leftmost first, until no two make a piece."""
    parts = list(chunk)
    get = model.piece.get
    if len(parts) > 400:
        return _fold_long_bpe(parts, model)
    scores = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, s in enumerate(scores):
            if s is not None and (best is None or s[0] > best):
                best, at = s[0], i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = get(parts[at] + parts[at + 1])
        if at:
            scores[at - 1] = get(parts[at - 1] + parts[at])
    return [i for p in parts for i in _leaf_ids(model, p)]


def _fold_long_bpe(parts: list[str], model: Pieces) -> list[int]:
    """The same with a heap and links, in n log n, for chunks of any length."""
    import heapq

    n, get = len(parts), model.piece.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (s := get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s[0], i, j, len(parts[i]) + len(parts[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not parts[i] or after[i] != j or not parts[j] or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for p in parts if p for x in _leaf_ids(model, p)]


def fold_unigram(chunk: str, model: Pieces) -> list[int]:
    """Viterbi: the pieces of greatest total score; a character without a piece costs 10 more than the worst."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(chunk) + 1):
        options = []
        for begin in range(max(0, end - model.longest), end):
            s = model.piece.get(chunk[begin:end])
            if s is not None:
                options.append((best[begin][0] + s[0], -begin))
            elif end - begin == 1:
                options.append((best[begin][0] + model.worst - 10, -begin))
        score, begin = max(options)
        best.append((score, -begin))
    out, end = [], len(chunk)
    while end:
        begin = best[end][1]
        out.append(chunk[begin:end])
        end = begin
    return [i for p in reversed(out) for i in _leaf_ids(model, p)]


def fold(chunk: str, model: Pieces) -> list[int]:
    return fold_bpe(chunk, model) if model.kind == "bpe" else fold_unigram(chunk, model)


def _chunk_pattern(lone: str) -> re.Pattern:
    return re.compile(f"[{lone}]|{META}*[^{META}{lone}]+|{META}+" if lone else f"{META}*[^{META}]+|{META}+")


def chunks(text: str, lone: str = "") -> list[str]:
    """Runs of the meta symbol with what follows each, and every lone character; blanks are meta symbols, and one stands before the text."""
    return _chunk_pattern(lone).findall(META + text.replace(" ", META)) if text else []


def _plain(text: str) -> bool:
    """Whether what stands between blanks can be encoded by itself: there are no two blanks together, nor meta symbols."""
    return "  " not in text and META not in text and text[:1] != " " and text[-1:] != " "


def _slices(texts: pa.Array, limit: int = 1 << 20):
    """Ranges of consecutive texts of about `limit` bytes together."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n + 64
    if len(sizes):
        yield begin, len(sizes)


# The relational lattice ------------------------------------------------------------------------------------


def _let(value, body):
    """body(value) with value computed once: the optimizer computes an expression wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _between(word, cuts):
    """The parts of word between neighbouring cuts."""
    return F.transform(
        F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.substring(word, F.get(cuts, k - 1) + 1, F.get(cuts, k) - F.get(cuts, k - 1))
    )


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """Rows (word, edges): every substring of at most `longest` characters that is a piece, as (start, len, score, id)."""
    n = F.length("word")
    spans = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("at")).select(
        "word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1))).alias("len")
    )
    joined = spans.withColumn("piece", F.expr("substring(word, at, len)")).join(pieces, "piece")
    edge = F.struct((F.col("at") - 1).alias("start"), "len", "score", "id")
    found = joined.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return words.join(found, "word", "left").select("word", F.coalesce("edges", F.array().cast("array<struct<start:int,len:int,score:double,id:int>>")).alias("edges"))


def folded_bpe(graph: DataFrame) -> DataFrame:
    """Rows (word, pieces): starts and lengths of the final pieces. Boundaries are bits of a long.

    An edge joins two neighbours when its ends are boundaries and exactly one boundary lies inside.
    """

    def bit(x):
        return F.call_function("shiftleft", F.lit(1).cast("long"), x)

    def step(bounds, _):
        def joins(e):
            inside = bit(e["start"] + e["len"]) - bit(e["start"] + 1)
            ends = bit(e["start"]).bitwiseOR(bit(e["start"] + e["len"]))
            return (bounds.bitwiseAND(ends) == ends) & (F.bit_count(bounds.bitwiseAND(inside)) == 1)

        able = F.filter("edges", lambda e: (e["len"] > 1) & joins(e))
        best = F.array_min(F.transform(able, lambda e: F.struct((-e["score"]).alias("cost"), e["start"].alias("start"), e["len"].alias("len"))))
        joined = _let(best, lambda e: bounds.bitwiseAND(F.bitwise_not(bit(e["start"] + e["len"]) - bit(e["start"] + 1))))
        return F.coalesce(joined, bounds)

    n = F.length("word")
    every = bit(n + 1) - F.lit(1).cast("long")
    rounds = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    final = F.aggregate(rounds, every, step)
    cuts = _let(final, lambda bounds: F.filter(F.sequence(F.lit(0), n), lambda i: bounds.bitwiseAND(bit(i)) != 0))
    return graph.select("word", _let(cuts, lambda c: _between(F.col("word"), c)).alias("pieces"))


def folded_unigram(graph: DataFrame, worst: float) -> DataFrame:
    """Rows (word, pieces) of the greatest total score: state k of the fold is the best way to the first k characters."""
    n = F.length("word")
    kind = "array<struct<score:double,start:int>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"))).cast(kind)

    def step(best, end):
        ways = F.transform(
            F.filter("edges", lambda e: e["start"] + e["len"] == end),
            lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("start")),
        )
        single = F.exists("edges", lambda e: (e["start"] == end - 1) & (e["len"] == 1))
        rough = F.struct((F.get(best, end - 1)["score"] + F.lit(worst - 10.0)).alias("score"), (F.lit(1) - end).alias("start"))
        top = F.array_max(F.when(single, ways).otherwise(F.concat(ways, F.array(rough))))
        new = _let(top, lambda t: F.struct(t["score"].alias("score"), (-t["start"]).alias("start")))
        return F.concat(best, F.array(new)).cast(kind)

    def walk(best):
        def back(cuts, _):
            first = F.get(cuts, F.lit(0))
            return F.when(first > 0, F.concat(F.array(F.get(best, first)["start"]), cuts)).otherwise(cuts)

        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)

    best = F.aggregate(F.sequence(F.lit(1), n), first, step)
    return graph.select("word", _let(_let(best, walk), lambda c: _between(F.col("word"), c)).alias("pieces"))


def relational_encode(words: DataFrame, model: Pieces) -> DataFrame:
    """Rows (word, pieces) for distinct words of 1 to MASK_CHARS characters."""
    spark = words.sparkSession
    rows = pa.table(
        {
            "piece": pa.array(list(model.piece)),
            "score": pa.array([s for s, _ in model.piece.values()], pa.float64()),
            "id": pa.array([i for _, i in model.piece.values()], pa.int32()),
        }
    )
    table = spark.createDataFrame(rows)
    graph = lattice(words, F.broadcast(table) if len(model.piece) <= MAX_JOINED else table, model.longest)
    return folded_bpe(graph) if model.kind == "bpe" else folded_unigram(graph, model.worst)


def _counter(lone: str):
    def run(batches):
        words: Counter[str] = Counter()  # what stands between single blanks: split once for each different one
        others: Counter[str] = Counter()

        def flush():
            for word, n in words.items():
                for c in chunks(word, lone):
                    others[c] += n
            words.clear()
            rows = [(c, n) for c, n in others.items() if len(c) <= MASK_CHARS]
            others.clear()
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    if _plain(text):
                        words.update(text.split(" "))
                    else:
                        others.update(chunks(text, lone))
                if len(words) + len(others) >= MAX_COUNTED:
                    yield flush()
        yield flush()

    return run


def frequent_chunks(docs: DataFrame, text_col: str, max_frequent: int, lone: str = "") -> DataFrame:
    """The most frequent chunks of all texts that the lattice can hold, max_frequent at most.

    Chunks are counted over every row, in each task first. A histogram of eighths of powers of two gives the least
    count for which there are few enough, so no task sorts or gathers the candidates.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    words = texts.mapInArrow(_counter(lone), "word string, n long")
    counted = cut(words.groupBy("word").agg(F.sum("n").alias("count")).where("count > 1").withColumn("step", F.floor(F.log2("count") * 8)))
    least, total = None, 0
    for step, n in sorted(counted.groupBy("step").agg(F.count("*")).collect(), reverse=True):  # at most 8 * 63 rows
        total += n
        if total > max_frequent:
            break
        least = step
    return counted.where(F.col("step") >= least if least is not None else F.lit(False)).select("word")


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def codebook(docs: DataFrame, model: Pieces, text_col: str = "text", max_frequent: int = MAX_FREQUENT) -> dict[str, bytes]:
    """Ids of the frequent chunks, from the lattice, as 32-bit integers; at most max_frequent entries."""
    found = relational_encode(frequent_chunks(docs, text_col, max_frequent, model.lone), model).toArrow()
    return {
        w: _packed([i for p in pieces for i in _leaf_ids(model, p)])
        for w, pieces in zip(*(found.column(c).to_pylist() for c in ("word", "pieces")), strict=True)
    }


class PairTable:
    """The same fold as fold_bpe of many chunks at once: in each round every chunk joins its best pair, leftmost first.

    Symbols are the pieces and the characters in them; the table says which piece, by the rank of its score, two of them make.
    """

    NONE = np.int32(2**31 - 1)

    @staticmethod
    def arrays(model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a table is made of: the symbols' ids, the characters' symbols, and rows (left, right, rank, made); small, to be sent to tasks."""
        texts = list(model.piece)
        number = {t: i for i, t in enumerate(texts)}
        for c in sorted({c for t in texts for c in t}):
            number.setdefault(c, len(number))
        ids = np.full(len(number), -1, np.int32)
        ids[: len(texts)] = [i for _, i in model.piece.values()]
        single = {ord(t): i for t, i in number.items() if len(t) == 1}
        symbol = np.full(max(single, default=0) + 2, -1, np.int32)  # the last one stands for all further characters
        symbol[list(single)] = list(single.values())
        ranks = {x: i for i, x in enumerate(sorted({x for x, _ in model.piece.values()}, reverse=True))}
        pairs = [
            (number[t[:k]], number[t[k:]], ranks[x], number[t]) for t, (x, _) in model.piece.items() for k in range(1, len(t)) if t[:k] in number and t[k:] in number
        ]
        return ids, symbol, np.array(pairs, np.int32).reshape(-1, 4)

    def __init__(self, ids: np.ndarray, symbol: np.ndarray, pairs: np.ndarray):
        self.ids, self.symbol = ids, symbol
        rank, made = pairs[:, 2], pairs[:, 3]
        self.width = np.int64(len(ids))
        self.mask = np.int64((1 << max(4, int(2 * len(pairs)).bit_length())) - 1)
        # one more slot than keys have, for no pair
        self.keys, self.rank, self.made = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 2, self.NONE, np.int32), np.zeros(self.mask + 2, np.int32)
        key = pairs[:, 0].astype(np.int64) * self.width + pairs[:, 1]
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            where, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[where], self.rank[where], self.made[where] = key[taken], rank[taken], made[taken]
            rest = np.ones(len(key), bool)
            rest[taken] = False
            key, rank, made, at = key[rest], rank[rest], made[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each two symbols; the last one where they make no piece."""
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        held = self.keys[at]
        open_ = np.flatnonzero((held != key) & (held >= 0))
        at[held < 0] = self.mask + 1
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            at[open_[held < 0]] = self.mask + 1
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return at

    def fold(self, words: list[str], prefix: str = "") -> list[bytes | None]:
        """Packed ids of each word behind the prefix; None where a character is in no piece or the word is too long, for fold() to do."""
        out: list[bytes | None] = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            if 0 < n + len(prefix) <= MASK_CHARS:
                rows = np.flatnonzero(lengths == n)
                for begin in range(0, len(rows), 1 << 15):
                    self._fold(words, rows[begin : begin + (1 << 15)], n, prefix, out)
        return out

    def _fold(self, words, rows, n, prefix, out):
        codes = np.frombuffer("".join([prefix + words[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        n += len(prefix)
        now = self.symbol[np.minimum(codes, len(self.symbol) - 1)].reshape(-1, n)
        plain = (now >= 0).all(1)
        now, rows = now[plain], rows[plain]
        cost = self.rank[self.pairs(now[:, :-1].ravel(), now[:, 1:].ravel())].reshape(len(rows), n - 1)

        def emit(rows, symbols):
            ids = self.ids[symbols]
            whole, raw, step = (ids >= 0).all(1).tolist(), ids.tobytes(), 4 * symbols.shape[1]
            for i, (row, ok) in enumerate(zip(rows.tolist(), whole, strict=True)):
                if ok:
                    out[row] = raw[i * step : (i + 1) * step]

        while len(rows):
            if n == 1:
                emit(rows, now)
                return
            at = cost.argmin(1)
            own = np.arange(len(rows))
            more = cost[own, at] != self.NONE
            if not more.all():
                emit(rows[~more], now[~more])
                rows, now, cost, at = rows[more], now[more], cost[more], at[more]
                own = own[: len(rows)]
            made = self.made[self.pairs(now[own, at], now[own, at + 1])]
            column = np.arange(n - 1)
            now = np.take_along_axis(now, column + (column > at[:, None]), 1)
            now[own, at] = made
            n -= 1
            column = np.arange(n - 1)
            cost = np.take_along_axis(cost, column + (column >= at[:, None]), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 1)
            cost[left, at[left] - 1] = self.rank[self.pairs(now[left, at[left] - 1], now[left, at[left]])]
            cost[right, at[right]] = self.rank[self.pairs(now[right, at[right]], now[right, at[right] + 1])]


class Encoder:
    """Encodes texts, and finds out once for each different word what its ids are and whether they decode to it.

    Words are what stands between single blanks; texts with more than that between them are taken by their chunks. A text
    is the join of its words' or chunks' ids. `lost` are those whose ids do not decode to them.
    """

    def __init__(self, model: Pieces, known: dict[str, bytes], limit: int = 200_000, table: PairTable | None = None):
        self.model, self.known, self.limit = model, known, limit
        self.bytes_of = _byte_table(model)
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)
        self.table = table
        self.special = re.compile(f"[{META}{model.lone}]").search
        self.known_words = {c[1:]: ids for c, ids in known.items() if c[0] == META and len(c) > 1 and not self.special(c[1:])}
        self.known_lost = self._not_decoded(list(known), list(known.values()))
        self.known_lost |= {c[1:] for c in self.known_lost if c[1:] in self.known_words}
        self._forget()

    def _forget(self) -> None:
        self.words = {**self.known_words, "": b""}  # by what stands between blanks
        self.chunks = dict(self.known)  # by chunk, of texts and words that have several
        self.lost = set(self.known_lost)

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("i")))

    def _not_decoded(self, words: list[str], ids: list[bytes], prefix: str = "") -> set[str]:
        """The words, behind the prefix, that their ids do not give back."""
        whole = [(prefix + w).replace(META, " ").encode("utf-8", "surrogatepass") for w in words]
        joined = b"".join(ids)
        sizes = np.concatenate(([0], np.cumsum(self.sizes[np.frombuffer(joined, np.int32)])))
        ends = np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)
        # bytes that are the same in all are the same in each where each is as long
        if self.decoded(joined) == b"".join(whole) and np.array_equal(sizes[ends], np.cumsum([len(x) for x in whole])):
            return set()
        return {w for w, i, x in zip(words, ids, whole, strict=True) if self.decoded(i) != x}

    def _fold(self, words: list[str], prefix: str = "") -> list[bytes]:
        """Packed ids of each word behind the prefix, folded together where that can be."""
        folded = self.table.fold(words, prefix) if self.table else [None] * len(words)
        return [_packed(fold(prefix + w, self.model)) if ids is None else ids for w, ids in zip(words, folded, strict=True)]

    def _learn_chunks(self, found: set[str]) -> None:
        new = [c for c in found if c not in self.chunks]
        ids = self._fold(new)
        self.chunks.update(zip(new, ids, strict=True))
        self.lost |= self._not_decoded(new, ids)

    def _learn_words(self, found: set[str]) -> None:
        new = [w for w in found if w not in self.words]
        several = {w: chunks(w, self.model.lone) for w in new if self.special(w)}
        if several:
            self._learn_chunks({c for parts in several.values() for c in parts})
            new = [w for w in new if w not in several]
            for w, parts in several.items():
                self.words[w] = b"".join([self.chunks[c] for c in parts])
                if not self.lost.isdisjoint(parts):
                    self.lost.add(w)
        ids = self._fold(new, META)
        self.words.update(zip(new, ids, strict=True))
        self.lost |= self._not_decoded(new, ids, META)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of each text, and whether they decode to it."""
        if len(self.words) + len(self.chunks) > self.limit + 2 * len(self.known):  # between calls, so that `lost` holds all of a text's
            self._forget()
        plain = [_plain(t) for t in texts]
        parts = [t.split(" ") if p else chunks(t, self.model.lone) for t, p in zip(texts, plain, strict=True)]
        self._learn_words(set().union(*[x for x, p in zip(parts, plain, strict=True) if p]))
        self._learn_chunks(set().union(*[x for x, p in zip(parts, plain, strict=True) if not p]))
        of_words, of_chunks = self.words.__getitem__, self.chunks.__getitem__
        ids = [b"".join(map(of_words if p else of_chunks, x)) for x, p in zip(parts, plain, strict=True)]
        same = [
            not self.lost or self.lost.isdisjoint(x) or self.decoded(i)[1:] == t.replace(META, " ").encode("utf-8", "surrogatepass")
            for i, x, t in zip(ids, parts, texts, strict=True)
        ]
        return ids, same


def decode_ids(ids: list[int] | None, model: Pieces) -> str:
    """The text of ids; ids of pieces that stand for no text, or of none, give nothing; bad bytes give U+FFFD."""
    out: list[bytes] = []
    for i in ids or ():
        t = model.text[i] if 0 <= i < len(model.text) else None
        if isinstance(t, int):
            out.append(bytes((t,)))
        elif t is not None:
            out.append(t.encode("utf-8", "surrogatepass"))
    text = b"".join(out).decode("utf-8", "replace").replace(META, " ")
    return text[1:] if text.startswith(" ") else text


def _byte_table(model: Pieces) -> list[bytes]:
    """The bytes of each id, meta symbols as blanks."""
    return [bytes((t,)) if isinstance(t, int) else (t or "").replace(META, " ").encode("utf-8", "surrogatepass") for t in model.text]


def encode(docs: DataFrame, model: Pieces, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """The rows of docs with their ids in `ids_col`, and in `check_col`, if given, whether these decode to the text.

    A column of docs with such a name, whatever its case, is replaced. Null and empty texts have no ids. A
    text's own meta symbols cannot be told from blanks and decode as blanks. Rows are encoded one by one,
    whole, so repeats stay repeats; documents are never shuffled.
    """
    new = [c for c in (ids_col, check_col) if c]
    lowered = {c.lower() for c in new}
    kept = [c for c in docs.columns if c.lower() not in lowered]
    spark: SparkSession = docs.sparkSession
    # plain values, since executors may not have the package
    arrays = PairTable.arrays(model) if model.kind == "bpe" else None
    shared = spark.sparkContext.broadcast({"model": tuple(model), "known": codebook(docs, model, text_col, max_frequent), "pairs": arrays})
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def run(batches):
        held = shared.value
        if "encoder" not in held:  # once in each worker process, which keeps what is broadcast
            held["encoder"] = Encoder(Pieces(*held["model"]), held["known"], table=PairTable(*held["pairs"]) if held["pairs"] else None)
        encoder = held["encoder"]
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            for lo, hi in _slices(texts):
                ids, same = encoder.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                ends, values = np.cumsum([0, *map(len, ids)]) // 4, np.frombuffer(b"".join(ids), np.int32)
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())))
                if check_col:
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *new])

    schema = T.StructType([*plain.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(run, schema.add(check_col, T.BooleanType()) if check_col else schema)


def decode(rows: DataFrame, model: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in `text_col`, which replaces a column of that name; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    plain = rows.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(ids_col)

    def run(batches):
        model = Pieces(*shared.value)
        for batch in batches:
            texts = [decode_ids(i, model) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(text_col, T.StringType())]))
