"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

A document is hit where a window of 13 consecutive words of a test text (or all its words, where it has fewer) occurs.
Every known word becomes one symbol, any other word a symbol that no test text has. The automaton holds each test
text's blocks of 7 words side by side: any window holds a whole block, so a document is scanned once for blocks, and
where one is met the words around it are compared to the test text's for as long as they are equal. That costs one node
for a word of test text, where the windows themselves would cost thirteen. Hits are mapped back to offsets in the original text.

An automaton took 16 times the bytes of its test texts (600,000 random words). A task holds one, over SHARD_BYTES of them; more test
texts are scanned for in several passes over the documents, with what was found so far in a checkpoint in between.
Documents are never shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, free_name

#: Bytes of test text that one automaton covers.
SHARD_BYTES = 8 << 20
#: Runs of the bytes of digits, a-z and all characters from U+0080, once A-Z is in lower case.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FIRST_SYMBOL, _SURROGATES, _LAST_SYMBOL = 1, range(0xD800, 0xE000), 0x10FFFF


def normalise(text: str | bytes | None) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(LOWER)


class Automaton:
    """Blocks of (item id, text) pairs; `scan` gives the word intervals that windows cover, and the items whose windows occur."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.window, self.symbols = window, {}
        self.items, self.coded = [], []
        block = (window + 1) // 2
        whole: dict[str, list[int]] = {}  # items of fewer words than a window
        blocks: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            coded = "".join([self._symbol(w) for w in WORD.findall(normalise(text))])
            number = len(self.items)
            self.items.append(item)
            self.coded.append(coded)
            if len(coded) >= window:
                for i in range(0, len(coded) - block + 1, block):
                    blocks.setdefault(coded[i : i + block], []).append((number, i))
            elif coded:
                whole.setdefault(coded, []).append(number)
        self.machine = ahocorasick.Automaton()
        for coded in whole.keys() | blocks.keys():
            self.machine.add_word(coded, (len(coded), whole.get(coded, ()), blocks.get(coded, ())))
        self.empty = not whole and not blocks
        if not self.empty:
            self.machine.make_automaton()

    def _symbol(self, word: bytes) -> str:
        if word not in self.symbols:
            code = _FIRST_SYMBOL + len(self.symbols)
            code += len(_SURROGATES) if code >= _SURROGATES.start else 0
            if code > _LAST_SYMBOL:
                raise ValueError("more distinct words than symbols; lower shard_bytes")
            self.symbols[word] = chr(code)
        return self.symbols[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        if self.empty:
            return [], set()
        get = self.symbols.get
        text = "".join([get(w, "\0") for w in words])
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        reached: dict[tuple[int, int], int] = {}  # of an item laid on the text at a place, how far it was compared
        for last, (length, whole, blocks) in self.machine.iter(text):
            begin, end = last - length + 1, last + 1
            if whole:
                spans.add((begin, end))
                items.update(whole)
            for number, place in blocks:
                laid = (number, begin - place)
                if reached.get(laid, 0) >= end:
                    continue
                item, shift = self.coded[number], begin - place
                a, b = begin, end
                while a > 0 and a > shift and text[a - 1] == item[a - 1 - shift]:
                    a -= 1
                stop = min(len(text), len(item) + shift)
                while b < stop and text[b] == item[b - shift]:
                    b += 1
                reached[laid] = b
                if b - a >= self.window:
                    spans.add((a, b))
                    items.add(number)
        return list(spans), {self.items[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judge(text: bytes | None, machine: Automaton, spans=(), items=()) -> dict:
    """What is known of a text with what `machine` finds in it, besides the spans of words and the items found before."""
    data = normalise(text)
    words = WORD.findall(data)
    more, found = machine.scan(words)
    spans = merged([*spans, *more])
    return {"data": data, "n_words": len(words), "spans": spans, "items": found.union(items)}


def verdict(found: dict) -> dict:
    data, spans = found["data"], found["spans"]
    hit = sum(b - a for a, b in spans)
    offsets = []
    if spans:
        at = [m.span() for m in WORD.finditer(data)]
        place, chars = 0, 0
        for a, b in spans:
            pair = []
            for byte in (at[a][0], at[b - 1][1]):
                chars += len(data[place:byte].decode("utf-8", "replace"))
                place = byte
                pair.append(chars)
            offsets.append({"start": pair[0], "end": pair[1]})
    return {
        "n_words": found["n_words"],
        "n_hit": hit,
        "items": sorted(i for i in found["items"] if i is not None),
        "spans": offsets,
        "contaminated": hit > 0 and 20 * hit >= found["n_words"],
    }


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int):
    """The test texts in lists of about shard_bytes each, read one shard at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // shard_bytes) or 1
    for k in range(n):
        yield k == n - 1, [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().toLocalIterator()]


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def _judged(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, shard_bytes: int):
    """(docs, a function): docs with what all test texts but the last shard's give, in two columns behind its own if there are several shards,
    and a function from a batch of them to what all give of each row's text."""
    rows, at, width = docs, docs.columns.index(text_col), len(docs.columns)
    for last, items in _shards(benchmark, item_col, item_text_col, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast({"items": items})

        def judged(batch, shared=shared):
            held = shared.value
            if "machine" not in held:  # once in each worker process, which keeps what is broadcast
                held["machine"] = Automaton(held.pop("items"), window)
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            before = [c.to_pylist() for c in batch.columns[width:]] or [[()] * len(texts)] * 2
            for text, spans, names in zip(texts, *before, strict=True):
                yield judge(text, held["machine"], [(s["start"], s["end"]) for s in spans], names)

        if last:
            return rows, judged
        names = [free_name(docs, "found_spans"), free_name(docs, "found_items")]

        def run(batches, judged=judged):
            for batch in batches:
                found = list(judged(batch))
                spans = [[{"start": a, "end": b} for a, b in f["spans"]] for f in found]
                columns = [pa.array(spans, _FOUND[0]), pa.array([sorted(f["items"], key=lambda i: (i is not None, i)) for f in found], _FOUND[1])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*batch.schema.names[:width], *names])

        schema = T.StructType([*docs.schema.fields])
        pair = T.StructType().add("start", T.LongType()).add("end", T.LongType())
        schema = schema.add(names[0], T.ArrayType(pair)).add(names[1], T.ArrayType(T.StringType()))
        rows = cut(rows.mapInArrow(run, schema))
        shared.unpersist()


_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, contaminated boolean"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("contaminated", pa.bool_()),
    ]
)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, items, spans (offsets in characters), contaminated.

    Null and empty texts have no words and are clean, as is everything for an empty benchmark. A null item
    id still marks hits but is not listed; items that repeat an id are one item. Rows are judged one by
    one, so repeats and nulls in other columns change nothing.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows, judged = _judged(plain, benchmark, "text", item_col, item_text_col, window, shard_bytes)

    def run(batches):
        for batch in batches:
            found = pa.array([verdict(f) for f in judged(batch)], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], ["id", *[f.name for f in _ARROW]])

    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {_RESULT}").withColumnRenamed("id", id_col)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated; null and empty texts stay."""
    rows, judged = _judged(docs, benchmark, text_col, item_col, item_text_col, window, shard_bytes)
    width = len(docs.columns)

    def run(batches):
        for batch in batches:
            clean = pa.array([not verdict(f)["contaminated"] for f in judged(batch)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width]).filter(clean)

    return rows.mapInArrow(run, docs.schema)
