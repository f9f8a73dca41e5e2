"""Language identification of mixed text.

Script ranges narrow the languages a word can be in; hashed byte trigrams and the whole word score it in
each; Viterbi with a switching penalty labels every word, and runs of one label are spans.

Counts for training are taken over all usable rows, added up on the executors; only one number per
language and bucket reaches the driver. Scoring reads every text whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, chunks_by_size, held_out

BUCKETS = 1 << 16
#: Bytes of text whose words are labelled side by side, and bytes hashed and scored at once, which take some 80 bytes each.
CHUNK, PART = 1 << 21, 1 << 18
UNKNOWN = "und"
#: Most languages that a model can have (half a megabyte each in every task), and most that a task counts before it passes counts on.
MAX_LANGUAGES, COUNTED_AT_ONCE = 200, 32

#: First code points of blocks and the script of each; from the Unicode block list.
_SCRIPT_STARTS = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x005B, "Common"), (0x0061, "Latin"), (0x007B, "Common"), (0x00AA, "Latin"),
    (0x00AB, "Common"), (0x00B5, "Latin"), (0x00B6, "Common"), (0x00BA, "Latin"), (0x00BB, "Common"), (0x00C0, "Latin"),
    (0x02B0, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x2C00, "Other"), (0x2E80, "Han"),
    (0x3000, "Common"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Common"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFE00, "Common"),
    (0xFF21, "Latin"), (0xFF3B, "Common"), (0xFF41, "Latin"), (0xFF5B, "Common"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Common"), (0x10000, "Other"), (0x1D000, "Common"), (0x20000, "Han"), (0x30000, "Common"),
]
SCRIPTS = sorted({s for _, s in _SCRIPT_STARTS} - {"Common"})
_STARTS = np.array([a for a, _ in _SCRIPT_STARTS])
#: One bit for the script of each range; letters in a range of none are of the script "Other".
_BITS = np.array([1 << SCRIPTS.index("Other" if s == "Common" else s) for _, s in _SCRIPT_STARTS], np.int64)


def letter_bits() -> bytes:
    """A bit for each code point, set where its Unicode category is that of a letter; made on the driver and sent to the tasks."""
    return np.packbits([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]).tobytes()


class Words:
    """The words of many texts with letters: trigram and word buckets, and the scripts of their letters."""

    def __init__(self, texts: list[bytes], letters: np.ndarray):
        w = WordHashes([t.translate(LOWER) for t in texts], lower=False)
        data = w.data
        b = np.concatenate((data, np.full(2, 10, np.uint8))).astype(np.uint32)  # a text ends with a line feed, the last one too
        before = np.concatenate(([np.uint32(10)], b[: len(data)]))[: len(data)]
        tri = (before << np.uint32(16)) | (b[: len(data)] << np.uint32(8)) | b[1 : len(data) + 1]
        self.trigram = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
        script = self._scripts(data, letters)
        bits = np.bitwise_or.reduceat(script, w.byte_start) if len(w.byte_start) else np.zeros(0, np.int64)
        if len(w.byte_start):  # reduceat runs on to the next word's start; white space between them has no script
            keep = bits != 0
        else:
            keep = np.zeros(0, bool)
        self.start, self.end, self.script = w.byte_start[keep], w.byte_end[keep], bits[keep]
        self.word = (w.hash[keep] & np.uint64(BUCKETS - 1)).astype(np.int64)
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        self.first = kept_before[w.first]
        self.text_start = w.text_start

    @staticmethod
    def _scripts(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The script bit of the letter that begins at each byte; 0 for other characters and for continuation bytes."""
        ascii_letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
        out = np.where(ascii_letter, _BITS[1], 0)
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
            b0, b1, b2, b3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
            code = np.where(
                b0 < 0xE0,
                ((b0 & 31) << 6) | b1,
                np.where(b0 < 0xF0, ((b0 & 15) << 12) | (b1 << 6) | b2, ((b0 & 7) << 18) | (b1 << 12) | (b2 << 6) | b3),
            )
            code = np.minimum(code, 0x10FFFF)
            bit = _BITS[np.searchsorted(_STARTS, code, side="right") - 1]
            out[lead] = np.where(letters[code], bit, 0)
        return out


class Model:
    """Languages in order, a score per trigram and word bucket and language, and each language's scripts.

    `known` is the log of how much likelier each trigram bucket is in the learned texts than by chance; `packed` has a
    bit for each code point that is a letter. Tasks are sent `plain()`, as they may not have the package.
    """

    def __init__(self, langs: list[str], trigram: np.ndarray, word: np.ndarray, scripts: np.ndarray, known: np.ndarray, packed: bytes):
        self.langs, self.trigram, self.word, self.scripts, self.known, self.packed = langs, trigram, word, scripts, known, packed
        self.letters = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)

    def plain(self) -> tuple:
        return self.langs, self.trigram, self.word, self.scripts, self.known, self.packed


def _counter(packed: bytes):
    """(lang, bucket, n): trigrams, then words, then letters' scripts, added up per task."""

    def flush(sums):
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"]
            )
        sums.clear()

    def run(batches):
        letters = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                if len(sums) >= COUNTED_AT_ONCE and lang not in sums:
                    yield from flush(sums)
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for i, j in chunks_by_size(own, PART):
                    w = Words(own[i:j], letters)
                    total = sums.setdefault(lang, np.zeros(2 * BUCKETS + len(SCRIPTS), np.int64))
                    inside = np.zeros(len(w.trigram) + 1, np.int64)
                    np.add.at(inside, w.start, 1)
                    np.add.at(inside, w.end, -1)
                    total[:BUCKETS] += np.bincount(w.trigram[np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)
                    total[BUCKETS : 2 * BUCKETS] += np.bincount(w.word, minlength=BUCKETS)
                    for s in range(len(SCRIPTS)):
                        total[2 * BUCKETS + s] += int(((w.script >> s) & 1).sum())
        yield from flush(sums)

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row that has a text and a language and is not held out; no such row gives no languages.

    Rows that repeat count as often as they are there; rows with a null id, text or language are not used, and other
    columns are ignored. More than MAX_LANGUAGES languages are refused, as a task could not hold their model.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col!r}")
    packed = letter_bits()
    got = rows.mapInArrow(_counter(packed), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2 * BUCKETS + len(SCRIPTS), len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    counts[got.column("bucket").to_numpy(), [number[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    parts = []
    for part in (counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS]):
        p = (part + 0.5) / (part.sum(0) + 0.5 * BUCKETS)
        parts.append((np.log(p) - np.log(p).mean(1, keepdims=True)).astype(np.float32) if langs else p.astype(np.float32))
    seen = counts[2 * BUCKETS :]
    scripts = np.array([sum(1 << s for s in range(len(SCRIPTS)) if seen[s, k] > 0.01 * seen[:, k].sum()) for k in range(len(langs))], np.int64)
    seen_by_all = counts[:BUCKETS].sum(1)
    known = np.log((seen_by_all + 0.5) / (seen_by_all.sum() + 0.5 * BUCKETS) * BUCKETS).astype(np.float32)
    return Model(langs, parts[0], parts[1], scripts, known, packed)


def _viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, where changing the label costs `penalty`; texts advance side by side."""
    labels = np.zeros(len(score), np.int64)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return labels
    begin, n = first[order], n[order]
    alive = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
    back = np.zeros(score.shape, np.int8 if score.shape[1] < 128 else np.int32)
    state = score[begin].astype(np.float64)
    own = np.arange(score.shape[1])
    for t in range(1, n[0]):
        k = alive[t]
        at = begin[:k] + t
        was = state[:k]
        best = was.argmax(1)
        jump = was[np.arange(k), best] - penalty
        stay = was >= jump[:, None]
        back[at] = np.where(stay, own, best[:, None])
        state[:k] = np.where(stay, was, jump[:, None]) + score[at]
    now = state.argmax(1)
    labels[begin + n - 1] = now
    for t in range(n[0] - 1, 0, -1):
        k = alive[t]
        at = begin[:k] + t
        now[:k] = back[at, now[:k]]
        labels[at - 1] = now[:k]
    return labels


def _scores(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(margin, score) of each word and language; margins are what Viterbi adds up."""
    n_lang = len(model.langs)
    # one language at a time, so that only one number for each byte is held
    score = np.empty((len(w.start), n_lang), np.float32)
    for k in range(n_lang):
        total = np.concatenate(([0.0], np.cumsum(model.trigram[w.trigram, k], dtype=np.float64)))
        score[:, k] = total[w.end] - total[w.start] + model.word[w.word, k]
    if not score.size:
        return score, score
    fits = (w.script[:, None] & model.scripts[None, :]) != 0
    some = fits.any(1)
    score[~fits & some[:, None]] = -np.inf
    score[~some] = 0
    # a word counts for 12 at most, but no chain of words makes up for a script
    margin = np.maximum(score - score.max(1, keepdims=True), -12)
    margin[~fits & some[:, None]] = -1e6
    return margin, score


def label_words(texts: list[bytes], model: Model, penalty: float = 6.0) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, label of each word, score of each word and language).

    A language whose texts have none of a word's scripts is no choice for it; a word in scripts of no language says nothing.
    """
    w = Words(texts, model.letters)
    margin, score = _scores(w, model)
    return w, _viterbi(margin, w.first, penalty) if score.size else np.zeros(0, np.int64), score


def predict_texts(texts: list[bytes], model: Model, penalty: float = 6.0) -> tuple[list[str], np.ndarray]:
    """The language of most letters' bytes in each text, and that share; UNKNOWN and 0 without a letter."""
    langs, scores = [], []
    for i, j in chunks_by_size(texts, CHUNK):
        # hashed part by part, which takes the most room, and labelled together, which takes a step for each word of the longest text
        first, sizes, margins = [np.zeros(1, np.int64)], [], []
        for a, b in chunks_by_size(texts[i:j], PART):
            w = Words(texts[i + a : i + b], model.letters)
            margins.append(_scores(w, model)[0])
            sizes.append(w.end - w.start)
            first.append(w.first[1:] + first[-1][-1])
        margin, of_text = np.concatenate(margins), np.concatenate(first)
        weight = np.zeros((j - i, max(1, len(model.langs))))
        if margin.size:
            owner = np.repeat(np.arange(j - i), np.diff(of_text))
            np.add.at(weight, (owner, _viterbi(margin, of_text, penalty)), np.concatenate(sizes))
        total, best = weight.sum(1), weight.argmax(1)
        for k in range(j - i):
            langs.append(model.langs[best[k]] if total[k] else UNKNOWN)
        scores.append(np.where(total > 0, weight[np.arange(j - i), best] / np.maximum(total, 1), 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def language_spans(text: str, model: Model, penalty: float = 6.0) -> list[tuple[int, int, str]]:
    """(start, end, language) in characters of each run of words with one label."""
    data = text.encode("utf-8", "surrogatepass")
    w, labels, _ = label_words([data], model, penalty)
    out: list[tuple[int, int, str]] = []
    for a, b, k in zip(w.start.tolist(), w.end.tolist(), labels.tolist(), strict=True):
        lang = model.langs[k]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], b, lang)
        else:
            out.append((a, b, lang))
    return [(len(data[:a].decode("utf-8", "replace")), len(data[:b].decode("utf-8", "replace")), k) for a, b, k in out]


def familiarity(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of trigrams in its words, and the mean log of how much likelier than chance they are.

    Words with a digit, such as keys and tokens, are in no language and do not count.
    """
    sizes, means = [], []
    for i, j in chunks_by_size(texts, PART):
        w = Words(texts[i:j], model.letters)
        total = np.concatenate(([0.0], np.cumsum(model.known[w.trigram], dtype=np.float64)))
        data = np.frombuffer(b"\n".join(texts[i:j]), np.uint8)
        digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
        plain = digits[w.end] == digits[w.start]
        inside = np.concatenate(([0.0], np.cumsum((total[w.end] - total[w.start]) * plain)))
        letters = np.concatenate(([0], np.cumsum((w.end - w.start) * plain)))
        n = np.diff(letters[w.first])
        sizes.append(n)
        means.append(np.diff(inside[w.first]) / np.maximum(n, 1))
    return (np.concatenate(sizes), np.concatenate(means)) if sizes else (np.zeros(0, np.int64), np.zeros(0))


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0, spans: bool = False) -> DataFrame:
    """One row (id, held_out, lang_pred, score[, spans]) for each row of docs.

    A text that is null, empty or has no letter (by Unicode category) is `und` with score 0, as is every text for a model
    without languages. Ties go to the language first in order. Rows are judged one by one, whole, so repeats stay
    repeats; a null id counts as held out; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            langs, score = predict_texts(texts, model, penalty)
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            if spans:
                found = [language_spans(t.decode("utf-8", "replace"), model, penalty) for t in texts]
                columns.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "lang_pred", "score", "spans"][: len(columns)])

    plain = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").cast("binary"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    schema += ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_unsure_language(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, penalty: float = 6.0, least_known: float = 0.0, evidence: int = 100
) -> DataFrame:
    """The rows of docs, with all their columns, of which one language has at least `threshold` of the letters.

    Texts of two or three languages stay; null texts, those without a letter, and medleys go. The share is among
    the learned languages, so texts whose trigrams are on average no likelier in these than by chance go too
    (`least_known`): gibberish and other languages. Words of fewer than `evidence` bytes are too few to tell.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model.plain()), docs.columns.index(text_col)

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            langs, score = predict_texts(texts, model, penalty)
            n, known = familiarity(texts, model)
            sure = (score >= threshold) & ((known >= least_known) | (n < evidence))
            yield batch.filter(pa.array(sure & np.array([x != UNKNOWN for x in langs], bool), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
