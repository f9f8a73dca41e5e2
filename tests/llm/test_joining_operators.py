"""Operators that compare rows: near-duplicates of texts and vectors, URL aliases, components; and the lattice."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from nestql.llm import embedding_dedup, minhash_dedup, sentencepiece, url_filter
from nestql.llm.components import connected_components
from nestql.llm.embedding_dedup import embedding_links
from nestql.llm.shingles import shingle_sets

MODEL = os.environ.get("NESTQL_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(1)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = [*zip(chain, chain[1:], strict=False), *[(7, i) for i in range(20, 40)], (7, 7), (3, 2), (2, 3), (None, 1), (1, None)]
    df = spark.createDataFrame(links, "src long, dst long")
    want = groups({n for link in links for n in link if n}, [x for x in links if None not in x])
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: c for n, c in want.items() if n != 1}
    assert connected_components(df.limit(0)).count() == 0


# Near-duplicates ------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_rows():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 200]))]
        for copies in range(rng.choice([1, 2, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) if copies else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rows += ["One two", "one TWO", "one  two\n", "one two three", "", None, "   ", "É x", "é x", "long " * 30_000, "long " * 30_001]
    rng.shuffle(rows)
    return [(i * 3 % 997, t, "x", i) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block_rows)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT string, component_id int")
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(ids, links)
    got = minhash_dedup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    if block_rows == 1024:
        kept = minhash_dedup.deduplicate(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text), (4, "other words are here now"), (9, "other words are here now")], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (4, 4, True), (5, 4, False), (5, 4, False), (9, 4, False), (9, 4, False)]
    assert sorted((r.doc_id or 0) for r in minhash_dedup.deduplicate(df).collect()) == [0, 4]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0 and minhash_dedup.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_keeps_different_texts_of_one_id(spark):
    rng = random.Random(6)
    first, second = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(90)) for _ in range(60)) for _ in range(2))
    near = first + " end"
    rows = [(1, first), (1, second), (1, near), (1, first), (1, None), (1, ""), (2, None), (2, "short"), (3, None), (3, ""), (4, first), (5, second), (6, "other"), (6, "two words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept_id string")
    got = minhash_dedup.deduplicate(df, percent=80)
    assert got.columns == df.columns
    found = sorted((r.doc_id, r.text or "") for r in got.collect())
    ones = [t for i, t in found if i == 1]
    assert len(ones) == 2 and second in ones and (first in ones) != (near in ones)
    assert found[2:] == [(2, "short"), (3, ""), (6, "other"), (6, "two words")]


def test_shingle_sets_count_as_plain_python():
    texts = [t or "" for _, t, *_ in near_rows()]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


# Embeddings -----------------------------------------------------------------------------------------------


def vector_rows(seed=3, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=8)
        if i % 3 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=8) * rng.choice([0, 0.05, 0.2, 0.35])
        rows.append((i * 7 % 1009, [float(x) for x in v * rng.choice([1, 5])], int(rng.integers(2))))
    bad = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [], [1.0, 2.0]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(bad)]
    rows += [(3000, rows[0][1], None), (3001, rows[0][1], None), (3002, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(2048, 2048), (20, 2048), (16, 9)])
def test_embedding_links_equal_brute_force(spark, cell_rows, block_rows):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, COMPONENT_ID string")
    ok = {i: (np.array(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    for i, (v, g) in ok.items():
        for j, (w, h) in ok.items():
            if i < j and g == h and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links.append((i, j))
    assert len(links) > 60
    want = groups([r[0] for r in rows], links)
    degree = {i: sum(i in link for link in links) for i in want}
    got = embedding_links(df, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], want[i], want[i] == i) for i in want}


def test_embedding_large_and_small_vectors(spark):
    rows = [(1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [1e-200, 1e-201]), (4, [0.0, -1e308]), (5, [-0.0, -3.0]), (6, [float("inf"), 0.0]), (7, [5e-324, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (3, 1)}


def test_embedding_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "COPY_COST", 0)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 8))
    v = centres[rng.integers(25, size=900)] + 0.16 * rng.normal(size=(900, 8))
    v[::9] = v[1::9]
    df = spark.createDataFrame([(i, x.tolist(), int(i % 5 == 0)) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    seen = []
    monkeypatch.setattr(embedding_dedup, "_cells_worth", lambda *a, f=embedding_dedup._cells_worth: seen.append(f(*a)) or seen[-1])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df, cell_rows=20, block_rows=60).collect()}
    assert max(seen) > 4
    u = v / np.sqrt((v * v).sum(1))[:, None]
    linked = (u @ u.T >= 0.93) & np.equal.outer(np.arange(900) % 5 == 0, np.arange(900) % 5 == 0)
    np.fill_diagonal(linked, False)
    want = groups(range(900), zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True))
    assert got == {i: (int(linked[i].sum()), want[i]) for i in range(900)}


def test_embedding_edge_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = embedding_links(df).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert embedding_links(df.limit(0)).count() == 0
    assert [r.n_links for r in embedding_links(df.where("vec_id is null")).collect()] == [0]


# URLs -----------------------------------------------------------------------------------------------------


def page(target=None, refresh=None):
    out = f'<link href="{target}" rel="canonical">' if target else ""
    return f"<head>{out}" + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else "") + "</head>"


def test_url_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://com/de", "com", "/de", None, "allow"),
        ("http://x.org?u=/a", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://http://y/p", "http:", "//y/p", None, "allow"),
        ("http://h\nx/p\nq", "h\nx", "/p\nq", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], None, "x") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, html string, HOST string")
    got = sorted(url_filter.url_verdicts(df).collect())
    assert [tuple(r)[1:] for r in got] == [u[1:] for u in [*urls, urls[0]]]
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "html", "want"),
    [
        ("http://a.net/x/y", '<link rel="canonical" href="../c">', ["http://a.net/c"]),
        ("http://a.net:80/x", "<link rel=canonical href=/q?a=1&amp;b=2><link rel=canonical href=/r>", ["http://a.net/q?a=1&b=2", "http://a.net/r"]),
        ("http://a.net/x", '<!-- <link rel="canonical" href="/no"> --><link href="&#47;caf&#xe9;&#x1F600;" rel="alternate canonical">', ["http://a.net/café😀"]),
        ("http://a.net/x", '<base href="http://b.net:80/d/"><link rel=canonical href="./e/../f">', ["http://b.net/d/f"]),
        ("http://a.net/x", """<script>"<link rel=canonical href=/no>"</script><meta http-equiv="refresh" content="0; URL='https://c.net:443'">""", ["https://c.net/"]),
        ("http://a.net/x", "<link rel=canonical href=mailto:x><link rel=canonical href='#f'><link rel=stylesheet href=/css>", []),
        ("http://a.net/x", "<link rel=canonical href=http://a.net/x#me>", []),
        ("http://a.net/" + "p/" * 20_000 + "x", "<link rel=canonical href=..>", ["http://a.net/" + "p/" * 19_999]),
        (None, "<link rel=canonical href=/c>", []),
        ("no scheme", "<link rel=canonical href=/c>", []),
    ],
)
def test_url_links_are_resolved(spark, url, html, want):
    got = url_filter.page_links(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).collect()
    assert sorted(r.dst for r in got) == sorted(want)


def test_url_aliases_share_blocks_but_not_with_allowed_pages(spark):
    pages = [
        (1, "http://x.net/a", page("http://x.com/de/blocked")),
        (2, "http://y.net/b#top", page(refresh="http://x.net/a")),
        (3, "http://z.org/c", page("http://x.net/a")),
        (4, "http://w.net/d", page("/e")),
        (5, "http://w.net/e", page("#self")),
        (6, "http://Y.net/b", None),
        (7, "http://v.net/f", page("http://y.net/b")),
        (8, None, page("http://x.com/de/blocked")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow"}
    more = spark.createDataFrame([("http://w.net/e", "http://q.com/de/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(df, redirects=more).collect()}
    assert (got[4], got[5]) == ("block", "block")


# SentencePiece --------------------------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no piece model here")
ALPHABET = "aábcdeéth er\n\t.,'\"()==--//##  00112你好😀ß▁"


def odd_texts(n=200):
    rng = random.Random(4)
    return ["", " ", " a", "a  b", "\n", "x" * 3000, "ab" * 900, "the house " * 200, *["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]]


@needs_model
def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece as library

    model, texts = sentencepiece.Pieces.read(MODEL), odd_texts()
    want = library.SentencePieceProcessor(model_file=MODEL).encode(texts)
    for limit in (200_000, 3):
        encoder = sentencepiece.Encoder(model, {}, limit, sentencepiece.PairTable(*sentencepiece.PairTable.arrays(model)))
        assert [np.frombuffer(i, np.int32).tolist() for i in encoder.encode(texts)[0]] == want
        assert [np.frombuffer(encoder.encode([t])[0][0], np.int32).tolist() for t in texts] == want
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, Ids string, ROUND_TRIP int")
    got = sentencepiece.encode(df, model, check_col="round_trip")
    assert got.columns == ["doc_id", "text", "ids", "round_trip"]
    rows = sorted(got.collect())
    assert [r.ids for r in rows] == [*want, []] and all(r.round_trip for r in rows)
    decoded = {r.doc_id: r.decoded for r in sentencepiece.decode(got, model).collect()}
    assert decoded == {i: t.replace("▁", " ") for i, t in enumerate([*texts, ""])}
    assert sentencepiece.encode(df.limit(0), model).count() == 0
    assert sentencepiece.decode_ids([-1, 10**9, 1, 2, 0], model) == ""


@needs_model
@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_lattice_equals_the_fold_in_tasks(spark, kind):
    model = sentencepiece.Pieces.read(MODEL)
    if kind == "unigram":
        scores = {p: (-(len(p) ** 0.5) - i % 97 / 50, i) for p, (_, i) in model.piece.items()}
        model = model._replace(kind="unigram", piece=scores, worst=-12.0)
    words = sorted({c for t in odd_texts(60) for c in sentencepiece.chunks(t) if len(c) <= sentencepiece.MASK_CHARS})
    got = sentencepiece.relational_encode(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()
    assert len(got) == len(words)
    for r in got:
        assert "".join(r.pieces) == r.word
        assert [i for p in r.pieces for i in sentencepiece._leaf_ids(model, p)] == sentencepiece.fold(r.word, model)


@needs_model
@pytest.mark.parametrize("max_frequent", [0, 3, 20])
def test_pieces_equal_the_library_with_few_words_in_the_lattice(spark, max_frequent):
    import sentencepiece as library

    model, texts = sentencepiece.Pieces.read(MODEL), odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = sentencepiece.codebook(df, model, max_frequent=max_frequent)
    assert len(known) <= max_frequent and (known or max_frequent < 20)
    rows = sorted(sentencepiece.encode(df, model, max_frequent=max_frequent).collect())
    assert [r.ids for r in rows] == library.SentencePieceProcessor(model_file=MODEL).encode(texts)


@needs_model
def test_chunks_are_counted_over_all_texts(spark, monkeypatch):
    texts = [t for t in odd_texts(80) for _ in range(2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    for lone in ("", "\n", "\n\t"):
        counts = Counter(c for t in texts for c in sentencepiece.chunks(t, lone))
        want = {c for c, n in counts.items() if n > 1 and len(c) <= sentencepiece.MASK_CHARS}
        assert {r.word for r in sentencepiece.frequent_chunks(df, "text", 10**6, lone).collect()} == want
        assert all("".join(sentencepiece.chunks(t, lone)) == ("▁" + t if t else "").replace(" ", "▁") for t in texts)


@needs_model
def test_round_trip_is_judged_without_byte_pieces():
    model = sentencepiece.Pieces.read(MODEL)._replace(byte=None)
    encoder = sentencepiece.Encoder(model, {})
    texts = ["the house", "the 你好😀 house", "a  b", "a  😀 b", "", "😀", "the house"]
    for text, ids, same in zip(texts, *encoder.encode(texts), strict=True):
        assert same == (sentencepiece.decode_ids(np.frombuffer(ids, np.int32).tolist(), model) == text)


@needs_model
def test_folding_many_words_equals_folding_each():
    model = sentencepiece.Pieces.read(MODEL)
    table = sentencepiece.PairTable(*sentencepiece.PairTable.arrays(model))
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choice("etaoinshrdlu▁ABCéñß019.,'-_😀") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = table.fold([*words, "", "x" * 100])
    assert got[-2:] == [None, None]
    assert sum(g is not None for g in got) > 1000
    for w, g in zip(words, got, strict=False):
        assert g is None or np.frombuffer(g, np.int32).tolist() == sentencepiece.fold_bpe(w, model)
