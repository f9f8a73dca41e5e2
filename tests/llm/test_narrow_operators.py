"""Operators that treat rows one by one: HTML, chat, license, quality, language, decontamination."""

import hashlib
import os
import random
import re
import subprocess
import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nestql.llm import chat_format, decontaminate, html_extract, language_id, license_scan, quality_classifier

DOCS = "doc_id long, text string, lang string, n_words int, IDS string, score string"


def docs(spark, rows):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, 1, "x", None) for i, t, lang in rows], DOCS)


# HTML -----------------------------------------------------------------------------------------------------

PROSE = "The river was high in the spring and the people of the town had to stay with their friends on the hill until the water was low, "
LONG = (PROSE * 3).strip()
PAGE = f"""<!doctype html><html><head><title>Out</title><style>p{{}}</style></head><body>
<div id="top-menu"><a href="/a">Home</a> <a href="/b">News</a></div><header>Site name</header>
<div class="cookie-notice"><p>{LONG}</p></div>
<div><h1>A   heading</h1><p>{LONG} caf&eacute;&nbsp;&amp; more<br>line <b>two</b></p><p>Short one.</p><p>{LONG}</p>
<script>var x = "<p>no</p>";</script><!-- <p>no</p> --></div>
<aside><p>{LONG}</p></aside><form><p>{LONG}</p></form>
<section id="comments"><p>{LONG}</p></section><div class="ad">{LONG}</div>
<div><a href="/1">One link to a page</a> <a href="/2">Another link to a page</a></div><footer>{LONG}</footer></body></html>"""


def test_html_without_article_element():
    clean = " ".join(LONG.split())
    assert html_extract.main_text(PAGE) == "\n\n".join(["A heading", clean + " café & more line two", "Short one.", clean])


def test_html_with_article_element_keeps_all_of_it():
    page = f"<body><nav><a>x</a></nav><div>{LONG}</div><article><header><h1>T</h1></header><p>Zzz qqq %%%.<p>Kurz<ul><li>one</li><li>two</ul><div class='share-buttons'>Share</div></article><p>{LONG}</p>"
    assert html_extract.main_text(page) == "T\n\nZzz qqq %%%.\n\nKurz\n\none\n\ntwo"


def test_html_article_keeps_linked_headlines_paragraphs_and_references():
    article = f"""<article><h1><a href="/t">A linked title</a></h1><p>{LONG}</p><p><a href="/r">The whole report of the town can be read here</a>.</p>
<ul><li><a href="/home">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>
<p><a href="/x">One</a> | <a href="/y">Two</a> | <a href="/z">Three</a></p><a href="/u"><h2>Sources</h2></a>
<ol><li>Doe: <a href="/1">A history of the river and its floods</a>, 1990</li><li>Roe, <a href="/2">Rivers</a></li><li>Poe 1984, <a href="/3">Of the hills and the towns</a></li></ol>
<div class="related"><h3><a href="/4">Related page</a></h3></div></article>"""
    want = ["A linked title", " ".join(LONG.split()), "The whole report of the town can be read here.", "Sources"]
    want += ["Doe: A history of the river and its floods, 1990", "Roe, Rivers", "Poe 1984, Of the hills and the towns"]
    assert html_extract.main_text(f"<body><nav><a href='/'>Top</a></nav>{article}</body>") == "\n\n".join(want)


def test_html_unmarked_page_in_a_language_without_stop_words():
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    chinese = "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 3
    for text in (finnish, finnish * 3, chinese):
        page = f"<body><div><a href='/a'>Etusivu</a> <a href='/b'>Uutiset</a></div><h1>Otsikko</h1><p>{text}</p><p>{text}</p><div><a href='/c'>Yhteystiedot</a></div></body>"
        assert html_extract.main_text(page) == "\n\n".join(["Otsikko", text, text])


WRAPPERS = ["overflow-hidden", "has-sidebar", "no-comments", "related-layout", "search-page", "with-nav", "page-layout has-sidebar", "story"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "section"])
def test_html_names_of_states_and_layouts_are_no_boilerplate(name, tag):
    text = " ".join(["It was the best of times and it was the worst of times in all of the land"] * 5)
    page = f"<body class='no-comments'><nav><a href='/'>Top</a></nav><div class='{name}'><{tag}><p>{text}</p><p class='{name}'>{text} too</p></{tag}></div></body>"
    assert html_extract.main_text(page) == f"{text}\n\n{text} too"


@pytest.mark.parametrize("name", ["sidebar", "site-nav", "cookie-banner", "sidebar-left", "commentList", "post-comments", "ad", "article-tags"])
def test_html_names_of_boilerplate(name):
    text = " ".join(["It was the best of times and it was the worst of times in all of the land"] * 5)
    for page in (f"<article><p>{text}</p><div class='{name}'>{text}</div></article>", f"<div class='{name}'><p>{text}</p></div><p>{text}</p>"):
        assert html_extract.main_text(page) == text


def test_html_article_in_a_container_named_like_boilerplate():
    text = " ".join(["It was the best of times and it was the worst of times in all of the land"] * 5)
    assert html_extract.main_text(f"<div class='widget'><div class='ad'>{text}</div><article><p>{text}</p></article></div>") == text
    teaser = f"<div class='related'><article><p>Another. {text}</p></article></div>"
    assert html_extract.main_text(f"<div><p>{text}</p></div>{teaser}") == text


def test_html_deep_nesting_is_linear():
    n = 60_000
    page = "<div class='x'>" * n + "<p>It was the best of times, it was the worst of times, and there they were in all of it.</p>" + "</div>" * n + "</p></section>" * n
    begin = time.time()
    assert html_extract.main_text(page).startswith("It was")
    assert time.time() - begin < 20


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<<>><p", "<!-- open", "<script>open", "a < b", "<p class='x", "<a href=\"x>y", "&#0;&#xD800;&bogus;", "</p></div></body>", "<p>" * 3000])
def test_html_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pabdiv \"'=&;!-\n", max_size=80))
def test_html_never_fails(page):
    html_extract.main_text(page).encode()


def test_html_long_pages_are_whole():
    n = 5000
    text = html_extract.main_text("<article>" + "".join(f"<p>Block {i} of the page</p>" for i in range(n)) + "</article>")
    assert text.split("\n\n") == [f"Block {i} of the page" for i in range(n)]


def test_html_query_shape(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, TEXT string")
    got = html_extract.extract(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(html_extract.main_text(PAGE))), (None, 0), (1, len(html_extract.main_text(PAGE)))]
    assert html_extract.extract(pages.limit(0)).count() == 0


# Chat -----------------------------------------------------------------------------------------------------

GRAMMAR = chat_format.Grammar()
MARKS = [*GRAMMAR.template.controls(), "<\\s>", "<\\\\/s>", "[\\INST]", "[/INST", "]", "\\", " ", "a", "\n", "é", "[ESC] ", "[TURN ", "%5D", " </s>"]
TEXTS = st.lists(st.sampled_from(MARKS), max_size=8).map("".join)


TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), max_size=4)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_chat_reads_back(turns):
    rendered = [GRAMMAR.render(r, t) for r, t in turns]
    whole = "".join(r for r, _, _ in rendered)
    assert [(r, t) for r, t, _, _ in GRAMMAR.parse(whole)] == turns
    for (out, a, b), (_, text) in zip(rendered, turns, strict=True):
        assert GRAMMAR.unescape(out[a:b]) == text or out[a:b] == text
        assert not any(c in out[a:b] for c in GRAMMAR.template.controls())


@settings(max_examples=60, deadline=None)
@given(TURNS, st.integers(1, 9))
def test_chat_reads_back_however_it_is_cut(turns, size):
    whole = "".join(GRAMMAR.render(r, t)[0] for r, t in turns)
    reader = chat_format.Reader(GRAMMAR)
    got = [x for i in range(0, len(whole), size) for x in reader.feed(whole[i : i + size])]
    reader.finish()
    assert [g[:4] for g in got] == list(GRAMMAR.parse(whole))
    assert all(whole[a:b] == raw for _, _, a, b, raw in got)


def test_chat_long_conversation(spark):
    n = 30_000
    texts = [f"text {i} " + ("</s>" if i % 3 == 0 else "") + "y" * (i % 50) for i in range(n)]
    rows = [(5, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(6, 0, "user", "x" * 3_000_000 + "</s>")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(conv)).collect()}
    loss = "".join(texts[1::2])
    assert (got[5].n_turns, got[5].loss_chars, got[5].loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[6].turns_sha256 == hashlib.sha256(f"user\n{rows[-1][3]}\n".encode()).hexdigest()


def test_chat_rejects_other_text():
    for bad in ("x", "<s>[INST] a", "<s>[TURN x", "<s>[INST] a [/INST]x"):
        with pytest.raises(ValueError):
            list(GRAMMAR.parse(bad))


def test_chat_digests(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "system", None), (1, 3, "assistant", "x</s>y"), (1, 3, "assistant", "x</s>y"), (2, 1, None, "t"), (None, 1, "user", "n"), (-7, 0, "assistant", "[ESC] ")]
    conv = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, RENDERED string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(conv)).collect()}
    for key in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == key))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[key]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(GRAMMAR.render(r, x)[0]) for _, r, x in own)
    assert chat_format.digests(chat_format.format_turns(conv.limit(0))).count() == 0


# License --------------------------------------------------------------------------------------------------


def test_license_scan_finds_quotes_with_long_insertions():
    index = license_scan.Index(license_scan.TEMPLATES)
    noise = [f"noise{i}" for i in range(60)]
    for name in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-2-Clause", "Zlib"):
        if name not in license_scan.TEMPLATES:
            continue
        words = license_scan.TEMPLATES[name].split()
        n = len(words)
        for cuts in ([n // 2], [n // 3, 2 * n // 3]):
            parts, before = [], 0
            for c in [*cuts, n]:
                parts += words[before:c] + (noise[: 20 + len(parts) % 20] if c < n else [])
                before = c
            text = "é " + " ".join(["lead"] * 7 + parts + ["tail"] * 5)
            found = [m for m in license_scan.scan([text.encode()], index)[0] if m["license"] == name]
            assert len(found) == 1 and found[0]["coverage"] >= 0.97, (name, cuts, found)
            quoted = text.encode()[found[0]["start"] : found[0]["end"]].decode().split()
            assert quoted[0] == words[0] and quoted[-1].strip(".,'\"") == words[-1].strip(".,'\"")
    half = " ".join(license_scan.TEMPLATES["MIT"].split()[:60] + noise * 8)
    assert not [m for m in license_scan.scan([half.encode()], index)[0] if m["license"] == "MIT"]


def test_license_offsets_in_long_texts_with_many_matches(spark):
    line = license_scan.TEMPLATES["MIT-line"]
    text = "".join(f"ünïcode {i} {line} " for i in range(3000))
    (row,) = license_scan.license_matches(docs(spark, [(1, text, None)])).collect()
    assert row.n_matches == 3000 and {text[m.start : m.end] for m in row.matches} == {line.rstrip(".")}


def test_license_scan_finds_whole_and_altered_templates():
    index = license_scan.Index(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT"]
    words = mit.split()
    altered = " ".join("changed" if i % 23 == 22 else w for i, w in enumerate(words) if i % 31 != 30)
    texts = ["", "nothing here at all", f"Héllo. {mit} End.", f"{altered}", " ".join(words[: len(words) // 2]), f"{mit}\n\n{mit}", "x " * 5000 + "Released under the MIT License." + " y" * 5000]
    found = license_scan.scan([t.encode() for t in texts], index)
    assert [[m["license"] for m in f] for f in found] == [[], [], ["MIT"], ["MIT"], [], ["MIT", "MIT"], ["MIT-line"]]
    (m,) = found[2]
    assert m["coverage"] == 1 and texts[2].encode()[m["start"] : m["end"]].decode() == mit.rstrip(".")
    assert 0.8 <= found[3][0]["coverage"] < 1


def test_license_winnowing_hits_every_long_quote():
    rng = random.Random(4)
    grams = license_scan.np.array([rng.randrange(1 << 62) for _ in range(300)], license_scan.np.uint64)
    kept = license_scan.winnow(grams)
    assert all(any(i <= k < i + license_scan.WINDOW for k in kept) for i in range(300 - license_scan.WINDOW + 1))


@pytest.mark.parametrize("name", ["MIT-line", "CC-BY-NC-4.0-line", "Apache-2.0-line", "GPL-3.0-line", "ISC"])
@pytest.mark.parametrize("between", [" ", " and "])
def test_license_repeats_that_stand_together_are_all_found(name, between):
    index = license_scan.Index(license_scan.TEMPLATES)
    line = license_scan.TEMPLATES[name]
    for n in (2, 3, 1000):
        text = between.join([line] * n)
        found = [m for m in license_scan.scan([text.encode()], index)[0] if m["license"] == name]
        step = len(line + between)
        bare = line.rstrip(".")  # spans end with the last word
        assert [(m["start"], m["end"], m["coverage"]) for m in found] == [(i * step, i * step + len(bare), 1.0) for i in range(n)]


def test_license_altered_repeats_that_stand_together_are_all_found():
    index = license_scan.Index(license_scan.TEMPLATES)
    altered = "Licensed under the Apache License, Version 2.1."  # 7 of 8 words
    text = " ".join([altered] * 50)
    found = [m for m in license_scan.scan([text.encode()], index)[0] if m["license"] == "Apache-2.0-line"]
    assert [m["start"] for m in found] == [i * (len(altered) + 1) for i in range(50)] and {m["coverage"] for m in found} == {0.875}


def test_license_short_templates_are_found_however_their_words_are_parted():
    index = license_scan.Index(license_scan.TEMPLATES)
    assert [(m["license"], m["coverage"]) for m in license_scan.scan([b"x Released under the new MIT License y"], index)[0]] == [("MIT-line", 1.0)]
    assert license_scan.scan([b"none of these words", b""], index) == [[], []]
    rng, missed = random.Random(3), 0
    for t, name in enumerate(index.names):
        m = len(index.words[t])
        if m >= license_scan.SHORT:
            continue
        own = license_scan.TEMPLATES[name].replace(".", " ").split()
        for _ in range(40):
            lost = set(rng.sample(range(len(own)), rng.randint(0, len(own) // 5)))
            parted = set(rng.sample(range(len(own)), rng.randint(0, min(8, len(own)))))
            text = " ".join(["zz"] * 30 + [w + " qq" * (i in parted) for i, w in enumerate(own) if i not in lost] + ["zz"] * 30).encode()
            words = license_scan.WordHashes([text], license_scan._SEPARATOR).hash
            best = max(len(license_scan.align(index.words[t], words, d, 12)) for d in range(15, 45)) / m
            got = [x["coverage"] for x in license_scan.scan([text], index)[0] if x["license"] == name]
            missed += best >= 0.8 and got != [best]
    assert missed == 0


def test_license_query_shape(spark):
    rows = docs(spark, [(1, "Licensed under CC BY-NC 4.0.", "en"), (None, None, None), (1, "é Released under the MIT License.", "en")])
    got = license_scan.license_matches(rows).collect()
    assert [(r.doc_id, r.n_matches, r.licenses) for r in got] == [(1, 1, ["CC-BY-NC-4.0-line"]), (None, 0, []), (1, 1, ["MIT-line"])]
    assert (got[2].matches[0].start, got[2].matches[0].end) == (2, 32)
    assert license_scan.license_matches(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.license_matches(rows, {"big": "x" * (license_scan.MAX_TEMPLATE_BYTES + 1)})


# Quality --------------------------------------------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = [rng.choice("the and tree river stone house over under green".split()) for _ in range(rng.randint(5, 60))]
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return docs(spark, [(i, t, "en") for i, t, _ in rows]), spark.createDataFrame([(i, q, "x") for i, _, q in rows], "doc_id long, quality int, TEXT string"), rows


def test_quality_held_out_accuracy_and_shape(spark):
    table, labels, rows = labelled(spark)
    model = quality_classifier.fit(table, labels)
    got = quality_classifier.quality_scores(table, model).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 20 < len(held) < 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    odd = docs(spark, [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "word " * 300_000, "en")])
    scores = quality_classifier.quality_scores(odd, model).collect()
    assert len(scores) == 4 and scores[0].held_out and scores[0].score == scores[1].score
    assert quality_classifier.drop_low_quality(table, model).columns == table.columns
    assert abs(quality_classifier.drop_low_quality(table, model).count() - sum(truth.values())) <= 3


def test_quality_without_labels(spark):
    table, labels, _ = labelled(spark, 9)
    model = quality_classifier.fit(table, labels.limit(0))
    assert {r.score for r in quality_classifier.quality_scores(table, model).collect()} == {0.5}
    assert quality_classifier.quality_scores(table.limit(0), model).count() == 0


# Language -------------------------------------------------------------------------------------------------

VOCABULARY = {"en": "the and with over house river green", "de": "der und über haus fluss grün straße", "ru": "и дом река зелёный улица над"}


def sentence(rng, lang, n=20):
    return " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang), lang) for i in range(150) for lang in [sorted(VOCABULARY)[i % 3]]]
    return language_id.fit(docs(spark, [*rows, (None, "and", "xx"), (900, None, "yy"), (901, "text", None)]))


def test_language_scripts_and_letters(spark):
    rng = random.Random(12)
    latin = "the green house with river and field stone water under old".split()
    cyrillic = "дом река поле камень вода под старый зелёный мост лес".split()
    rows = [(i, " ".join(rng.choice(latin if i % 2 else cyrillic) for _ in range(30)), "en" if i % 2 else "ru") for i in range(40)]
    model = language_id.fit(docs(spark, rows))
    text = "the green house дом and river with house"
    spans = [(text[a:b], k) for a, b, k in language_id.language_spans(text, model)]
    assert spans == [("the green house", "en"), ("дом", "ru"), ("and river with house", "en")]
    # letters by category: presentation forms, an extension of Han, mathematical letters, iteration marks
    letters = ["ﻼ ﺎ", "\U00030000", "𝐀𝐁", "ℂℕ", "々々", "ª", "א"]
    none = ["١٢٣", "।", "12 34", "× ÷", "😀", "…", ""]
    got = {r.doc_id: r.lang_pred for r in language_id.languages(docs(spark, [(i, t, None) for i, t in enumerate(letters + none)]), model).collect()}
    assert all(got[i] in ("en", "ru") for i in range(len(letters))) and {got[i] for i in range(len(letters), len(got))} == {"und"}


def test_language_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "COUNTED_AT_ONCE", 2)
    words = {f"l{k}": f"{chr(97 + k) * 3}{chr(98 + k) * 2} {chr(99 + k) * 4}" for k in range(7)}
    rows = [(i, f"{words[f'l{i % 7}']} " * 5, f"l{i % 7}") for i in range(140)]
    model = language_id.fit(docs(spark, rows).coalesce(1))
    assert len(model.langs) == 7
    assert all(r.lang_pred == f"l{r.doc_id % 7}" for r in language_id.languages(docs(spark, rows), model).collect())
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 6)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs(spark, rows))


def test_language_held_out(spark, model):
    rng = random.Random(3)
    assert model.langs == ["de", "en", "ru"]
    rows = [(i, sentence(rng, lang, 5), lang) for i in range(60) for lang in [sorted(VOCABULARY)[i % 3]]]
    got = language_id.languages(docs(spark, rows), model).collect()
    assert [r.lang_pred for r in got] == [lang for _, _, lang in rows]


def test_language_spans_of_mixed_text(spark, model):
    text = "the green house and river 123 дом над река и улица der grün fluss und straße haus"
    spans = language_id.language_spans(text, model)
    assert [s[2] for s in spans] == ["en", "ru", "de"]
    assert text[spans[1][0] : spans[1][1]] == "дом над река и улица"
    odd = docs(spark, [(1, text, None), (2, None, None), (3, "", None), (4, "123 !!! %%", None), (5, "ξένος", None), (6, "the " * 100_000, None), (None, "и", None)])
    got = language_id.languages(odd, model, spans=True).collect()
    assert [r.lang_pred for r in got][1:4] == ["und"] * 3 and got[1].score == 0 and got[1].spans == []
    assert got[4].lang_pred != "und" and got[5].lang_pred == "en" and got[6].lang_pred == "ru" and got[6].held_out
    assert {r.doc_id for r in language_id.drop_unsure_language(odd, model).collect()} == {1, 5, 6, None}


def test_language_stage_drops_junk_and_unlearned_languages(spark, model):
    rng = random.Random(8)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60))
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    mixed = sentence(rng, "en", 40) + " " + sentence(rng, "ru", 40)
    rows = [(1, junk, None), (2, polish, None), (3, mixed, None), *((10 + i, sentence(rng, x, 60), x) for i, x in enumerate(sorted(VOCABULARY))), (4, "zzqx", None)]
    assert all(r.score > 0.3 for r in language_id.languages(docs(spark, rows), model).collect())
    assert {r.doc_id for r in language_id.drop_unsure_language(docs(spark, rows), model).collect()} == {3, 4, 10, 11, 12}


def test_language_stage_keeps_texts_with_keys(spark, model):
    rng = random.Random(9)
    text = sentence(rng, "en", 6) + " " + " ".join("%040x" % rng.getrandbits(160) for _ in range(4))
    assert language_id.drop_unsure_language(docs(spark, [(1, text, "en")]), model).count() == 1


def test_language_viterbi_equals_brute_force():
    rng = language_id.np.random.default_rng(5)
    score, first = rng.normal(size=(30, 3)), language_id.np.array([0, 0, 1, 13, 30])
    labels = language_id._viterbi(score, first, 1.5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = {k: (score[a, k], [k]) for k in range(3)} if b > a else {}
        for t in range(a + 1, b):
            best = {k: max((v + score[t, k] - 1.5 * (j != k), [*path, k]) for j, (v, path) in best.items()) for k in range(3)}
        value = sum(score[t, labels[t]] for t in range(a, b)) - 1.5 * sum(labels[t] != labels[t - 1] for t in range(a + 1, b))
        assert b == a or value == pytest.approx(max(best.values())[0])


def test_language_without_training(spark):
    empty = docs(spark, [(1, "text", None)])
    none = language_id.fit(empty)
    assert [r.lang_pred for r in language_id.languages(empty, none).collect()] == ["und"]
    assert language_id.languages(empty.limit(0), none).count() == 0


# Decontamination ------------------------------------------------------------------------------------------


def brute(text, items, window=13):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, passage in items:
        p = words(passage)
        n = min(window, len(p))
        for g in {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if p else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == g:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(i for i in found if i is not None), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, shard_bytes):
    rng = random.Random(6)
    vocabulary = ["Ab", "c", "dé", "9", "ÉX"]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 7, 13, 16, 27, 40])))) for i in range(24)]
    items += [("3", "repeated id c c c Ab"), (None, "a null id c"), ("n", None), ("99", items[4][1])]
    texts = [None, "", "!!", "Ab  c,dé-9", "x " * 50_000 + "repeated-ID c; C c aB" + " y" * 200]
    texts += [", ".join(rng.choice([*vocabulary, rng.choice(items)[1] or "c"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    table = docs(spark, [(i % 40, t, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id string, text string, DOC_ID string")
    got = decontaminate.contamination(table, bench, shard_bytes=shard_bytes).collect()
    want = [brute(t, items) for t in texts]
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == want
    spans = got[4].spans
    assert [texts[4][s.start : s.end] for s in spans][-1].endswith("aB")
    kept = decontaminate.drop_contaminated(table, bench, shard_bytes=shard_bytes)
    assert kept.columns == table.columns and kept.count() == sum(not w[3] for w in want)
    assert not any(r.contaminated for r in decontaminate.contamination(table, bench.limit(0)).collect())
    assert decontaminate.contamination(table.limit(0), bench).count() == 0


def test_automaton_equals_windows():
    rng = random.Random(9)
    for window in (1, 2, 5, 13):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))) for i in range(6)]
        machine = decontaminate.Automaton(items, window)
        for _ in range(60):
            words = []
            while len(words) < 80:
                source = rng.choice(items)[1].split()
                at = rng.randrange(len(source))
                words += source[at : at + rng.randint(1, 30)] + [rng.choice("abcd")] * rng.randint(0, 1)
            hit, found = set(), set()
            for item, text in items:
                source = text.split()
                size = min(window, len(source))
                windows = {tuple(source[i : i + size]) for i in range(len(source) - size + 1)}
                for i in range(len(words) - size + 1):
                    if tuple(words[i : i + size]) in windows:
                        hit.update(range(i, i + size))
                        found.add(item)
            spans, names = machine.scan([w.encode() for w in words])
            assert names == found and {i for a, b in spans for i in range(a, b)} == hit


def test_automaton_memory_grows_with_words_and_not_with_windows():
    code = """if True:
        import random, resource, sys
        from nestql.llm.decontaminate import Automaton
        rng = random.Random(1)
        words = ["w%d" % i for i in range(20000)]
        items = [(str(i), " ".join(rng.choice(words) for _ in range(200))) for i in range(1000)]
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        machine = Automaton(items, 13)
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / sum(len(t) for _, t in items))
    """
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, check=True)
    assert float(out.stdout) < 40


def test_quality_scores_do_not_depend_on_the_batch():
    rng = random.Random(2)
    weight = quality_classifier.np.random.default_rng(1).normal(size=quality_classifier.BUCKETS).astype("float32")
    texts = ["", " ", "a", "ab", "abc", "abcd", "a b", "", "one two three", "é", "\n\n", ""]
    alone = [quality_classifier.score_texts([t.encode()], weight, 0.3)[0] for t in texts]
    for _ in range(50):
        order = rng.sample(range(len(texts)), rng.randint(1, len(texts)))
        got = quality_classifier.score_texts([texts[i].encode() for i in order], weight, 0.3)
        assert [round(float(x), 9) for x in got] == [round(float(alone[i]), 9) for i in order]


def small_model():
    import numpy as np

    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32) for _ in range(2)]
    latin = 1 << language_id.SCRIPTS.index("Latin")
    return language_id.Model(["a", "b", "c"], *tables, np.array([latin] * 3), rng.normal(size=language_id.BUCKETS).astype(np.float32), language_id.letter_bits())


def test_language_does_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 3, 300]))).encode() for _ in range(200)]
    texts += [b"", b" 12 ", "при abc".encode()]
    model = small_model()
    alone = [(*language_id.predict_texts([t], model), *language_id.familiarity([t], model)) for t in texts]
    for chunk, part in [(1 << 21, 1 << 18), (5000, 700), (100, 5000)]:
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        monkeypatch.setattr(language_id, "PART", part, raising=False)
        langs, score = language_id.predict_texts(texts, model)
        sizes, means = language_id.familiarity(texts, model)
        assert langs == [x[0][0] for x in alone]
        assert list(score) == pytest.approx([x[1][0] for x in alone])
        assert list(sizes) == [x[2][0] for x in alone]
        assert list(means) == pytest.approx([x[3][0] for x in alone])


@pytest.mark.parametrize("judge", ["language", "familiarity", "quality"])
def test_judging_many_texts_takes_little_room(judge):
    import tracemalloc

    import numpy as np

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(350)).encode() for _ in range(2000)]
    model, weight = small_model(), np.ones(quality_classifier.BUCKETS, np.float32)
    run = {"language": lambda: language_id.predict_texts(texts, model), "familiarity": lambda: language_id.familiarity(texts, model), "quality": lambda: quality_classifier.score_texts(texts, weight, 0.0)}[judge]
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6
