"""Main text of HTML pages by two passes over their blocks.

The first pass splits a page into blocks and decides them: what stands in a boilerplate container is out;
else length, stop-word density and link density say good, bad or ambiguous. The second pass gives each
ambiguous block the label of its nearest decided neighbours. Kept blocks are never shortened.

Stop words are known of four languages. On a page that none of them fits, length and link density decide alone; on
a page of several languages, blocks in one without a list are still taken for bad.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of some languages.
STOP_WORDS = {
    "en": "the of and to in is was it for with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may then do first any my now such like our over me even most made after also".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette aux ou mais comme on leur sa ses nous vous y été être fait elle deux même ces entre sans".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}
_STOPS = {k: frozenset(v) for k, v in STOP_WORDS.items()}

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_RAW = frozenset("script style noscript template textarea svg math iframe object select button title head audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT_TAGS = frozenset("nav footer aside form menu dialog".split())
_MAIN_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id and role attributes that mean boilerplate, alone or as a word of a compound name.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget complementary contentinfo alert alertdialog tags".split()
)
#: First and last words of compound names that tell of a state, a layout or a whole page (has-sidebar, no-comments, search-page).
_STATE_FIRST = frozenset("has no not with without is hide show overflow".split())
_STATE_LAST = frozenset("layout page template article story main enabled disabled open closed on off active visible theme support".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

GOOD, BAD, SHORT, NEAR = 1, 0, 2, 3


def _names_out(names: str) -> bool:
    for name in names.split():
        if name.lower() in _OUT_WORDS or name == "hidden":
            return True
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
        if len(words) > 1 and words[0] not in _STATE_FIRST and words[-1] not in _STATE_LAST and not _OUT_WORDS.isdisjoint(words):
            return True
    return False


def _says_out(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if "display:none" in value.lower().replace(" ", ""):
                return True
        elif name != "aria-hidden" and _names_out(value):
            return True
    return False


class _Open:
    """The open containers, innermost last, each with whether it or one around it is boilerplate, and marks the article."""

    def __init__(self):
        self.stack: list[list] = []  # tag, boilerplate by its tag, by its attributes; the same of all around it; main of all
        self.depth: dict[str, int] = {}
        self.named = 0  # containers that are boilerplate by their attributes

    def push(self, tag: str, by_tag: bool, by_name: bool, main: bool) -> None:
        self.stack.append([tag, by_tag, by_name, self.out or by_tag or by_name, self.main or main])
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.named += by_name

    def pop(self) -> str:
        tag, _, by_name, _, _ = self.stack.pop()
        self.depth[tag] -= 1
        self.named -= by_name
        return tag

    def close(self, tag: str) -> bool:
        """Close the innermost container of this tag and all in it, if there is one."""
        if not self.depth.get(tag):
            return False
        while self.pop() != tag:
            pass
        return True

    def forgive(self) -> None:
        """Judge the open containers by their tags alone."""
        if self.named:
            out = False
            for entry in self.stack:
                out = out or entry[1]
                entry[2], entry[3] = False, out
            self.named = 0

    @property
    def last(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    @property
    def out(self) -> bool:
        return bool(self.stack) and self.stack[-1][3]

    @property
    def main(self) -> bool:
        return bool(self.stack) and self.stack[-1][4]


class Block:
    __slots__ = ("text", "linked", "links", "said", "out", "main", "heading", "item")

    def __init__(self, text, linked, links, said, out, main, heading, item):
        self.text, self.linked, self.out, self.main, self.heading, self.item = text, linked, out, main, heading, item
        self.links, self.said = links, said  # how many links hold text; share of the letters and digits outside them


def blocks(page: str, forgiving: bool = False) -> list[Block]:
    """The page's blocks in order: text with references decoded and white space made single, and what is known of each.

    If `forgiving`, the containers around an element that marks an article are judged by their tags and not by their names.
    """
    found: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    links = 0
    around = _Open()
    in_link = fresh = False
    heading = item = False

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked, said = 0, 1.0
                if link_parts:
                    in_links = " ".join(html.unescape("".join(link_parts)).split())
                    linked = len(in_links)
                    said = 1 - sum(map(str.isalnum, in_links)) / max(1, sum(map(str.isalnum, text)))
                found.append(Block(text, linked, max(links, linked > 0), said, around.out, around.main, heading, item))
            parts.clear()
            link_parts.clear()
            links = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                link_parts.append(page[at:stop])
                if fresh and not page[at:stop].isspace():
                    links, fresh = links + 1, False
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW and not closing:
            if tag == "head":  # its end tag may be missing
                close = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                at = close.end() if close else at
            elif not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "a":
            in_link = fresh = not closing
        elif tag == "br" or tag in ("td", "th"):
            parts.append(" ")
        if tag not in _BLOCK:
            if not closing and attributes and tag not in _VOID and tag != "a" and _says_out(attributes):
                flush()
                around.push(tag, False, True, False)
            elif closing and around.depth.get(tag):
                flush()
                around.close(tag)
            continue
        flush()
        in_link = in_link and tag in ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6")
        if tag in _VOID:
            continue
        if tag in _HEADINGS:
            heading = not closing
        elif tag in ("p", "div", "li"):
            heading = False
        if tag in ("li", "dt", "dd"):
            item = not closing
        elif tag in ("ul", "ol", "dl"):
            item = False
        if closing:
            around.close(tag)
        elif tag not in ("p", "li", "dt", "dd", "tr"):
            if tag in _MAIN_TAGS and forgiving:
                around.forgive()
            by_name = tag not in ("html", "body", "article", "main") and bool(attributes) and _says_out(attributes)
            around.push(tag, tag in _OUT_TAGS or tag == "header" and not around.main, by_name, tag in _MAIN_TAGS)
        else:
            while around.last == tag:  # end tags may be missing
                around.pop()
            if attributes and _says_out(attributes):
                around.push(tag, False, True, False)
    flush()
    return found


def stop_density(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return max(sum(w in s for w in words) for s in _STOPS.values()) / len(words) if words else 0.0


def language_fits(items: list[Block], short: int = 70, low: float = 0.15) -> bool:
    """Whether a list of stop words fits what the page says in its blocks of some length outside boilerplate and links."""
    return stop_density(" ".join(b.text for b in items if not b.out and len(b.text) >= short and b.linked <= 0.2 * len(b.text))) >= low


def link_lists(items: list[Block], least: int = 3, most_said: float = 0.1) -> list[bool]:
    """Whether each block is nothing but links, at least `least` of them by itself or together with the list items beside it."""
    found = []
    for listed, run in groupby(items, lambda b: b.item and not b.out and b.links > 0 and b.said <= most_said):
        run = list(run)
        many = listed and sum(b.links for b in run) >= least
        found += [many or b.links >= least and b.said <= most_said for b in run]
    return found


def classify(b: Block, listed: bool, fits: bool = True, max_link: float = 0.5, short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.25) -> int:
    """The first pass; `listed` tells whether the block is part of a list of links, `fits` whether stop words can tell.

    In an element that marks the article such lists are out; its other linked blocks and its short ones are in doubt.
    """
    if b.out:
        return BAD
    density = b.linked / len(b.text)
    if density > max_link:
        return SHORT if b.main and (b.heading or not listed) else BAD
    if b.heading or len(b.text) < short:
        return BAD if density > 0.2 and not b.main else SHORT
    if not fits:
        return GOOD if density <= 0.2 else NEAR
    stops = stop_density(b.text)
    if b.main:
        return GOOD if stops >= low else NEAR
    if stops >= high:
        return GOOD if len(b.text) > long else NEAR
    return NEAR if stops >= low else BAD


def resolve(labels: list[int], items: list[Block]) -> list[bool]:
    """The second pass: each block in doubt takes the label of its nearest decided neighbours."""
    n = len(labels)
    decided = [x in (GOOD, BAD) for x in labels]
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        # boilerplate containers beside an article say nothing of the blocks inside it
        if decided[i] and (labels[i] == GOOD or not items[i].out):
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        if decided[i] and (labels[i] == GOOD or not items[i].out):
            last = i
    keep = []
    for i in range(n):
        if decided[i]:
            keep.append(labels[i] == GOOD)
            continue
        p, q = before[i], after[i]
        near = [labels[x] == GOOD for x in (p, q) if x >= 0]
        if not near:
            keep.append(items[i].main or labels[i] == NEAR)
        elif all(near) or items[i].main and any(near):
            keep.append(True)
        elif not any(near):
            keep.append(items[i].main)
        elif items[i].heading:
            keep.append(q >= 0 and labels[q] == GOOD)
        elif i - p != q - i:
            keep.append(labels[p if i - p < q - i else q] == GOOD)
        else:
            keep.append(labels[i] == NEAR)
    return keep


def _kept(items: list[Block]) -> str:
    if any(b.main and not b.out for b in items):  # a page that marks its article has it there alone
        items = [b for b in items if b.main]
    fits = language_fits(items)
    keep = resolve([classify(b, listed, fits) for b, listed in zip(items, link_lists(items), strict=True)], items)
    return "\n\n".join(b.text for b, k in zip(items, keep, strict=True) if k)


def main_text(page: str | None) -> str:
    items = blocks(page or "")
    text = _kept(items)
    if not text and any(b.main for b in items):  # a name has put the whole article out
        text = _kept(blocks(page or "", forgiving=True))
    return text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id, url, text, n_chars) for each row of pages; n_chars counts code points.

    Null and empty pages, and pages without a main text, give an empty text. Rows are treated one by one,
    whole: repeats stay repeats, and other columns are ignored. Pages are never shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string"))
    return plain.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
