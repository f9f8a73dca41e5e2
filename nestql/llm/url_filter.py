"""URL filter by host and path rules, with block decisions shared along redirects and canonical links.

All of it is DataFrame functions. A rule of a page's own host and path always decides that page, so an
explicit allow takes precedence over anything shared. A page that no rule fits is blocked if a url that is
equivalent to it, through any chain of redirects and canonical links, is blocked by a rule; else it is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_number(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Index of the longest rule that fits, the allowing one of two equally long; null if none does."""
    found = F.lit(None).cast("int")
    ranked = sorted(range(len(rules)), key=lambda i: (len(rules[i].host) + len(rules[i].path), rules[i].verdict == "allow", -i))
    for i in ranked:
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def _pick(number: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number) if values else F.lit(None).cast("string")


_FRONT, _PATH = r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def _once(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """rows with the column set to the value, which is computed there and once.

    The optimizer moves filters below a projection by writing the projection's expressions out in them, and again for each
    projection below, until they outgrow all memory; it does not move them below a generator.
    """
    return rows.select(*[c for c in rows.columns if c != column], F.explode(F.array(value)).alias(column))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    parts = F.split(path, "/")
    first = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
        first,
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    open_end = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) >= 0)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(path)


def _normal(urls: DataFrame, column: str) -> DataFrame:
    """urls with the column in normal form: no fragment or default port, scheme and host in lower case, a path of at least / without dot segments.

    What is no url of a host becomes null. Parts are columns of their own, so that each is computed once.
    """
    c, front, rest, cut_at = F.col(column), F.col("__front"), F.col("__rest"), F.col("__cut")
    others = [x for x in urls.columns if x != column]
    bare = urls.select(*others, F.regexp_replace(F.trim(c), r"(?s)#.*$", "").alias(column))
    split = bare.select(*others, column, F.translate(F.regexp_extract(column, _FRONT, 1), _UPPER, _LOWER).alias("__front"), F.length(F.regexp_extract(column, _FRONT, 1)).alias("__cut"))
    parts = split.select(*others, F.regexp_replace(F.regexp_replace("__front", r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1").alias("__front"), F.substr(c, cut_at + 1).alias("__rest"))
    paths = parts.select(*others, "__front", F.regexp_extract("__rest", r"(?s)^([^?]*)", 1).alias("__path"), "__rest")
    whole = F.concat(front, F.when(F.col("__path").startswith("/"), _without_dots(F.col("__path"))).otherwise(F.concat(F.lit("/"), F.col("__path"))), F.substr(rest, F.length("__path") + 1))
    return _once(paths, column, F.when(front != "", whole)).select(*others, column)


def _decoded(text: Column) -> Column:
    """Text with its numeric character references and the five that XML names decoded; &amp; last, as it gives what looks like others."""

    def one(part):
        digits = F.regexp_extract(part, r"^&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));?", 1)
        tens = F.regexp_extract(part, r"^&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));?", 2)
        code = F.when(digits != "", F.conv(digits, 16, 10)).otherwise(tens).try_cast("int")
        rest = F.regexp_replace(part, r"^&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", "")

        def char(x):
            """UTF-8 of a code point that is no surrogate."""
            tail = [F.lit(128) + F.shiftrightunsigned(x, n).bitwiseAND(F.lit(63)) for n in (12, 6, 0)]
            units = (
                F.when(x < 0x80, F.array(x))
                .when(x < 0x800, F.array(F.lit(192) + F.shiftrightunsigned(x, 6), tail[2]))
                .when(x < 0x10000, F.array(F.lit(224) + F.shiftrightunsigned(x, 12), *tail[1:]))
                .otherwise(F.array(F.lit(240) + F.shiftrightunsigned(x, 18), *tail))
            )
            return F.decode(F.unhex(F.array_join(F.transform(units, lambda u: F.lpad(F.hex(u), 2, "0")), "")), "UTF-8")

        usable = lambda x: (x >= 32) & (x <= 0x10FFFF) & ~x.between(0xD800, 0xDFFF)
        return F.get(F.transform(F.array(code), lambda x: F.when(usable(x), F.concat(char(x), rest)).otherwise(part)), F.lit(0))

    numeric = F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "(?=&#)"), one), "")).otherwise(text)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        numeric = F.regexp_replace(numeric, f"&{name};" + ("?" if name == "amp" else ""), char)
    return numeric


def _resolved(links: DataFrame, base: str, link: str) -> DataFrame:
    """links with the column `link` as an absolute url by the url in `base`; null if it is empty, only a fragment, or has another scheme."""
    others = [c for c in links.columns if c != link]
    parts = _once(links, link, _decoded(F.trim(F.col(link)))).select(
        *others,
        link,
        F.regexp_extract(base, _FRONT, 1).alias("__front"),
        F.regexp_extract(base, r"(?s)^(.*?:)//", 1).alias("__scheme"),
        F.regexp_extract(base, _PATH, 1).alias("__path"),
    )
    x, front, path = F.col(link), F.col("__front"), F.col("__path")
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    whole = (
        F.when((x == "") | x.startswith("#") | (front == ""), F.lit(None))
        .when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x)
        .when(x.startswith("//"), F.concat("__scheme", x))
        .when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(x.startswith("/"), F.concat(front, x))
        .when(x.startswith("?"), F.concat(front, path, x))
        .otherwise(F.concat(front, F.when(folder == "", F.lit("/")).otherwise(folder), x))
    )
    return _once(parts, link, whole).select(*others, link)


def _attribute(name: str) -> str:
    return rf"""(?<![\w-]){name}\s*=\s*(?:"\s*([^"]*)"|'\s*([^']*)'|([^"'\s>]+))"""


_CANONICAL = r"""(?is)<link\b(?=[^>]*(?<![\w-])rel\s*=\s*["']?[^"'>]*(?<![\w-])canonical(?![\w-]))[^>]*>"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*(?<![\w-])http-equiv\s*=\s*["']?refresh(?![\w-]))[^>]*>"""


def _value(tag: Column, name: str) -> Column:
    pattern = "(?is)" + _attribute(name)
    return F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (src, dst) of normal urls: from each page to its canonical links and to its refresh redirects.

    What stands in comments, scripts and styles is no link. Links are resolved by the page's base element, if it has one, and
    else by its url.
    """
    page = F.col(html_col)
    found = pages.where(F.col(url_col).isNotNull() & page.rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), page.alias("html"))
    head = _once(found, "html", F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea)\b.*?(?:</\1\s*>|\z)", ""))
    tags = head.select(
        F.col("url").alias("src"),
        F.col("url").alias("page"),
        _value(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href").alias("base"),
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), lambda t: _value(t, "href")),
                F.transform(
                    F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(_value(t, "content"), r"""(?is)url\s*=\s*["']?([^"']*)""", 1)
                ),
            )
        ).alias("dst"),
    ).where("dst <> ''")
    based = _once(_resolved(tags, "page", "base"), "base", F.coalesce("base", "page"))
    urls = _normal(_normal(_resolved(based, "base", "dst").select("src", "dst"), "src"), "dst")
    return urls.where("src is not null and dst is not null and src <> dst")


def url_verdicts(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of pages; `redirects` may add rows (src, dst) of urls.

    A null url, or one without ://, has an empty host and path, fits no rule and has no aliases, so it is
    allowed. Rows are judged one by one: repeats stay repeats. A null page has no links. Other columns are ignored.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(_normal(_normal(redirects.select("src", "dst"), "src"), "dst"))
    alias = connected_components(edges)
    verdicts = [r.verdict for r in rules]
    blocked = (
        alias.where(_pick(rule_number(host_of(F.col("node")), path_of(F.col("node")), rules), verdicts) == "block").select("component").distinct()
    )
    tainted = alias.join(blocked, "component").select(F.col("node").alias("alias"), F.lit(True).alias("tainted"))
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(url_col).alias("alias"))
    # no url: a key of its own, equal to none
    judged = _normal(urls, "alias").withColumn("alias", F.coalesce("alias", F.col("id").cast("string"))).withColumn("number", rule_number(F.col("host"), F.col("path"), rules))
    return judged.join(tainted, "alias", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        _pick(F.col("number"), [r.host + r.path for r in rules]).alias("rule"),
        F.coalesce(_pick(F.col("number"), verdicts), F.when(F.col("tainted"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
