"""Web pages as expressions: visible blocks, title, description, headings and links of an HTML text.

A page is read by a few regular expressions inside the JVM. Comments, declarations and the content of scripts, styles and
the like are dropped first; what is left of an element that is never closed goes with it. An attribute's value holds no
``>``, an anchor ends at the next ``</a>``.
"""

from __future__ import annotations

import html.entities
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions.urls import bare_host

#: Elements without visible text, and elements that end a block (fixed values).
SKIPPED = ("script", "style", "noscript", "svg", "template", "iframe")
BLOCKS = ("p", "li", "h1", "h2", "h3", "h4", "td", "dd", "dt", "blockquote", "figcaption", "section", "article", "div", "br")

_DROPPED = r"(?is)<!--.*?(-->|\z)|" + "|".join(rf"<{t}\b[^>]*>.*?(</{t}\s*>|\z)" for t in SKIPPED)
_TITLE = r"(?is)<title\b[^>]*>(.*?)(</title\s*>|\z)"
_BREAK = rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>"
_TAG = r"(?s)</?[A-Za-z!][^>]*>"
_REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def shown(text: Column) -> Column:
    """An HTML text without comments and without elements that show nothing; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _DROPPED, "")


def decoded(text: Column) -> Column:
    """Character references as characters; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for n, point in sorted(html.entities.name2codepoint.items()) for x in (n, chr(point))])
    point = lambda digits, base: F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&(.*);$", 1)
        valid = lambda digits, base: F.conv(digits, base, 10).cast("decimal(20,0)").between(1, 0x10FFFF)
        decimal, hexadecimal = F.substring(name, 2, 20), F.substring(name, 3, 20)
        known = F.when(name.rlike("^#[0-9]{1,9}$") & valid(decimal, 10), point(decimal, 10)).when(name.rlike("^#[xX][0-9a-fA-F]{1,7}$") & valid(hexadecimal, 16), point(hexadecimal, 16)).when(name != "", F.try_element_at(names, name))
        return F.coalesce(known, piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one), "")).otherwise(text)


def tidy(text: Column) -> Column:
    """Without tags, references decoded, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(text, _TAG, "")), r"[\s\u00A0]+", " "))


def title(seen: Column) -> Column:
    """The first title of a ``shown`` text."""
    return tidy(F.regexp_extract(seen, _TITLE, 1))


def blocks(seen: Column, least: int = 3) -> Column:
    """The blocks of visible text of a ``shown`` text in order, each once; those under ``least`` characters are dropped."""
    body = F.regexp_replace(F.regexp_replace(seen, _TITLE, ""), _BREAK, "\u0001")
    return F.array_distinct(F.filter(F.transform(F.split(body, "\u0001"), tidy), lambda b: F.length(b) >= least))


def headings(seen: Column, most: int = 20) -> Column:
    """The first headings of levels 1 to 3, empty ones left out."""
    found = F.regexp_extract_all(seen, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"), F.lit(1))
    return F.slice(F.filter(F.transform(found, tidy), lambda h: h != ""), 1, most)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag: quoted or bare; empty where it is absent."""
    value = lambda k: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", k)
    return decoded(F.concat(value(2), value(3), value(4)))


def meta(seen: Column, names: Sequence[str]) -> Column:
    """The last non-empty content of a meta element with the first of ``names`` (name or property) that has one, else empty."""
    tags = F.transform(F.regexp_extract_all(seen, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.struct(F.lower(F.coalesce(F.nullif(attribute(t, "name"), F.lit("")), attribute(t, "property"))).alias("name"), F.trim(attribute(t, "content")).alias("content")))
    one = lambda n: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(tags, lambda t: (t["name"] == n) & (t["content"] != "")), lambda t: t["content"])), -1)
    out = F.lit("")
    for n in reversed(names):
        out = F.coalesce(F.nullif(one(n), F.lit("")), out)
    return out


def links(seen: Column) -> Column:
    """Array of struct(href, anchor): every anchor with an address, in order."""
    found = F.transform(F.regexp_extract_all(seen, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0)), lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1), "href").alias("href"), tidy(a).alias("anchor")))
    return F.filter(found, lambda x: x["href"] != "")


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what would leave the root stays there."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """An address as seen from the page at ``base``, without its fragment."""
    at = lambda p: F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)(//[^/?#]*)?([^?#]*)", p)
    link = F.substring_index(F.trim(href), "#", 1)
    path, query = F.substring_index(link, "?", 1), F.regexp_extract(link, r"(?s)^[^?]*(\?.*)$", 1)
    origin, folder = F.concat(at(1), at(2)), F.regexp_replace(at(3), "[^/]*$", "")
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    return (
        F.when(link == "", F.substring_index(base, "#", 1))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(at(1), link))
        .when(path == "", F.concat(origin, at(3), query))
        .otherwise(F.concat(origin, _plain_path(rooted), query))
    )


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, description, headings, blocks, links (array of struct(href, anchor)) of every row of ``pages``
    (page_id, url, html). A null html has none of them; repeated rows are read each. Other columns are not returned."""
    seen = pages.select("page_id", "url", shown(F.col("html")).alias("_seen"))
    of = F.col("_seen")
    return seen.select(
        "page_id", "url", F.coalesce(F.nullif(title(of), F.lit("")), meta(of, ["og:title"])).alias("title"), meta(of, ["description", "og:description"]).alias("description"),
        headings(of).alias("headings"), blocks(of).alias("blocks"), links(of).alias("links"),
    )


def site_links(read: DataFrame, hints: Sequence[str], k: int = 3) -> DataFrame:
    """page_id, link, score, rank: the ``k`` links of a page to its own site whose path or anchor has most of ``hints``.

    Links to the page itself and without a hint are left out; ties go to the shorter address, then to the smaller. A page
    has as many links as it has anchors, which bounds its group.
    """
    rows = read.select("page_id", "url", F.explode("links").alias("l")).select("page_id", "url", resolve(F.col("url"), F.col("l.href")).alias("link"), F.col("l.anchor").alias("anchor"))
    slashless = lambda c: F.regexp_replace(c, "/+$", "")
    same = (bare_host(F.col("link")) == bare_host(F.col("url"))) & (slashless(F.col("link")) != slashless(F.col("url")))
    blob = F.lower(F.concat(F.regexp_extract("link", r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit(" "), F.col("anchor")))
    score = sum((F.contains(blob, F.lit(h)).cast("long") for h in hints), F.lit(0).cast("long"))
    best = rows.where(same).withColumn("score", score).where("score > 0").groupBy("page_id", "link").agg(F.max("score").alias("score"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), F.length("link"), "link")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_url(text: Column) -> Column:
    """A url where a user's text looks like one, with https where no scheme is given; else null."""
    t = F.trim(text)
    bare = t.rlike(r"(?i)^(https?://)?([\p{L}\p{N}_\-]+\.)+[a-z]{2,}(/\S*)?$")
    return F.when(bare, F.when(F.lower(t).rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t)))
