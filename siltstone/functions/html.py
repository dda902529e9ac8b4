"""HTML expressions for well-formed markup: title, language, headings, anchors. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>"""


def unescape(text: Column) -> Column:
    """The named references that plain pages use; `&amp;` last, so that no text is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def without_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, r"<[^>]*>", "")


def title(markup: Column) -> Column:
    return collapse(unescape(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def language(markup: Column) -> Column:
    return collapse(F.regexp_extract(markup, r"""(?is)<html[^>]*?\slang\s*=\s*"([^"]*)\"""", 1))


def description(markup: Column) -> Column:
    return collapse(unescape(F.regexp_extract(markup, r"""(?is)<meta\s[^>]*?name\s*=\s*"description"[^>]*?content\s*=\s*"([^"]*)\"""", 1)))


def headings(markup: Column) -> Column:
    """array<struct<level, text>> of h1 to h6 in document order, blank ones dropped."""
    found = F.regexp_extract_all(markup, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    told = F.transform(found, lambda h: F.struct(F.lower(F.substring(h, 2, 2)).alias("level"), collapse(unescape(without_tags(h))).alias("text")))
    return F.filter(told, lambda h: h["text"].isNotNull())


def anchors(markup: Column) -> Column:
    """array<struct<href, rel>> of every anchor with an address, in document order."""
    found = F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(0))
    return F.transform(found, lambda a: F.struct(
        unescape(F.regexp_extract(a, r"""(?is)href\s*=\s*"([^"]*)\"""", 1)).alias("href"),
        F.regexp_extract(a, r"""(?is)\srel\s*=\s*"([^"]*)\"""", 1).alias("rel"),
    ))


def nofollow(rel: Column) -> Column:
    return F.array_contains(F.split(F.lower(rel), r"\s+"), "nofollow")


def base_href(markup: Column) -> Column:
    """The address of the first base element, or null."""
    return F.nullif(F.regexp_extract(markup, r"""(?is)<base\s[^>]*?href\s*=\s*"([^"]*)\"""", 1), F.lit(""))
