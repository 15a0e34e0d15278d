"""Text and URL functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_price(text: Column, sign: str = "₽") -> Column:
    """The digits before the first currency sign as a whole number; NULL without digits."""
    digits = F.regexp_replace(F.substring_index(text, sign, 1), r"[^0-9]", "")
    return F.when(digits != "", digits).try_cast("bigint")


def first_digits(text: Column) -> Column:
    """The first run of digits, or empty."""
    return F.regexp_extract(text, r"(\d+)", 1)


def squeeze(text: Column, most: int = 220) -> Column:
    """White space runs as one blank, trimmed and cut at the 220 characters that a name holds (a fixed value)."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def slugify(text: Column) -> Column:
    """Lower case; runs of white space and hyphens become one hyphen; other signs go."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def default_slug(slug: Column, name: Column) -> Column:
    """A given slug, or the name's where it is NULL or empty."""
    return F.coalesce(F.nullif(slug, F.lit("")), slugify(name))


def product_slug(name: Column, vendor_code: Column, url: Column) -> Column:
    """Name (420), vendor code (80) and the URL's digest (12), joined by hyphens, 500 characters at most (fixed values)."""
    parts = [F.substring(slugify(name), 1, 420), F.substring(slugify(vendor_code), 1, 80), F.substring(F.sha2(url, 256), 1, 12)]
    return F.substring(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "-"), 1, 500)


def proxy_parts(url: Column) -> Column:
    """scheme (default http), host and port (default 3128) of a proxy URL."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    port = F.regexp_extract(full, r"^[^/]*//[^/]*:(\d+)", 1)
    return F.struct(
        F.coalesce(F.try_parse_url(full, F.lit("PROTOCOL")), F.lit("http")).alias("scheme"),
        F.try_parse_url(full, F.lit("HOST")).alias("host"),
        F.when(port != "", port.cast("int")).otherwise(F.lit(3128)).alias("port"),
    )


def local_decimal(text: Column, nominal: Column) -> Column:
    """A number with a decimal comma, per one unit; a missing value is 0, a missing nominal 1."""
    value = F.coalesce(F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(14,4)"), F.lit(0).cast("decimal(14,4)"))
    n = F.coalesce(nominal.try_cast("decimal(10,0)"), F.lit(1).cast("decimal(10,0)"))
    return (value / F.when(n == 0, 1).otherwise(n)).cast("decimal(10,4)")


#: Two phrases that a block notice holds together.
_NOTICE = ("доступ к сайту", "запрещ")


def blocked_page(title: Column, html: Column) -> Column:
    """Whether a page is a refusal: by its title, by the start of its text, or by a block notice in its first 12,000 characters (fixed values: the
    notice stands at a page's head, and what a page says further down is no refusal)."""
    t = F.coalesce(title, F.lit(""))
    low = F.lower(F.concat(t, F.lit("\n"), F.substring(F.coalesce(html, F.lit("")), 1, 12_000)))
    has = lambda c, s: F.contains(c, F.lit(s))
    return (
        has(t, "403") | has(F.substring(low, 1, 800), "403 error") | has(F.lower(t), "forbidden") | has(low, "http 403")
        | (has(low, _NOTICE[0]) & has(low, _NOTICE[1]))
    )


def search_terms(query: str) -> list[str]:
    """The terms of a search: what stands between blanks and commas."""
    return query.replace(",", " ").split()


def matches_search(query: str, *fields: Column) -> Column:
    """Every term of the query is in some field, in any case."""
    cond = F.lit(True)
    for term in search_terms(query):
        some = F.lit(False)
        for f in fields:
            some = some | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(term.lower()))
        cond = cond & some
    return cond
