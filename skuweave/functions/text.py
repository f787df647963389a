"""Text and URL functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What stripping takes off: F.trim() alone leaves tabs and line ends.
WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; the stroke of the Polish l stays."""
    return bind(c, _strip_accents)


def _strip_accents(c: Column) -> Column:
    guarded = F.translate(c, "łŁ", "\ue000\ue001")
    bare = F.java_method(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), guarded)
    # Text of single bytes has no accents; the reflective call is for the rest (and would make a null the word).
    return F.when(F.length(c) == F.octet_length(c), c).when(c.isNotNull(), F.translate(bare, "\ue000\ue001", "łŁ"))


def normalize(c: Column) -> Column:
    """Without accents, lower case, & as and, all but a-z and 0-9 as one space; null: empty."""
    plain = F.replace(F.lower(strip_accents(c)), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), F.lit(""))


def bind(c: Column, f) -> Column:
    """f of c with c computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_host(c: Column) -> Column:
    """Lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, URL, 2)), r"^www\.", "")


def canonical_url(c: Column) -> Column:
    """Scheme (https by default), host without www., path with single slashes; no query, fragment or last slash."""
    scheme = F.lower(F.regexp_extract(c, URL, 1))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    host = url_host(c)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, URL, 3), r";[^/]*$", ""), "/+", "/")
    asin = F.regexp_extract(path, r"(?i)(/dp/[A-Z0-9]{10})", 1)
    path = F.when(host.contains("amazon.") & path.contains("/dp/") & (asin != ""), asin).otherwise(path)
    path = F.regexp_replace(path, "/+$", "")
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.when(host != "", F.concat(F.lit("/"), path)).otherwise(path))
    joint = F.when((host != "") | (path == "") | path.startswith("/"), F.lit("://")).otherwise(F.lit(":"))
    return F.when(strip(c) != "", F.concat(scheme, joint, host, rooted))


def make_ref(url: Column, prefix: str = "P_SC_") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(url), 1, 8)))


def url_slug_name(c: Column) -> Column:
    """Words of the last path segment: extension and trailing number dropped, dashes and underscores as spaces."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_extract(c, URL, 3), "/+$", ""), "/"), -1)
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(last, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25"))
    stem = F.regexp_replace(F.regexp_replace(plain, r"(?i)\.(html?|php|aspx?)$", ""), r"[-_~]p?\d+$", "")
    return F.trim(F.regexp_replace(stem, r"[-_]+", " "))


def page_name(c: Column) -> Column:
    """A product's name from its page's address: the last segment without its extension and shop number, as words.

    ``details.php`` gives product and the number asked for; under 3 characters: null.
    """
    parts = F.filter(F.split(F.regexp_extract(c, URL, 3), "/"), lambda s: s != "")
    last = F.trim(F.url_decode(F.regexp_replace(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")))
    number = lambda key: F.regexp_extract(c, rf"[?&]{key}=([^&#]+)", 1)
    asked = F.coalesce(blank_to_null(number("artnr")), blank_to_null(number("art")))
    asked = F.btrim(F.url_decode(F.regexp_replace(asked, r"%(?![0-9A-Fa-f]{2})", "%25")), F.lit("+" + WHITE))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(?:html?|php)$", ""), r"(?i)~p\d+$", ""), r"(?i)-\d{5,7}(?:-l\d+)?$", "")
    slug = F.trim(F.regexp_replace(slug, "[^A-Za-z0-9]+", " "))
    by_number = F.when(asked != "", F.concat(F.lit("product "), asked))
    return F.when(F.lower(last).startswith("details.php"), by_number).when(F.length(slug) >= 3, slug)


def page_category(c: Column) -> Column:
    """The first three path segments but the last, without route markers, as a breadcrumb with spaces for dashes; else null."""
    parts = F.filter(F.split(F.regexp_extract(c, URL, 3), "/"), lambda s: s != "")
    named = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: ~s.isin("pdp", "shop", "produkt"))
    return blank_to_null(F.array_join(F.transform(F.slice(named, 1, 3), lambda s: F.trim(F.replace(s, F.lit("-"), F.lit(" ")))), " > "))


def first_brand(c: Column) -> Column:
    """The first word, if it looks like a brand: letters, digits and & + . - of it, two at least and one a letter."""
    word = F.regexp_replace(F.get(F.split(strip(c), r"\s+"), 0), r"[^A-Za-z0-9&+.\-]", "")
    fits = lambda w: F.when((F.length(w) >= 2) & w.rlike("[A-Za-z]") & ~F.lower(w).isin("www", "http", "https", "de", "at"), w)
    return bind(word, fits)


def url_category(c: Column) -> Column:
    """Path segments but the last as a breadcrumb."""
    path = F.regexp_replace(F.regexp_extract(c, URL, 3), "/+$", "")
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), " > ")


def clean_name(c: Column) -> Column:
    """Without a retailer's name after a bar or dash."""
    return F.trim(F.regexp_replace(c, r"(?i)\s*[|\-]\s*(electronic4you|expert|cyberport|e-tec|amazon|mediamarkt).*$", ""))


def html_title(c: Column) -> Column:
    return blank_to_null(strip(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


# A shop's name at the end of a title, and titles of pages that block readers.
TITLE_SUFFIX = r"(?i)\s*[|\-]\s*(electronic4you|mediamarkt|expert\.at|cyberport|e-tec|amazon).*$"
BLOCKED_TITLE = "(?i)access denied|attention required|forbidden|just a moment|cloudflare|captcha|verify"


def clean_title(title: Column) -> Column:
    """Without the shop's name at its end and dashes and bars around; null for empty titles and those of block pages."""
    bare = F.btrim(F.regexp_replace(title, TITLE_SUFFIX, ""), F.lit(" -|\t"))
    return bind(bare, lambda t: F.when((t != "") & ~t.rlike(BLOCKED_TITLE), t))


# Prices: null unless within bounds.
def clean_price(c: Column) -> Column:
    p = c.try_cast("double")
    return F.when((p > 10) & (p < 50_000), F.round(p, 2))


def coerce_price(c: Column) -> Column:
    """A number with European separators, with or without euros: a dot before three digits goes, a comma is the point."""
    bare = strip(F.regexp_replace(c, "\u00a0|€|EUR", ""))
    p = F.replace(F.regexp_replace(bare, r"\.(?=\d{3})", ""), F.lit(","), F.lit("."))
    return bind(F.when(p.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), p.try_cast("double")), lambda x: F.when((x > 0.5) & (x < 50_000), F.round(x, 2)))


# Amounts in running text, in the order they are tried; any letter of EUR counts as the sign.
AMOUNTS = [r"(?i)(\d{1,3}(?:\.\d{3})+,\d{2})\s*[€EUR]", r"(?i)(\d{1,4},\d{2})\s*[€EUR]", r"(?i)[€EUR]\s*(\d{1,4}(?:[.,]\d{1,2})?)"]


def price_from_text(c: Column) -> Column:
    """The first amount of a text, by the first of AMOUNTS that finds one within bounds."""
    return F.coalesce(*[coerce_price(blank_to_null(F.regexp_extract(c, p, 1))) for p in AMOUNTS])
