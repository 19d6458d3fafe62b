"""URL and HTML expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_normalize(url: Column) -> Column:
    """Scheme, host without ``www.`` and path without one trailing slash; query, parameters and fragment are dropped."""
    parts = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:www\.)?([^/?#]*)([^?#;]*).*$"
    return F.regexp_replace(F.regexp_replace(url, parts, "$1://$2$3"), "/$", "")


def url_domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)


def url_valid(url: Column, blacklist=()) -> Column:
    """http or https and none of the substrings, whatever their case; null and empty are not valid."""
    ok = F.coalesce(url.rlike("^https?"), F.lit(False))
    for term in blacklist:
        ok = ok & ~F.contains(F.lower(url), F.lit(term.lower()))
    return ok


def url_is_pdf(url: Column, content_type: Column | None = None) -> Column:
    pdf = F.lower(url).endswith(".pdf")
    return pdf if content_type is None else pdf | F.coalesce(F.contains(content_type, F.lit("application/pdf")), F.lit(False))


def without_dots(url: Column) -> Column:
    """The URL with ``.`` and ``..`` segments of its path resolved; those above the root are dropped."""
    parts = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"
    origin, path, rest = (F.regexp_extract(url, parts, i) for i in (1, 2, 3))
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)
    shorter = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == "..", shorter(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail, rest)).otherwise(url)


def url_absolute(base: Column, href: Column) -> Column:
    """The link resolved against its page: absolute and scheme-relative ones as they are, others without dot segments."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z]+):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+((?:/[^/?#]*)*/)", 1)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), without_dots(F.concat(origin, href)))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", base)
        .otherwise(without_dots(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href)))
    )


def html_lang(html: Column, is_pdf: Column | None = None, english_only: bool = True) -> Column:
    """The declared language: the attribute, else the content-language header tag, else ``unknown-assumed-en``."""
    attr = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z-]+)", 1))
    meta = F.lower(F.regexp_extract(html, r"(?i)<meta[^>]*http-equiv=[\"']?content-language[\"']?[^>]*content=[\"']?([a-zA-Z-]+)", 1))
    found = F.when(attr != "", attr).when(meta != "", meta).otherwise("unknown-assumed-en")
    if not english_only:
        return F.lit("unknown")
    return found if is_pdf is None else F.when(is_pdf, "unknown").otherwise(found)


def language_kept(lang: Column) -> Column:
    return lang.startswith("en") | lang.isin("unknown", "unknown-assumed-en", "error")


def html_links(html: Column) -> Column:
    """The ``href`` of all ``a`` elements in page order, repeated ones too: quoted or not, tag and attribute in any case."""
    other = r"""(?:"[^"]*"|'[^']*'|[^>"'])*?"""
    found = F.regexp_extract_all(html, F.lit(rf"""(?i)<a(?=\s){other}\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    bare = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(found, lambda v: F.replace(bare(v), F.lit("&amp;"), F.lit("&")))


def md_links(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(r"\[.*?\]\((https?://[^\s\)\"]+)"), F.lit(1))
