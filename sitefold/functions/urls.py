"""URL columns. Everything is a Spark expression, so filters on it reach below later Python stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B, with a scheme as that RFC's section 3.1 spells it; a dot matches line ends too.
SPLIT = r"(?s)^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
#: Groups 2, 4, 5, 7 and 9 of SPLIT, each read no further than it has to be.
_SCHEME, _AUTHORITY, _PATH = r"^([A-Za-z][A-Za-z0-9+.\-]*):", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY, _FRAGMENT = r"^[^?#]*\?([^#]*)", r"(?s)^[^#]*#(.*)"
#: Prefixes of links that name no page.
NO_PAGE = r"(?i)^(mailto|mail|tel|javascript):"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def authority(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _AUTHORITY, 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _PATH, 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _QUERY, 1)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _FRAGMENT, 1)


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def with_scheme(url: Column | str) -> Column:
    """The seed as a URL: https:// in front unless it has a scheme; null for blank ones and those that name no page."""
    u = _trimmed(_col(url))
    bare = F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", ""))
    return F.when((u == "") | u.rlike(NO_PAGE), None).when(scheme(u) == "", bare).otherwise(u)


def normalize_base_url(url: Column | str) -> Column:
    """with_scheme() under the name that crawls know it by; the fragment stays and the host isn't checked."""
    return with_scheme(url)


def normalize_source_url(url: Column | str) -> Column:
    """A seed URL in one form: http or https, with a host, without fragment; null if it can't be one."""
    u = with_scheme(url)
    q = query(u)
    whole = F.concat(scheme(u), F.lit("://"), authority(u), path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(scheme(u).isin("http", "https") & (authority(u) != ""), whole)


def clean_url(url: Column | str) -> Column:
    """Identity of a URL within a crawl: schemes and "www." go wherever they stand, also inside a query."""
    return F.regexp_replace(_col(url), r"https?://(?:www\.)?|www\.", "")


def url_extension(url: Column | str) -> Column:
    """Lower-case file extension of the path without its dot, "" if there is none. Dot files have none."""
    name = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def strip_query_and_fragment(url: Column | str) -> Column:
    return F.regexp_replace(_col(url), r"(?s)[?#].*$", "")


def _dots_removed(p: Column) -> Column:
    """A path without "." and ".." segments."""
    parts = F.split(p, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(p)


def resolve_link(page: Column | str, href: Column | str, base: str = "site") -> Column:
    """A link's URL. base "site": relative links hang on the site's root, whatever the page; "page": on the page's folder."""
    p, h = _col(page), F.trim(_col(href))
    root = F.concat(scheme(p), F.lit("://"), authority(p))
    folder = F.lit("/") if base == "site" else F.coalesce(F.nullif(F.regexp_extract(path(p), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    rest = F.regexp_replace(h, r"(?s)^[^?#]*", "")
    own = F.regexp_replace(h, r"(?s)[?#].*$", "")
    joined = F.when(own == "", F.lit("") if base == "site" else path(p)).when(own.startswith("/"), _dots_removed(own)).otherwise(_dots_removed(F.concat(folder, own)))
    return F.when(scheme(h) != "", h).when(h.startswith("//"), F.concat(scheme(p), F.lit(":"), h)).otherwise(F.concat(root, joined, rest))


def keeps_host(page: Column | str, href: Column | str) -> Column:
    """Whether a link's URL has the page's authority because it names none, whatever the base: known without resolving it."""
    h = F.trim(_col(href))
    return (scheme(page) != "") & (authority(page) != "") & (scheme(h) == "") & ~h.startswith("//")


def page_path(domain: Column | str, url: Column | str, session_date: Column | str) -> Column:
    """Where a page is archived: domain / host without "www." / date / last part of the URL. URLs with one last part share it."""
    u = _col(url)
    leaf = F.element_at(F.split(F.regexp_replace(u, "/$", ""), "/"), -1)
    named = F.when(leaf == "", "index").otherwise(leaf)
    return F.replace(F.concat_ws("/", _col(domain), F.regexp_replace(authority(u), r"www\.", ""), _col(session_date), named), F.lit(" "), F.lit("_"))
