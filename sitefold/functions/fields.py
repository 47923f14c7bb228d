"""Fields in page text and HTML, as Spark expressions.

Patterns mean what RE2 means by them: word boundaries, digits and word characters are those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col

_W = "[0-9A-Za-z_]"
#: A word boundary of ASCII.
EDGE = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"

ZIP = f"{EDGE}(?:NL-)?[0-9]{{4}}\\s?[A-Z]{{2}}{EDGE}"
STREET = f"{EDGE}([- a-zA-ZÀ-ÿ]+\\s+[-_\\s0-9A-Za-z]{{1,9}})[-,|\\s]{{0,5}}"
NOISE = f"(?i){EDGE}(?:te|aan|gevestigd){EDGE}"
PHONE = f'(?is)t(?:el(?:efoon)?:|[.:\\s])[/;|&bnps\\s]{{0,4}}(["+|]?[-()|\\s0-9]{{9,15}}){EDGE}'
EMAIL = r"([-+._0-9A-Za-z]+@[-._0-9A-Za-z]{1,25}\.[-A-Za-z]{1,7})"
FAX = f"(?is){EDGE}f(?:ax(?:number)?)?{EDGE}[^+0-9]{{0,12}}(\\+?[0-9][-()\\s0-9]{{7,20}}){EDGE}"
KVK = f"(?is)k\\.?v\\.?k.{{0,40}}?({EDGE}[0-9]{{8}}{EDGE})|kamer van koophandel.{{0,50}}?({EDGE}[0-9]{{8}}{EDGE})"
VAT = f"(?is)(btw|vat)(.{{1,20}})({EDGE}NL\\s*[-._0-9]{{9,12}}\\s*[ .0-9B]{{0,5}}|{EDGE}NL{EDGE}[-._0-9B]+)"

# The word lists below are data that results depend on: existing corpora were made with just these.
UNLIKELY_ENDINGS = ("SA", "SD", "SS")
FILE_ENDINGS = ("avi", "doc", "docx", "gif", "jpeg", "jpg", "mov", "mp3", "mp4", "pdf", "png", "psd", "rtf", "tif", "tiff", "txt", "wav", "xls", "xlsx", "zip")
REPORT = "(?i)" + "|".join(sorted(["jaarrapport", "annual.?report", "jaar.?verslag", "jaarrekening", "investor", "financial.?results", "investeerder", "financiele.?rapportage", "boekhouding.?rapport", "financial.?performance"]))
NO_REPORT = "(?i)" + "|".join(sorted(["app", "test", "slim", "zoek", "CO2", "ZZP", "experience", "mailto", "studeren", "vertalen", "diensten", "freelancers", "asbestos", "privacy", "medewerker", "wat.?is", "website", "nieuwsbrief", "coronavirus", "opstellen", "algemene.?voorwaarden", "webshopp"]))
META_NAMES = frozenset(
    "author description encoding format-detection generator google-site-verification keywords robots theme-color viewport "
    "article:modified_time article:publisher msapplication-TileColor msapplication-TileImage "
    "og:description og:image og:image:height og:image:type og:image:width og:locale og:site_name og:title og:type og:url "
    "twitter:card twitter:data1 twitter:description twitter:image twitter:label1 twitter:title".split()
)


def _all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def zipcodes(text: Column | str) -> Column:
    """Zip codes, each once, in the order in which they come."""
    return F.array_distinct(F.filter(_all(text, ZIP), lambda z: ~F.right(z, F.lit(2)).isin(*UNLIKELY_ENDINGS)))


def _address(text: Column, code: Column) -> Column:
    at = F.instr(text, code)
    before = F.regexp_replace(F.substring(text, F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100))), r"\s+$", "")
    lines = F.split(before, "\n")
    last = F.element_at(lines, -1)
    # two cuts at most: the rest above stays in one piece
    above = F.when(F.size(lines) > 1, F.element_at(lines, -2))
    line = F.regexp_replace(F.when((F.length(last) < 5) & above.isNotNull(), above).otherwise(last), r"^\s+|\s+$", "")
    tidy = lambda m: F.regexp_replace(F.regexp_replace(m, NOISE, ""), r"^\s+|\s+$", "")
    found = F.filter(F.transform(_all(line, STREET, 1), tidy), lambda m: m != "")
    return F.when(at > 0, F.try_element_at(found, F.lit(-1)))


def addresses(text: Column | str, codes: Column | str) -> Column:
    """For each zip code the street and number before its first place in the text; those that have none give nothing."""
    t = _col(text)
    return F.filter(F.transform(_col(codes), lambda z: _address(t, z)), lambda a: a.isNotNull())


def phones(html: Column | str) -> Column:
    return F.array_distinct(_all(html, PHONE, 1))


def emails(html: Column | str) -> Column:
    return F.array_distinct(F.filter(_all(html, EMAIL, 1), lambda e: ~F.lower(F.element_at(F.split(e, r"\."), -1)).isin(*FILE_ENDINGS)))


def faxes(html: Column | str) -> Column:
    return F.array_distinct(F.transform(_all(html, FAX, 1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def kvk_numbers(text: Column | str) -> Column:
    """Chamber-of-commerce numbers; the pattern has two groups of which one is filled."""
    either = F.zip_with(_all(text, KVK, 1), _all(text, KVK, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    return F.array_distinct(F.filter(either, lambda x: x != ""))


def vat_numbers(text: Column | str) -> Column:
    return F.array_distinct(_all(text, VAT, 3))


def report_links(hrefs: Column | str, page: Column | str) -> Column:
    """Links to annual reports; root-relative ones are resolved."""
    from .urls import resolve_link

    good = F.filter(_col(hrefs), lambda h: h.rlike(REPORT) & ~h.rlike(NO_REPORT))
    return F.array_distinct(F.transform(good, lambda h: F.when(h.startswith("/"), resolve_link(_col(page), h, base="page")).otherwise(h)))
