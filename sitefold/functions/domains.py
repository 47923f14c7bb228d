"""Registered domains by the public suffix list, as Spark expressions without a join."""

from __future__ import annotations

import functools
import os
import zipfile
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col, authority
from .urls import let as _let

_SYSTEM_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"
#: Both have to be in a list for it to be taken as one.
_MARKS = ("===BEGIN ICANN DOMAINS===", "===END ICANN DOMAINS===")


@dataclass(frozen=True)
class SuffixRules:
    """Rules of a public suffix list: plain ones, parents of "*." and exceptions."""

    plain: frozenset[str]
    wild: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()


def parse_rules(text: str, private: bool = False) -> SuffixRules:
    """The rules of a list's text; private ones only if asked for."""
    plain, wild, exceptions, in_private = set(), set(), set(), False
    for line in text.splitlines():
        if "===BEGIN PRIVATE" in line:
            in_private = True
        rule = line.strip().split(" ")[0].lower()
        if not rule or rule.startswith("//") or in_private and not private:
            continue
        if not rule.isascii():
            rule = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split("."))
        if rule.startswith("!"):
            exceptions.add(rule[1:])
        elif rule.startswith("*."):
            wild.add(rule[2:])
        else:
            plain.add(rule)
    return SuffixRules(frozenset(plain), frozenset(wild), frozenset(exceptions))


def suffix_list_text(path: str | None = None) -> str:
    """The list from path, the system's copy, or the one in a jar that Spark brings."""
    for p in (path, os.environ.get("SITEFOLD_SUFFIX_LIST"), _SYSTEM_LIST):
        if p and Path(p).exists():
            text = Path(p).read_text(encoding="utf-8")
            if p == path or all(m in text for m in _MARKS):
                return text
    import pyspark

    for jar in sorted(Path(pyspark.__file__).parent.glob("jars/httpclient-*.jar")):
        with zipfile.ZipFile(jar) as z:
            return z.read("mozilla/public-suffix-list.txt").decode()
    raise FileNotFoundError("no public suffix list")


def refresh_suffix_list(path: str, fetch, max_age_days: float = 7.0) -> bool:
    """Replaces the list at path by what fetch() gives, if it is older than max_age_days; a failed or odd answer changes
    nothing. True if it was replaced."""
    import time

    p = Path(path)
    if p.exists() and time.time() - p.stat().st_mtime < max_age_days * 86400:
        return False
    try:
        data = fetch()
    except Exception:  # any failure of the network leaves the old list
        return False
    if not all(m.encode() in data for m in _MARKS):
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(p.suffix + ".part")
    part.write_bytes(data)
    part.replace(p)
    return True


@functools.cache
def default_rules() -> SuffixRules:
    return parse_rules(suffix_list_text())


def host_of(url: Column | str) -> Column:
    """Lower-case host: the authority, or the whole text if it has none, up to the first slash, then colon."""
    u = _col(url)
    return F.lower(F.regexp_extract(F.coalesce(F.nullif(authority(u), F.lit("")), u), r"^([^/:]*)", 1))


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def _last_two(labels: Column) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def _all_digits(labels: Column) -> Column:
    return (F.size(labels) > 0) & F.forall(labels, lambda x: x.rlike("^[0-9]+$"))


def suffixed(host: str | None, rules: SuffixRules) -> str | None:
    """by_suffix() for one host."""
    labels = [x for x in (host or "").split(".") if x]
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if tail in rules.exceptions:
            return tail
        if tail in rules.plain or i + 1 < len(labels) and ".".join(labels[i + 1 :]) in rules.wild:
            return ".".join(labels[i - 1 :]) if i else None
    return None


def _by_lookup(host: Column, rules: SuffixRules) -> Column:
    """by_suffix() in Arrow batches, each distinct host of a batch once."""

    @F.pandas_udf("string")
    def look(hosts: pd.Series) -> pd.Series:
        return hosts.map({h: suffixed(h, rules) for h in hosts.dropna().unique()})

    return look(host)


#: Rules up to which the look-up is an expression; with more the plan would hold them all, so it is an Arrow function.
EXPRESSION_RULES = 200


def _many(rules: SuffixRules) -> bool:
    return len(rules.plain) + len(rules.wild) + len(rules.exceptions) > EXPRESSION_RULES


def by_suffix(host: Column, rules: SuffixRules) -> Column:
    """The public suffix of a host and one label more; null if no rule fits or nothing is left of the suffix.
    Exceptions go before the longest rule; "*." takes one label more than its parent."""
    if _many(rules):
        return _by_lookup(host, rules)

    def listed(labels: Column) -> Column:
        n = F.size(labels)
        tails = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.greatest(n - i + 1, F.lit(0))), "."))

        def of(t: Column) -> Column:
            # of a rule that is tail i, the registered domain is tail i - 1
            place = lambda names: F.nullif(F.aggregate(t, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when((a["at"] == 0) & x.isin(*sorted(names)), a["i"] + 1).otherwise(a["at"]).alias("at")), lambda a: a["at"]), F.lit(0)) if names else F.lit(None).cast("int")
            wild = place(rules.wild) - 1  # a parent that is the whole host has no label for its star
            at = F.coalesce(place(rules.exceptions) + 1, F.least(place(rules.plain), F.when(wild >= 1, wild)))
            return F.when(at > 1, F.try_element_at(t, at - 1))

        return _let(tails, of)

    return _let(_labels(host), listed)


def registered_domain(url: Column | str, rules: SuffixRules | None = None) -> Column:
    """The domain that a crawl stays in. "www." goes wherever it stands in the host; digits alone are an address; the suffix
    list is asked only for hosts like a.bcd.ef, all others give their last two labels."""
    full, rules = host_of(url), rules or default_rules()

    def of(full: Column, listed: Column) -> Column:
        host = F.replace(full, F.lit("www."), F.lit(""))

        def named(labels: Column) -> Column:
            last_two = F.regexp_extract(labels, r"([^.]+\.[^.]+)\z", 1)
            ask = labels.rlike(r"\.[^.]{1,3}\.[^.]{2}\z")
            own = F.replace(listed, F.lit("www."), F.lit(""))
            return F.when(labels.rlike(r"^[0-9]+(\.[0-9]+)*\z"), labels).when(ask, F.coalesce(own, last_two)).when(labels.contains("."), last_two).otherwise(host)

        return _let(F.regexp_replace(F.regexp_replace(host, r"\.{2,}", "."), r"^\.|\.\z", ""), named)  # the labels, without empty ones

    if _many(rules):  # no Python function in a lambda
        return _let(F.struct(full.alias("full"), by_suffix(full, rules).alias("listed")), lambda x: of(x["full"], x["listed"]))
    return _let(full, lambda x: of(x, by_suffix(x, rules)))  # looked up only where it is asked for


def clean_domain(url: Column | str, rules: SuffixRules | None = None) -> Column:
    """The domain that records are consolidated under: the suffix list first, the last two labels where it has no rule."""
    full = host_of(url)

    def of(x: Column) -> Column:
        host = F.replace(x["full"], F.lit("www."), F.lit(""))
        rest = lambda labels: F.when(_all_digits(labels), F.array_join(labels, ".")).when(F.size(labels) >= 2, _last_two(labels)).otherwise(host)
        return F.coalesce(x["listed"], _let(_labels(host), rest))

    return _let(F.struct(full.alias("full"), by_suffix(full, rules or default_rules()).alias("listed")), of)
