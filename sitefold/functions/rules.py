"""Which URLs a crawl follows at which depth."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col, path, url_extension

_DEFAULT = Path(__file__).with_name("default_rules.json")


def normalize_extension(x: object) -> str:
    return str(x).strip().lower().removeprefix(".").strip()


def parse_extensions(x: str | Iterable[object] | None) -> set[str]:
    """Extensions from a comma list, an iterable of such lists, or one value."""
    if x is None:
        return set()
    items = [x] if isinstance(x, str) or not isinstance(x, Iterable) else list(x)
    return {e for i in items for e in (normalize_extension(p) for p in str(i).split(",")) if e}


def create_pattern(raw: str | None = None, keywords: Iterable[str] = ()) -> str:
    """A case-insensitive pattern of a regular expression and keywords, in which a blank is any gap. Without either it is the
    one that matches only where a text ends at its start, that is, the empty text."""
    words = [k.strip().lower().replace(" ", ".*") for k in keywords if k.strip()]
    parts = [p for p in (raw, *words) if p]
    return "(?i)" + ("|".join(parts) if parts else "$^")


@dataclass
class Rules:
    negative: str
    positive: str
    allowed: set[str] = field(default_factory=set)
    blocked: set[str] = field(default_factory=set)


def load_rules(file: str | None = None, allowed: str | Iterable[object] | None = None, blocked: str | Iterable[object] | None = None) -> Rules:
    """Rules of a JSON file (the default ones without it), with more extensions; what is allowed isn't blocked."""
    data = json.loads(Path(file or _DEFAULT).read_text(encoding="utf-8"))
    neg, pos, files = data.get("negative", {}), data.get("url", {}), data.get("files", {})
    ok = parse_extensions(files.get("allowed_extensions")) | parse_extensions(allowed)
    no = parse_extensions(files.get("blocked_extensions")) | parse_extensions(blocked)
    return Rules(create_pattern(neg.get("negative_regex"), neg.get("negative_keywords", ())), create_pattern(pos.get("url_regex"), pos.get("url_keywords", ())), ok, no - ok)


def classify_url(url: Column | str, level: Column | str, rules: Rules | None = None) -> Column:
    """Whether a URL is followed at a level. The first rule that applies decides: seeds are; mail and phone links aren't;
    extensions are allowed, then blocked; unwanted words in the path; at level 1 all but paths without a letter; at level 2
    wanted words in the path; deeper ones aren't."""
    rules = rules or load_rules()
    u, n = _col(url), _col(level)
    ext, p = url_extension(u), path(u)
    ok = F.when(n == 0, True).when(u.rlike("(?i)^(mailto|tel):"), False)
    if rules.allowed:
        ok = ok.when(ext.isin(*sorted(rules.allowed)), True)
    if rules.blocked:
        ok = ok.when(ext.isin(*sorted(rules.blocked)), False)
    return ok.when(p.rlike(rules.negative), False).when(n == 1, ~p.rlike("^[^a-zA-Z]+$")).when(n == 2, p.rlike(rules.positive)).otherwise(False)
