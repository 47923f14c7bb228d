"""sitefold: web-corpus analytics on Spark.

Seed lists, page stores and crawl logs go in; normalised and classified URLs, link graphs, extracted page records and one
consolidated record for each registered domain come out.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_FROM = {
    "crawl": "operators.crawl", "CrawlConfig": "operators.crawl", "in_memory_seeds": "operators.crawl", "complement": "operators.overview", "Fetcher": "sources.fetch", "extract": "operators.extract",
    "Fields": "operators.extract", "contact_fields": "operators.extract", "FieldPlugin": "sources.settings", "consolidated": "operators.consolidate", "merged": "operators.consolidate",
}
__all__ = sorted(_FROM)


def __getattr__(name: str):
    """The main operations, imported when they are first asked for."""
    if name not in _FROM:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_FROM[name]}", __name__), name)
