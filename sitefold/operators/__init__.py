"""Relational operators over seeds, crawl logs, page stores and extracted records."""
