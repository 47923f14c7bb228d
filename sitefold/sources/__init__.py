"""Readers and writers: seed lists, crawl logs, page archives, records, fetching."""
