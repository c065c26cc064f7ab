"""Readers and writers: claim tables, run metadata, sitemaps, page tables."""
