"""Readers and writers: page scans, URL lists, CSV, sitemaps, robots files, idempotent stores."""
