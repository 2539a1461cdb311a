"""Readers: tables, crawled pages, landed payloads, event feeds, user rows."""
