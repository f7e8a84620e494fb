"""Readers: page records, html, sitemaps, robots rules, exports, lists, caches."""
