"""URL columns: comparison key, host, path, slug, archive and file tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DEFAULTS, FILE_LINK

_AUTHORITY = r"^(?:[^:/?#]+:)?//([^/?#]*)"
_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def bare_host(host: Column) -> Column:
    """Lower-case host without port and leading ``www.``."""
    return F.regexp_replace(F.split_part(F.lower(host), F.lit(":"), F.lit(1)), r"^www\.", "")


def host_of(url: Column) -> Column:
    return bare_host(F.regexp_extract(url, _AUTHORITY, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def norm_url(url: Column) -> Column:
    """Host and path, closed with a slash unless the last segment looks like a file name."""
    path = path_of(url)
    open_end = path.rlike(r"(^|/)[^/.]+$") | (path == "")
    return F.concat(host_of(url), path, F.when(open_end, "/").otherwise(""))


def is_internal(url: Column, site: Column) -> Column:
    return host_of(url) == bare_host(site)


def target_path(url: Column) -> Column:
    """Root-relative address: path and query string."""
    path, query = path_of(url), F.regexp_extract(url, _QUERY, 1)
    return F.concat(F.when(path == "", "/").otherwise(path),
                    F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def last_segment(url: Column) -> Column:
    """Text after the last slash, trailing slashes ignored."""
    return F.regexp_extract(url, r"([^/]*)/*$", 1)


def slug(url: Column) -> Column:
    """Last segment of the path as words; empty for a home page."""
    return F.translate(last_segment(path_of(url)), "-", " ")


def any_rlike(value: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in patterns], F.lit(False))


def is_archive(url: Column, cfg: dict = DEFAULTS) -> Column:
    """Tag, author, date and paged archives: never link targets."""
    return any_rlike(path_of(url), cfg.get("archive_patterns", []))


def is_file(link: Column) -> Column:
    return F.regexp_replace(link, "/+$", "").rlike(FILE_LINK)
