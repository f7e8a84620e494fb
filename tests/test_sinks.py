"""Folders: results per site, deep sitemaps, and the shared stage folder."""

import types

import pytest

from linkloom import session
from linkloom.functions.texts import console_header
from linkloom.sinks.tables import clear_sites, write_table
from linkloom.sources.discovery import sitemap_urls

NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
SCHEMA = "source_url string, n long, site string"


def test_a_site_without_results_loses_its_old_ones(spark, tmp_path):
    path = str(tmp_path / "links")
    write_table(spark.createDataFrame([("u", 1, "a.com"), ("v", 2, "b.com")], SCHEMA), path)
    now = spark.createDataFrame([("w", 3, "b.com")], SCHEMA)
    write_table(now, path)
    clear_sites(spark, path, SCHEMA, spark.createDataFrame([("a.com",), ("b.com",)], "site string"), now)
    assert [tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).collect()] == [("w", 3, "b.com")]


def test_sitemaps_of_any_depth(spark):
    def index(i):
        return f"<sitemapindex {NAMESPACE}><sitemap><loc>https://a.com/{i}.xml</loc></sitemap></sitemapindex>"
    files = [("a.com", f"https://a.com/{i}.xml", index(i + 1)) for i in range(12)]
    files.append(("a.com", "https://a.com/12.xml", f"<urlset {NAMESPACE}><url><loc>https://a.com/page</loc></url></urlset>"))
    out = sitemap_urls(spark.createDataFrame(files, "site string, url string, body string"),
                       spark.createDataFrame([("a.com", "https://a.com/0.xml")], "site string, url string"))
    assert [tuple(r) for r in out.collect()] == [("a.com", "https://a.com/page")]


def test_a_cluster_without_a_shared_folder_is_refused():
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        session.shared_folder(fake)


def test_export_titles():
    assert console_header('  "Top_Queries  Now" ') == "top queries now"


def test_rows_without_a_site_are_cleared_like_others(spark, tmp_path):
    path = str(tmp_path / "links")
    write_table(spark.createDataFrame([("u", 1, None), ("v", 2, "b.com"), ("x", 4, "a/b c.com")], SCHEMA), path)
    none = spark.createDataFrame([], SCHEMA)
    clear_sites(spark, path, SCHEMA, spark.createDataFrame([(None,), ("a/b c.com",)], "site string"), none)
    assert [tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).collect()] == [("v", 2, "b.com")]
