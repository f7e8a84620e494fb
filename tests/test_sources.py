"""Readers and html extraction."""

import pytest

from linkloom.sources.html import extract_pages
from linkloom.sources.records import SourceError, console_columns, read_console, read_keywords, read_links, read_url_list

HTML = """<!doctype html><html lang="en-GB"><head><title>Post - Site</title><meta name="description" content="About a post">
<link rel="canonical" href="https://example.com/post/"></head><body><header><nav><a href="/">Home</a><a href="/services/">Services</a></nav></header>
<nav aria-label="Breadcrumb"><a href="/">Home</a><a href="/blog/">Blog</a></nav><main></main>
<article><h1>Post title</h1><h2>Section</h2><p>First paragraph with <a href="/contact/">a contact link</a> inside.</p>
<ul><li>A list item about tyres</li></ul><pre><code>program code</code></pre></article><footer><a href="/terms/">Terms</a></footer></body></html>"""
CARDS = """<html lang="en"><body><main><h1>AI</h1><a href="/a/"><article><h2>Post A</h2><p>The first preview in a card that is a link.</p></article></a>
<article><h2><a href="/b/">Post B</a></h2><p>The second preview has a linked heading.</p></article></main></body></html>"""


def test_html_page(spark):
    p = extract_pages(spark.createDataFrame([("https://example.com/post/", HTML)], "url string, html string")).first()
    assert (p.lang, p.title, p.h1, p.meta) == ("en", "Post - Site", "Post title", "About a post")
    assert [b.tag for b in p.blocks] == ["h1", "h2", "p", "li"]
    assert p.blocks[2].text == "First paragraph with ¶ inside." and "a contact link" in p.blocks[2].raw
    assert p.content_links == ["example.com/contact/"] and p.breadcrumb_links == ["example.com/", "example.com/blog/"]
    assert "example.com/terms/" in p.other_links and "program code" not in "".join(b.text for b in p.blocks)


def test_listing_of_cards_is_read_whole(spark):
    p = extract_pages(spark.createDataFrame([("https://example.com/tag/", CARDS)], "url string, html string")).first()
    assert p.content_links == ["example.com/a/", "example.com/b/"]
    texts = [b.text for b in p.blocks]
    assert not any("first preview" in t for t in texts) and any("second preview" in t for t in texts)


@pytest.mark.parametrize("content", [
    "Page,Query,Clicks,Impressions,CTR\nhttps://example.pl/o/,when tyres,10,200,5%\nhttps://example.pl/o/,tyre cost,2,500,1%\n",
    "﻿Strona;Zapytanie;Kliknięcia;Wyświetlenia\n/o/;when tyres;10;200\n/o/;tyre cost;2;\"1 000\"\n",
    "url,query,clicks,impressions\nhttps://www.example.pl/o/,when tyres,4,100\nhttps://www.example.pl/o/,When tyres,6,100\nhttps://www.example.pl/o/,tyre cost,2,500\n"])
def test_console_exports(spark, tmp_path, content):
    f = tmp_path / "export.csv"
    f.write_text(content, encoding="utf-8")
    got = {r["query"]: (r["u"], r["clicks"], r["impressions"]) for r in read_console(spark, str(f), "example.pl").collect()}
    assert got["when tyres"] == ("example.pl/o/", 10, 200)
    assert got["tyre cost"][1] == 2 and got["tyre cost"][2] in (500, 1000)


def test_console_without_queries_says_so():
    with pytest.raises(SourceError, match="no query column"):
        console_columns(["Top pages", "Clicks"])


def test_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# blog\n/align/\nhttps://www.example.com/\n", encoding="utf-8")
    assert {r["u"] for r in read_url_list(spark, str(tmp_path / "urls.txt"), "example.com").collect()} == {"example.com/align/", "example.com/"}
    (tmp_path / "k.csv").write_text("keyword,target_url,match\nsquash courts,https://e.com/c/,exact\ngroup training,,\n", encoding="utf-8")
    got = {(r["keyword"], r["target_url"], r["match"]) for r in read_keywords(spark, str(tmp_path / "k.csv"), "e.com").collect()}
    assert got == {("squash courts", "https://e.com/c/", "exact"), ("group training", "", "partial")}
    (tmp_path / "bad.csv").write_text("keyword,match\na,fuzzy\n", encoding="utf-8")
    with pytest.raises(SourceError, match="unknown match type"):
        read_keywords(spark, str(tmp_path / "bad.csv"), "e.com")
    (tmp_path / "brief.md").write_text("# x\n```csv\nsource_url,anchor,target_url,context\nhttps://e.com/,\"a, b\",https://e.com/c/,in text\n```\n", encoding="utf-8")
    r = read_links(spark, str(tmp_path / "brief.md"), "e.com").first()
    assert (r["anchor"], r["target_url"], r["context"]) == ("a, b", "https://e.com/c/", "in text")
