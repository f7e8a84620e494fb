"""Pages are parsed one by one, and a list of addresses parses its pages once."""

import pyarrow as pa

from linkloom.plans import catalog
from linkloom.sources import html

PAGE = '<html lang="en"><title>T {0}</title><body><p>One &amp; two words of page {0} <a href="/x{0}">there</a></p></body></html>'


def test_parsed_pages_are_handed_on_by_size(monkeypatch):
    monkeypatch.setattr(html, "_BATCH_CHARS", 300)
    rows = [{"site": "example.com", "url": f"https://example.com/{i}", "html": PAGE.format(i) if i % 4 else None} for i in range(10)]
    schema = pa.schema([(c, pa.string()) for c in ("site", "url", "html")])
    out = list(html._parse(iter([pa.RecordBatch.from_pylist(rows[:7], schema), pa.RecordBatch.from_pylist(rows[7:], schema)])))
    assert max(b.num_rows for b in out) < 7 and sum(b.num_rows for b in out) == 10
    for got, row in zip((r for b in out for r in b.to_pylist()), rows, strict=True):
        assert got == {"site": row["site"], "url": row["url"], **html.parse_page(row["url"], row["html"] or "")}


def test_list_of_addresses_parses_its_pages_once(spark, tmp_path):
    rows = [(i, f"https://example.com/{i}", PAGE.format(i)) for i in range(3)] + [(3, None, None), (4, "https://example.com/1", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = catalog.QUERIES["src08_url_list"](spark, str(tmp_path))
    assert "MapIn" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["u"] for r in out.filter("u is not null").collect()} == {f"example.com/{i}/" for i in range(3)}
