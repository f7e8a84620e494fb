"""The pipeline's stages against brute force, and on an empty table."""

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from linkloom.llm import near_dup
from linkloom.session import stage

from test_operators import PASSAGE, SCHEMA, brute_components, brute_lines, prose, rows


def write_tables(folder, texts):
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["s"] * len(texts),
                             "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}), folder / "documents.parquet")
    known = [i for i, t in enumerate(texts) if t]
    pq.write_table(pa.table({"doc_id": known, "toxic": pa.array([int("scum" in texts[i]) for i in known], pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [PASSAGE]}), folder / "benchmark.parquet")


def test_stages(spark, tmp_path):
    clean = [prose(60, 2000 + s) for s in range(240)]
    toxic = [prose(40, 300 + s) + " vile scum " + prose(20, 400 + s) for s in range(75)]
    texts = [None, "", *clean, *toxic, clean[0], clean[1] + " one more word", prose(30, 900) + " " + PASSAGE + " " + prose(30, 901)]
    write_tables(tmp_path, texts)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, str(tmp_path)))
        after[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    _, kept = after["toxicity"]
    assert kept.filter(F.col("text").contains("scum")).count() <= 0.05 * len(toxic), "a fitted classifier: a few may pass"
    assert kept.filter(~F.coalesce(F.col("text"), F.lit("")).contains("scum")).count() >= 0.98 * (len(texts) - len(toxic))
    before, kept = after["line_dedup"]
    gone = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    wanted = {}
    for r in before.collect():
        left = None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone)
        if not (left is not None and len(left) < len(r.text) and not left.strip()):
            wanted[r.doc_id] = left
    assert {r.doc_id: r.text for r in kept.collect()} == wanted
    before, kept = after["minhash_near_dedup"]
    comp, _ = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
    assert {r.doc_id for r in kept.collect()} == {d for d, c in comp.items() if c == d}
    assert near_dup.near_duplicates(before).count() == before.count()
    before, kept = after["benchmark_decontamination"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()} == {len(texts) - 1}
    before, coded = after["bpe"]
    texts_of = {r.doc_id: r.text or "" for r in before.collect()}
    assert {r.doc_id: r.decoded for r in coded.collect()} == texts_of and 0 in texts_of and 1 in texts_of
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(texts_of)


def test_short_line_copies(spark):
    body = prose(60, 3000)
    texts = [f"{body}\nAll rights reserved.\n日本語の行", f"{body}\nall  rights reserved.\n日本語の行", f"All rights reserved.\n{prose(60, 3001)}\nAll rights", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert kept == {0: texts[0], 2: texts[2].split("\n", 1)[1], 3: texts[3]}


def test_empty_and_extra_columns(spark, tmp_path):
    write_tables(tmp_path, ["some words"])
    extra = spark.createDataFrame([*rows(), rows()[5], (None, "no id here", None, None, None, "x", "y", "z")], SCHEMA)
    for docs in (extra, extra.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(step(spark, docs, str(tmp_path)))
            assert name == "bpe" or docs.columns == columns


def test_near_copies_leave_no_stubs(spark, tmp_path):
    body = [[prose(12, 5000 + 40 * d + n) for n in range(20)] for d in range(3)]
    copy, half = list(body[0]), [*body[1][:10], *[prose(12, 7000 + n) for n in range(10)]]
    copy[7] = prose(12, 6000)
    texts = ["\n".join(x) for x in (*body, copy, half)]
    write_tables(tmp_path, texts)
    lines = stage(corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)))
    assert {r.doc_id: r.text for r in lines.collect()}[3] == copy[7], "a stub is left"
    kept = corpus_pipeline.keep_one_of_each_group(spark, lines, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 4}
    assert {r.doc_id for r in near_dup.one_of_each_group(lines).collect()} == {0, 1, 2, 3, 4}
