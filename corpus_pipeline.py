"""The corpus pipeline: five stages over a table of documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns
of documents. Null and empty texts pass every stage; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from linkloom.llm.catalog import table, tokenizer_path
from linkloom.session import only_result, ship_package, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents, calls toxic (score 0.5 or more) go."""
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumnsRenamed({"score": "_score", "predicted": "_predicted"}), model).filter("predicted = 0").drop(
        "score", "predicted").withColumnsRenamed({"_score": "score", "_predicted": "predicted"})


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a similar line earlier in the corpus go, and so do later copies of lines too short to compare; a document
    that loses all its words this way goes, too."""
    ship_package(spark)
    gone = only_result(line_dedup.removed_lines)(docs, copy_words=1)
    cleaned = line_dedup.without_lines(docs.withColumn("_before", F.length("text")), gone)
    emptied = (F.length("text") < F.col("_before")) & ~F.col("text").rlike(r"\S")
    kept = cleaned.filter(~F.coalesce(emptied, F.lit(False))).drop("_before")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, similarity 0.8) the document with the smallest id stays, once.

    Line dedup leaves of a near copy no more than its changed lines, which resemble nothing. So the documents are
    compared by the texts they have here and by their whole texts in `documents`, among those that reached this stage.
    Rows without an id are no group's representative and stay.
    """
    ship_package(spark)
    return near_dup.one_of_each_group(docs, table(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item (ten words in a row, or a whole shorter item) go."""
    ship_package(spark)
    names = ["n_words", "hit_spans", "n_hit", "items"]
    held = docs.withColumnsRenamed({c: f"_{c}" for c in names})
    found = decontaminate.decontaminate(held, table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").drop(*names).withColumnsRenamed({f"_{c}": c for c in names})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents' texts, their number, and the text decoded from them."""
    ship_package(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), keep=["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier and the tokenizer cannot be written in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


@only_result
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filtering stages leave of `documents`; the tables of a finished stage are deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = only_result(step)(spark, docs, sf_dir)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over `documents`."""
    return STAGES[-1][1](spark, filtered(spark, sf_dir), sf_dir)
