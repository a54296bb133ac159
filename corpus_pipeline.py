"""The corpus pipeline: five stages, each over everything that its predecessor kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. Between stages the
documents are written as Parquet into the shared folder and read again, so a
lost executor never costs more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm import decontaminate, line_dedup, packing, quality, simhash
from terrashift.llm.storage import table, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of ``docs`` itself.

    A null or blank text has the prior's score, so it goes where that is below
    0.7; without labels every score is 0.5 and all go. Repeated rows have equal
    scores and stay or go together. No rows give no rows.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), max_rows=6000)
    return quality.keep_good(docs, model, threshold=0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents hold stay only in the last of them.

    No row goes; a null text stays null, with the n_chars null. Rows that
    repeat an id count as documents of their own.
    """
    kept = line_dedup.deduplicate(docs, min_chars=40, min_docs=5, lines=None, dropped=None)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Documents are linked where the 64-bit SimHash fingerprints of their five-word
    shingles differ in at most 4 bits, and where they share 0.8 of their shingles
    and more, which fingerprints often miss. Texts without words are one group. Of rows that are the same in all columns
    one stays; rows that share an id and differ elsewhere stay or go together.
    A row without an id can't be named, so it stays; it never makes another go.
    """
    found = simhash.similar_documents(docs, width=5, radius=4)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id")
    once = kept.join(twice, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").select(docs.columns).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go; a null or blank text holds none. Repeated rows go together."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), rate=0.1)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document that is left, in bins of 2048; a text without words is a piece of length 0."""
    return packing.best_fit(docs, capacity=2048)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_bins),
]

#: SQL can't express the classifier, the similarity components or best fit; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
