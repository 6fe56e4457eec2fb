"""Documents to training sequences: toxicity, language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. In every stage an empty table stays empty, columns of other names
are kept as they are, whatever their names, and a text of any length is processed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, line_dedup, ngram_join, packing
from textloom.llm import toxicity as tox
from textloom.llm.common import remove, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on those with labels, finds toxic go.

    A null or empty text stays. Repeated rows are judged alike. Without a label for any document nothing is learned and all stay.
    """
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return tox.score(docs, model).where("NOT rejected").select(*_named(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language learned, go; a null text is one without a letter.

    Repeated rows are judged alike. Where no document has a language nothing is learned, and no text with a letter goes.
    """
    return langid.identify(docs, langid.fit(docs)).where("NOT rejected").select(*_named(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but in the first document that has them; n_chars follows the text.

    No row goes. A null id or text stays as it is. Rows that share an id count as one document.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*_named(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id, a null id being the greatest.

    Of repeated rows one stays. Rows that share an id but not their text are judged each in its own class. Null and blank texts
    are in no class, and stay.
    """
    return ngram_join.keep_one(docs).select(*_named(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place there. A null or blank text is one piece, its end id; repeated rows are packed each."""
    return packing.pack(docs)


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("toxicity", toxicity), ("language_id", language), ("line_dedup", lines), ("ngram_join", near_duplicates), ("packing", pack)]

#: Classifiers, hashing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in their order over the documents of sf_dir, each written to the shared folder and read again; then its input there goes."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
