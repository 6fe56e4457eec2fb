"""Measures of retrieval and answers: question sets, flags, recall, citations, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "questions array<struct<question string, expectArticles array<string>>>"


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(n, question, expect): the questions of a JSON file in their order; empty ids are dropped."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).select(F.posexplode("questions").alias("n", "q"))
    expect = F.filter(F.coalesce("q.expectArticles", F.array().cast("array<string>")), lambda a: a != "")
    return rows.select("n", F.coalesce("q.question", F.lit("")).alias("question"), expect.alias("expect"))


def question_sets(spark: SparkSession, path: str) -> DataFrame:
    """(id, n, question, expect) of JSON lines that hold a question set and its id each."""
    rows = spark.read.schema(f"id long, {QUESTIONS}").json(path).select("id", F.posexplode("questions").alias("n", "q"))
    expect = F.filter(F.coalesce("q.expectArticles", F.array().cast("array<string>")), lambda a: a != "")
    return rows.select("id", "n", F.coalesce("q.question", F.lit("")).alias("question"), expect.alias("expect"))


def has_citation(reply: Column) -> Column:
    return F.coalesce(reply.rlike(r"\[\d{1,2}\]"), F.lit(False))


def is_refusal(reply: Column, mark: str) -> Column:
    return F.coalesce(reply.contains(mark), F.lit(False))


def judged(results: DataFrame, mark: str) -> DataFrame:
    """results (…, reply, status, expect, sources, passages) with found, hit, cited and refusal.

    found is every article among sources or passages; hit says that an expected one is.
    """
    out = results.withColumn("found", F.array_union("sources", "passages"))
    out = out.withColumn("hit", (F.size("expect") > 0) & F.coalesce(F.arrays_overlap("expect", "found"), F.lit(False)))
    return out.withColumn("cited", has_citation(F.col("reply"))).withColumn("refusal", is_refusal(F.col("reply"), mark))


def metrics(judged_results: DataFrame) -> DataFrame:
    """One row of counts and rates over results whose status is ok; rates are null where nothing is counted.

    Recall is over those that expect an article. verify, where it is there, has faithful, invalid, quote_checked and quote_ok.
    """
    ok, v = F.col("status") == "ok", F.col("verify")
    verified, labelled = ok & v.isNotNull(), ok & (F.size("expect") > 0)
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    n = F.count_if
    sums = judged_results.agg(
        F.count("*").alias("n"), n(ok).alias("n_ok"), n(labelled).alias("n_labelled"), n(labelled & F.col("hit")).alias("n_hit"),
        n(ok & F.col("cited")).alias("n_cited"), n(ok & F.col("refusal")).alias("n_refusal"),
        F.sum(F.when(ok, F.size("sources"))).alias("s"), F.sum(F.when(ok, F.size("passages"))).alias("p"),
        n(verified).alias("n_verified"), n(verified & F.coalesce(v["faithful"], F.lit(True))).alias("n_faithful"), n(verified & (v["invalid"] > 0)).alias("n_out_of_range"),
        F.coalesce(F.sum(F.when(verified, v["quote_checked"])), F.lit(0)).alias("n_quotes"), F.coalesce(F.sum(F.when(verified, v["quote_ok"])), F.lit(0)).alias("n_quotes_ok"),
    )
    c = F.col
    return sums.select(
        "n", "n_ok", "n_labelled", "n_hit", rate(c("n_hit"), c("n_labelled")).alias("recall"), rate(c("n_cited"), c("n_ok")).alias("citation_rate"), rate(c("n_refusal"), c("n_ok")).alias("refusal_rate"),
        rate(c("s"), c("n_ok")).alias("mean_sources"), rate(c("p"), c("n_ok")).alias("mean_passages"), "n_verified", rate(c("n_faithful"), c("n_verified")).alias("faithful_rate"),
        rate(c("n_quotes_ok"), c("n_quotes")).alias("quote_rate"), "n_out_of_range",
    )
