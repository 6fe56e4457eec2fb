"""Queries that run as streams to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import serving
from textloom.plans.base import query, table
from textloom.plans.retrieval_queries import _TOKENS
from textloom.storage import remove, shared_dir
from textloom.streaming import jobs


def work_dir(spark: SparkSession) -> str:
    """A new folder that all machines see."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query(f"SELECT token, doc_id, count(*) AS tf, min(pos)::INT AS first_pos FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY token, doc_id")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    jobs.incremental_index(docs, f"{path}/index", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/index/postings").select("token", "doc_id", "tf", "first_pos")


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id))::INT AS nth, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) <= 2 AS accepted FROM events")
def daily_quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "ts")
    jobs.quota(events, 2).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", "nth", "accepted")


@query("SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "ts")

    counts = jobs.daily_counts(events).select("user_id", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "n")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    # only days that changed are written with each batch; of a day's rows the last batch's holds
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("user_id", "day").agg(F.max_by("n", "batch").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
, r AS (SELECT event_id, user_id, event_type, n, ts AS wrote, false AS hit FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, CASE WHEN e.ts - r.wrote < INTERVAL 604800 SECOND THEN r.wrote ELSE e.ts END, e.ts - r.wrote < INTERVAL 604800 SECOND
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_id, hit FROM r
""")
def answer_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "event_type", "ts")
    hits = jobs.answer_cache(events, ["user_id", "event_type"])
    hits.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "hit")


@query("SELECT user_id, arg_max(value, event_id) AS pct FROM events GROUP BY user_id")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "value")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    jobs.progress(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("user_id").agg(F.max_by("pct", "batch").alias("pct"))


#: Characters of the pieces of one file on average.
FILE_CHARS = 16 << 20


def pieces_of(lines: DataFrame, spark: SparkSession, size: int, files: int) -> DataFrame:
    """A stream of files with the texts of lines (doc_id, body) in pieces of so many characters, and the end of each; a folder has every files-th piece.

    A folder has as many files as its pieces need, and a batch takes as many files, so neither a file nor a task grows with the texts.
    """
    path = work_dir(spark)
    starts = F.sequence(F.lit(0), F.floor((F.length("body") - 1) / size).cast("int"))
    cut = F.concat(F.transform(starts, lambda k: F.substr("body", k * size + 1, F.lit(size))), F.array(F.lit(None).cast("string")))
    held = work_dir(spark)
    lines.write.option("compression", "zstd").parquet(held)
    lines = spark.read.parquet(held)
    parts = max(1, -(-(lines.agg(F.sum(F.length("body"))).first()[0] or 0) // (FILE_CHARS * files)))
    each = lines.select("doc_id", F.posexplode(cut).alias("seq", "piece")).withColumn("file", F.col("seq") % files).withColumn("part", F.pmod(F.xxhash64("doc_id", "seq"), F.lit(parts)).cast("int"))
    each.repartition(files * parts, "file", "part").drop("part").write.partitionBy("file").option("compression", "zstd").parquet(path)
    remove(spark, held)  # pieces are all that is read from here on
    return spark.readStream.schema("doc_id long, seq int, piece string, file int").option("maxFilesPerTrigger", parts).parquet(path)


def to_end(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream appends until its input is used up."""
    path = work_dir(spark)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


_REPLIES = "SELECT doc_id, string_split(text, chr(10)) AS d, {whole} AS whole FROM documents WHERE text IS NOT NULL"


@query(f"""
WITH r AS ({_REPLIES.format(whole='doc_id % 3 > 0')}), b AS (SELECT doc_id, 'browser' AS policy, d, true AS complete FROM r UNION ALL SELECT doc_id, 'client', d, whole FROM r)
SELECT doc_id, policy, md5(array_to_string(d, chr(10))) AS reply, len(d) AS n_deltas, complete FROM b
""")
def ndjson_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a reply, a delta a line, in pieces out of order; every third one's last line has no line feed."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    body = F.concat(F.array_join(serving.events_of("text"), "\n"), F.when(F.col("doc_id") % 3 > 0, F.lit("\n")).otherwise(F.lit("")))
    pieces = pieces_of(docs.select("doc_id", body.alias("body")), spark, 997, 3).drop("file")
    found = jobs.replies_by(pieces, "doc_id", [jobs.BROWSER, jobs.CLIENT])
    return to_end(found.select("doc_id", "policy", F.md5("reply").alias("reply"), "n_deltas", "complete"), spark)


@query(f"""
WITH r AS ({_REPLIES.format(whole='doc_id % 2 > 0')}) SELECT doc_id, md5(array_to_string(d, '')) AS reply, len(d) AS n_deltas, whole AS complete FROM r
""")
def sse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a server-sent stream; every other one breaks off before its end mark."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    say = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    body = F.concat(F.lit(": hello\n\n"), F.array_join(F.transform(F.split("text", "\n"), say), ""), F.when(F.col("doc_id") % 2 > 0, F.lit("data: [DONE]\n\n")).otherwise(F.lit("")))
    stream = jobs.replies(pieces_of(docs.select("doc_id", body.alias("body")), spark, 1499, 2).drop("file"), "doc_id", jobs.CLIENT, "sse")
    return to_end(stream, spark).select("doc_id", F.md5("reply").alias("reply"), "n_deltas", "complete")
