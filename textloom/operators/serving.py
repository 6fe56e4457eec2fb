"""What a question service keeps: quotas, expiring answers, feedback, progress, keys, citations, event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Messages that the server, the client, its session and the condensing step look back at.
TAILS = {"server": 6, "client": 8, "session": 30, "condense": 5}
TAIL, CONDENSE_BELOW, HARD_FROM = 6, 12, 24


def quota(events: DataFrame, principal: str, ts: str, order: str, limit: int) -> DataFrame:
    """events with day, nth (of the day, among accepted ones at most limit) and accepted.

    Rejected requests don't count, so the accepted are just the first limit of each day.
    """
    day = F.to_date(ts)
    nth = F.row_number().over(Window.partitionBy(principal, "day").orderBy(order))
    return events.withColumn("day", day).withColumn("nth", nth).withColumn("accepted", F.col("nth") <= limit)


def ttl_cache(events: DataFrame, key: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """events with hit: whether an answer for the key was written less than seconds before; a hit doesn't write.

    The last write depends on all decisions before, so each key's events are replayed in order, in batches of any size.
    """
    columns = [f"{c.name} {c.dataType.simpleString()}" for c in events.schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, wrote = None, None
        for f in frames:
            hits = []
            for k, t in zip(zip(*[f[c] for c in key], strict=True), f[ts], strict=True):
                if k != last:
                    last, wrote = k, None
                hit = wrote is not None and (t - wrote).total_seconds() < seconds
                if not hit:
                    wrote = t
                hits.append(hit)
            yield f.assign(hit=hits)

    return events.repartition(*key).sortWithinPartitions(*key, ts, order).mapInPandas(run, ", ".join([*columns, "hit boolean"]))


def history_tail(turns: DataFrame, n: int = TAIL) -> DataFrame:
    """The last n valid messages of each conversation, numbered from 1."""
    valid = turns.where(F.col("role").isNotNull() & F.col("text").isNotNull())
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = valid.withColumn("__b", back).where(F.col("__b") <= n)
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("__b")


def is_follow_up(previous: Column, last: Column) -> Column:
    return previous.isNotNull() & ((F.length(last) < CONDENSE_BELOW) | last.rlike(T.FOLLOW_UP))


def condense(turns: DataFrame) -> DataFrame:
    """(conv_id, question): the last user turn, after the one before if it follows up on it."""
    users = turns.where("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    last = users.withColumn("prev", F.lag("text").over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("nth = 1")
    follows = is_follow_up(F.col("prev"), F.col("text"))
    return last.select("conv_id", follows.alias("follows"), F.when(follows, F.concat("prev", F.lit("。"), "text")).otherwise(F.col("text")).alias("question"))


def is_hard(question: Column) -> Column:
    return (F.length(question) >= HARD_FROM) | (F.regexp_count(question, F.lit("[？?]")) >= 2) | question.rlike(T.HARD)


def validate_citations(answers: DataFrame, reply: str, contexts: str) -> DataFrame:
    """answers with cited, invalid, quote_checked, quote_ok and faithful; contexts is the array of texts that [1], [2], … mean.

    A quote of 2 to 40 characters right before [n] must occur in text n, punctuation aside.
    """
    nums = F.transform(F.regexp_extract_all(reply, F.lit(r"\[(\d{1,2})\]"), 1), lambda n: n.cast("int"))
    n = F.size(contexts)
    pattern = r"""[「“"]([^」”"\n]{2,40})[」”"]\s*\[(\d{1,2})\]"""
    quotes = F.arrays_zip(F.regexp_extract_all(reply, F.lit(pattern), 1).alias("q"), F.regexp_extract_all(reply, F.lit(pattern), 2).alias("k"))
    found = lambda x: F.coalesce(F.contains(T.norm_match(F.get(F.col(contexts), x["k"].cast("int") - 1)), T.norm_match(x["q"])), F.lit(False))
    out = answers.withColumn("__n", nums).withColumn("__q", quotes)
    out = out.withColumn("cited", F.size("__n")).withColumn("invalid", F.size(F.filter("__n", lambda x: (x < 1) | (x > n))))
    out = out.withColumn("quote_checked", F.size("__q")).withColumn("quote_ok", F.size(F.filter("__q", found)))
    return out.withColumn("faithful", (F.col("invalid") == 0) & (F.col("quote_ok") == F.col("quote_checked"))).drop("__n", "__q")


def events_of(text: str) -> Column:
    """An answer as an array of JSON lines, one meta, a delta for each line of text, one done."""
    deltas = F.transform(F.split(text, "\n"), lambda t: F.to_json(F.struct(F.lit("delta").alias("type"), t.alias("text"))))
    return F.concat(F.array(F.lit('{"type":"meta"}')), deltas, F.array(F.lit('{"type":"done"}')))


def event_lines(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, line): an answer as JSON lines."""
    return answers.select(key, F.posexplode(events_of(text)).alias("seq", "line"))


def assemble(lines: DataFrame, key: str) -> DataFrame:
    """(key, reply, n_deltas, complete) from JSON lines; lines that don't parse are skipped."""
    parsed = lines.select(key, "seq", F.from_json("line", "type string, text string").alias("e")).where("e.type IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.when(F.col("e.type") == "delta", F.struct("seq", F.col("e.text").alias("text")))))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return parsed.groupBy(key).agg(text.alias("reply"), F.count_if(F.col("e.type") == "delta").alias("n_deltas"), F.bool_or(F.col("e.type") == "done").alias("complete"))


def sse_deltas(lines: DataFrame, line: str) -> DataFrame:
    """lines with delta: the content of a data: line of a server-sent stream, null for others and [DONE]."""
    data = F.regexp_extract(F.col(line), r"^data:\s*(.*)$", 1)
    return lines.withColumn("delta", F.when((data != "") & (data != "[DONE]"), F.get_json_object(data, "$.choices[0].delta.content")))


def mask_keys(keys: DataFrame, token: str) -> DataFrame:
    return keys.withColumn(token, F.concat(F.lit("****"), F.right(F.col(token), F.lit(6))))


def add_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """Keys (token, name, limit, disabled) with new ones (name, limit), each with a random token; a table to be written once, as it draws them."""
    return keys.unionByName(new.select(F.sha2(F.concat("name", F.uuid()), 256).alias("token"), "name", "limit", F.lit(False).alias("disabled")), allowMissingColumns=True)


def disable_keys(keys: DataFrame, which: Column) -> DataFrame:
    return keys.withColumn("disabled", F.col("disabled") | F.coalesce(which, F.lit(False)))


def delete_keys(keys: DataFrame, which: Column) -> DataFrame:
    return keys.where(~F.coalesce(which, F.lit(False)))
