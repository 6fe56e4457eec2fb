"""Index steps by cursor, keyed vectors, entries that expire, keys of callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Articles in a step at most; lifetimes in seconds; requests a day by a key without a limit of its own.
STEP = 25
QUOTA_TTL, ANSWER_TTL, FEEDBACK_TTL = 25 * 3600, 7 * 86400, 400 * 86400
KEY_LIMIT = 2000


def clamp(limit: int | None, most: int = STEP) -> int:
    return most if limit is None else max(1, min(most, limit))


def batch(articles: DataFrame, cursor: int, limit: int | None = None) -> DataFrame:
    """The articles (ord from 0, …) of the step at cursor: ord is filtered where the table is scanned, so nothing else is read."""
    return articles.where(F.col("ord").between(cursor, cursor + clamp(limit) - 1))


def step(articles: DataFrame, chunks: DataFrame, cursor: int, limit: int | None = None, article: str = "id") -> DataFrame:
    """One row (cursor, done, total, limit, articles, chunks): where the next step begins, and what this one indexed."""
    n = clamp(limit)
    some = batch(articles, cursor, limit)
    total = articles.agg(F.count("*").alias("total"))
    mine = some.agg(F.count("*").alias("articles")).crossJoin(chunks.join(some.select(article), article, "left_semi").agg(F.count("*").alias("chunks")))
    out = total.crossJoin(mine)  # one row each
    return out.select(F.lit(cursor + n).cast("long").alias("cursor"), (F.lit(cursor + n) >= F.col("total")).alias("done"), "total", F.lit(n).alias("limit"), "articles", "chunks")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows by key, the latest of each: what new has replaces what is stored, and of several new rows of a key that of the greatest version.

    A hot key's rows are cut to one by each task before they are shuffled.
    """
    columns = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("__new", version)).alias("r"))
    return last.select(*keys, "r.*")


def put(entries: DataFrame, key: Column, value: Column, at: str, seconds: int) -> DataFrame:
    """(key, value, expires_at) to append to a key-value table."""
    expires = (F.col(at).cast("timestamp").cast("double") + F.lit(seconds)).cast("timestamp")
    return entries.select(key.alias("key"), value.alias("value"), expires.alias("expires_at"))


def live(kv: DataFrame, now: Column, prefix: str = "", most: int | None = None) -> DataFrame:
    """Entries of a key-value table that have not expired and whose keys have the prefix, the latest of each key, in the order of keys."""
    held = kv.where((F.col("expires_at") > now) & F.col("key").startswith(prefix))
    one = held.groupBy("key").agg(F.max_by("value", "expires_at").alias("value"), F.max("expires_at").alias("expires_at"))
    return one if most is None else one.orderBy("key").limit(most)


def feedback(votes: DataFrame, at: str, nonce: str) -> DataFrame:
    """Entries of votes (vote, question, note, reply) that are up or down and have a question, cut to their lengths, kept 400 days.

    The key is the time in milliseconds and a nonce, so keys in their order are votes in theirs.
    """
    clip = lambda c, n: F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(n))
    good = votes.where(F.col("vote").isin("up", "down") & (F.coalesce("question", F.lit("")) != ""))
    key = F.concat(F.lit("fb:"), F.unix_millis(F.col(at).cast("timestamp")).cast("string"), F.lit(":"), F.col(nonce).cast("string"))
    value = F.to_json(F.struct(clip("question", 300).alias("q"), "vote", clip("note", 500).alias("note"), clip("reply", 600).alias("a")))
    return put(good, key, value, at, FEEDBACK_TTL)


def feedback_report(kv: DataFrame, now: Column, most: int = 150, scanned: int = 1000) -> DataFrame:
    """One row (up, down, total) over the newest entries of the first so many keys; entries that can't be read count nothing."""
    newest = live(kv, now, "fb:", scanned).orderBy(F.desc("key")).limit(most)
    vote = F.get_json_object("value", "$.vote")
    sums = newest.agg(F.count_if(vote == "up").alias("up"), F.count_if(vote == "down").alias("down"))
    return sums.withColumn("total", F.col("up") + F.col("down"))


def authenticate(requests: DataFrame, keys: DataFrame, first_party: Column, require_key: bool = True) -> DataFrame:
    """requests (…, token) with kind (key, ip or null), principal, name, daily_limit and status (200 or 401).

    A token must be in keys (token, name, limit, disabled) and not disabled; the principal is the beginning of its hash. Without a
    token a first-party request counts by address, and any other is refused unless keys are not required. Keys are a small table.
    """
    known = keys.select("token", F.col("name").alias("__name"), F.col("limit").alias("__limit"), F.coalesce("disabled", F.lit(False)).alias("__off"))
    out = requests.join(known, "token", "left")
    named = F.col("token").isNotNull() & (F.col("token") != "")
    good = named & F.col("__off").isNotNull() & ~F.coalesce("__off", F.lit(True))
    open_ = ~named & (first_party | F.lit(not require_key))
    kind = F.when(good, "key").when(open_, "ip")
    return out.select(
        *requests.columns, kind.alias("kind"), F.when(good, F.left(F.sha2("token", 256), F.lit(16))).alias("principal"), F.when(good, F.coalesce(F.nullif(F.col("__name"), F.lit("")), F.lit("key"))).alias("name"),
        F.when(good, F.coalesce("__limit", F.lit(KEY_LIMIT))).alias("daily_limit"), F.when(kind.isNotNull(), 200).otherwise(401).alias("status"),
    )


def citation_excerpt(text: Column | str, mark: str = "（白话）") -> Column:
    """The source side of a passage; all of it where there is none but a translation."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    first = F.trim(F.element_at(F.split(t, f"\n{mark}"), 1))
    return F.when((first != "") & ~first.startswith(mark), first).otherwise(F.trim(t))


def by_index(parts: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, values): an answer's values in the order of their index, in whatever order they came."""
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias("values"))


def tiers(results: list[DataFrame], group: str) -> DataFrame:
    """Of several results for each group, the rows of the first that has any, with its tier from 0."""
    every = None
    for n, df in enumerate(results):
        tagged = df.withColumn("tier", F.lit(n))
        every = tagged if every is None else every.unionByName(tagged)
    return every.withColumn("__t", F.min("tier").over(Window.partitionBy(group))).where("tier = __t").drop("__t")
