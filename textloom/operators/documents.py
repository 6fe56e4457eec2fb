"""Emitted and parsed documents: injection, title expansion, reading lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def inject(pages: DataFrame, html: str, block: str, sign: str) -> DataFrame:
    """pages with block before the first </head>, and status: present (sign is there already), injected or no head."""
    at = F.instr(F.col(html), "</head>")
    status = F.when(F.col(html).contains(sign), "present").when(at > 0, "injected").otherwise("no head")
    put = F.concat(F.substr(F.col(html), F.lit(1), at - 1), F.lit(block), F.substr(F.col(html), at))
    return pages.withColumn("status", status).withColumn(html, F.when(F.col("status") == "injected", put).otherwise(F.col(html)))


def expand_titles(titles: DataFrame, title: str, count: str) -> DataFrame:
    """(…, n, i, canon, alias): a title with a count of two or more stands for so many numbered ones, each by several names."""
    each = titles.withColumn("i", F.explode(F.sequence(F.lit(1), F.col(count))))
    numeral = T.num_to_cn("i")
    many = F.col(count) >= 2
    canon = F.when(many, F.concat(F.col(title), F.lit("（"), numeral, F.lit("）"))).otherwise(F.col(title))
    plain = F.concat(F.col(title), numeral)
    names = F.when(~many, F.array(F.col("canon"))).when(F.col("i") == 1, F.array(F.col("canon"), plain, F.col(title))).otherwise(F.array(F.col("canon"), plain))
    return each.withColumn("canon", canon).withColumn("alias", F.explode(names))


def reading_list(lists: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, sec, name, marked): names between white space; （以上 X） names the section of those before it, the rest are 其他.

    A section is named without white space, a full stop in it as a middle dot. ◎ at the beginning of a line, or of what follows a section's
    end, marks the first name there and no other.
    """
    cut = F.regexp_replace(F.col(body), r"（以上(?U)\s*([^）]*)）", "\n§$1\n")
    parts = lists.select(key, F.posexplode(F.split(cut, "\n")).alias("p", "s"))
    # from the last row on: a frame that grows is kept up, one that shrinks is computed anew for each row
    after = Window.partitionBy(key).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("s").startswith("§"), F.replace(T.squash_ws(F.substr("s", F.lit(2))), F.lit("."), F.lit("·")))
    named = parts.withColumn("sec", F.coalesce(F.last(title, ignorenulls=True).over(after), F.lit("其他"))).where(~F.col("s").startswith("§"))
    own = T.strip("s")
    names = F.array_remove(F.split(T.strip(F.regexp_replace(own, "^◎+", "")), r"(?U)\s+"), "")
    each = named.select(key, "p", "sec", own.startswith("◎").alias("m"), F.posexplode(names).alias("i", "name"))
    pos = (F.row_number().over(Window.partitionBy(key).orderBy("p", "i")) - 1).cast("int")
    return each.select(key, pos.alias("pos"), "sec", "name", (F.col("m") & (F.col("i") == 0)).alias("marked"))
