"""Articles as JSON: the published model, the intermediate one, their catalog, and the tables made of them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.storage import keep

NOTE = "struct<n:int,term:string,text:string>"
SEGMENT = f"struct<orig:array<string>,trans:array<string>,notes:array<{NOTE}>,src:string,srcId:string>"
BACKREF = "struct<id:string,title:string,n:int>"
PUBLISHED = (
    f"id string, volume string, volumeName string, juan string, category string, title string, translator string, summary string, segments array<{SEGMENT}>, "
    f"anomalies array<string>, plain boolean, untitled boolean, backrefs array<{BACKREF}>, _corrupt_record string"
)
PART = "struct<o:string,t:string,os:array<string>,ts:array<string>,src:string,n:int,note:string>"
INTERMEDIATE = f"id string, title string, translator string, summary string, part string, segments array<{PART}>, _corrupt_record string"
ITEM = "struct<id:string,title:string,paired:boolean,plain:boolean,notes:int>"
CATALOG = f"id string, name string, group string, juans array<struct<name:string,cats:array<struct<name:string,items:array<{ITEM}>>>>>, _corrupt_record string"


def read(spark: SparkSession, path: str, schema: str = PUBLISHED) -> DataFrame:
    """One row for each JSON file under path, with its file name; files that don't parse are left out."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    return found.withColumn("file", F.input_file_name()).where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def write(articles: DataFrame, path: str, by: str = "volume") -> None:
    """Articles by volume; volumes that are written replace their old files, others stay."""
    articles.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_json(articles: DataFrame, path: str, by: str = "volume") -> None:
    """Articles by volume as JSON, a line each, characters as they are; volumes that are written replace their old files."""
    articles.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_by_volume(spark: SparkSession, path: str, schema: str = PUBLISHED) -> DataFrame:
    """What write_json wrote; a volume's filter reads its folder alone. Lines that don't parse are left out."""
    found = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return found.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def read_indexed(spark: SparkSession, path: str, index: DataFrame, key: str = "key", schema: str = INTERMEDIATE) -> DataFrame:
    """Articles stored in a folder for each key, as far as an index (key, …) names them: only those folders are opened."""
    found = spark.read.schema(f"{schema}, `{key}` string").option("mode", "PERMISSIVE").json(path)
    named = found.join(index.select(F.col(key).cast("string")).distinct(), key, "left_semi")
    return named.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def scanned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each JSON line under path with its file, also for those that don't parse, whose text _corrupt_record has; read once and kept."""
    found = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return keep(found.withColumn("file", F.regexp_extract(F.input_file_name(), r"[^/]*$", 0)))


def sound(found: DataFrame) -> DataFrame:
    """The articles of a scan: what parses and has an id."""
    return found.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def quarantined(found: DataFrame) -> DataFrame:
    """(file, reason, record) of what a scan couldn't take: broken lines as they are, and articles without an id."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), "broken").otherwise("no id")
    return found.where("_corrupt_record IS NOT NULL OR id IS NULL").select("file", reason.alias("reason"), F.col("_corrupt_record").alias("record"))


def scan_report(found: DataFrame) -> DataFrame:
    """(articles, broken, no_id): what a scan gave, in one row."""
    bad = F.col("_corrupt_record").isNotNull()
    return found.agg(F.count_if(~bad & F.col("id").isNotNull()).alias("articles"), F.count_if(bad).alias("broken"), F.count_if(~bad & F.col("id").isNull()).alias("no_id"))


def one(articles: DataFrame, article: str) -> DataFrame:
    """One article: the filter goes to the scan."""
    return articles.where(F.col("id") == article)


def held(articles: DataFrame) -> DataFrame:
    """The corpus kept in the executors' memory after its first use, on disk where that is too small."""
    return articles.persist(StorageLevel.MEMORY_AND_DISK)


def write_search_text(articles: DataFrame, path: str) -> None:
    """The search corpus as compact JSON lines, by volume."""
    search_text(articles).write.partitionBy("volume").mode("overwrite").json(path)


def catalog_items(catalog: DataFrame) -> DataFrame:
    """(volume, v, j, c, i, juan, category, id, title, …): a row for each item, with the places that order it."""
    step = catalog.select(F.col("id").alias("volume"), "group", F.posexplode("juans").alias("j", "juan"))
    step = step.select("volume", "group", "j", F.col("juan.name").alias("juan"), F.posexplode("juan.cats").alias("c", "cat"))
    return step.select("volume", "group", "j", "c", "juan", F.col("cat.name").alias("category"), F.posexplode("cat.items").alias("i", "item")).select("volume", "group", "j", "c", "i", "juan", "category", "item.*")


def search_text(articles: DataFrame) -> DataFrame:
    """(id, volume, title, body): summary, then each segment's orig, trans, src and notes, a line each."""
    each = F.transform("segments", lambda s: F.concat(F.coalesce(s["orig"], F.array()), F.coalesce(s["trans"], F.array()), F.array(F.coalesce(s["src"], F.lit(""))), F.coalesce(F.transform(s["notes"], lambda n: n["text"]), F.array())))
    lines = F.filter(F.concat(F.array(F.coalesce("summary", F.lit(""))), F.flatten(each)), lambda x: x.isNotNull() & (x != ""))
    return articles.select("id", "volume", "title", F.array_join(lines, "\n").alias("body"))


def chunk_sources(articles: DataFrame) -> DataFrame:
    """(aid, seg, kind, p, text): what is cut into chunks.

    Equal non-empty sides make pairs, joined; otherwise each side's paragraphs stand alone; plain articles' always do. p
    counts paragraphs as readers see them: a pair is two, and empty ones count although they give no row.
    """
    segments = articles.select(F.col("id").alias("aid"), F.coalesce("plain", F.lit(False)).alias("plain"), F.posexplode("segments").alias("seg", "s"))
    orig, trans = F.coalesce("s.orig", F.array().cast("array<string>")), F.coalesce("s.trans", F.array().cast("array<string>"))
    paired = ~F.col("plain") & (F.size(orig) == F.size(trans)) & (F.size(orig) > 0)
    mark = F.lit("\n（白话）")
    both = F.zip_with(orig, trans, lambda o, t: F.struct(F.lit("pair").alias("kind"), F.concat(o, mark, t).alias("text"), F.lit(2).alias("step"), ((o == "") & (t == "")).alias("empty")))
    single = lambda side, kind: F.transform(side, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"), F.lit(1).alias("step"), (x == "").alias("empty")))
    rows = segments.select("aid", "seg", F.posexplode(F.when(paired, both).otherwise(F.concat(single(orig, "orig"), single(trans, "trans")))).alias("k", "r"))
    before = Window.partitionBy("aid").orderBy("seg", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("p", F.coalesce(F.sum("r.step").over(before), F.lit(0)))
    return placed.where("NOT r.empty").select("aid", "seg", "r.kind", "p", "r.text")


def paired_flags(articles: DataFrame) -> DataFrame:
    """(id, converted, migrated, aligned, notes): the three senses of an article's sides being paired, and its notes."""
    even = F.forall(F.filter("segments", lambda s: F.size(s["trans"]) > 0), lambda s: F.size(s["orig"]) == F.size(s["trans"]))
    any_trans = F.exists("segments", lambda s: F.size(s["trans"]) > 0)
    notes = F.aggregate("segments", F.lit(0), lambda a, s: a + F.greatest(F.size(s["notes"]), F.lit(0)))
    return articles.select("id", (even & ~F.coalesce("plain", F.lit(False))).alias("converted"), even.alias("migrated"), any_trans.alias("aligned"), notes.alias("notes"))


def term_dictionary(articles: DataFrame) -> DataFrame:
    """(term, a, n, ord): a row for each note with a term, in the order met."""
    each = articles.select("id", F.posexplode("segments").alias("seg", "s")).select("id", "seg", F.posexplode("s.notes").alias("k", "note"))
    w = Window.partitionBy("note.term").orderBy("id", "seg", "k")
    return each.where("note.term <> ''").select(F.col("note.term").alias("term"), F.col("id").alias("a"), F.col("note.n").alias("n"), F.row_number().over(w).alias("ord"))


def replace_volume(terms: DataFrame, new: DataFrame, volume: str) -> DataFrame:
    """terms with the entries of one volume replaced by new's."""
    return terms.where(~F.col("a").startswith(f"{volume}-")).unionByName(new)


def as_dictionary(terms: DataFrame) -> DataFrame:
    """(term, entries): a row for each term that has entries, which are in the order of article and number."""
    ordered = F.array_sort(F.collect_list(F.struct("a", "n")))
    return terms.where("term IS NOT NULL AND term <> ''").groupBy("term").agg(ordered.alias("entries"))
