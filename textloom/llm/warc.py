"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: records of equal payload digest are one response (the largest page id) and revisits of it. Reading: tasks own byte
ranges of the files and cut them at the record magic, which also occurs inside payloads. So they emit every candidate with the
offset where its record would end; pointer jumping from each file's start then marks what a chain of true records reaches,
doubling its stride each round, and all other candidates are dropped. A chain that doesn't end with its file is damage.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_rows, broadcast_if_small, cut, remove, shared_dir

CRLF = "\r\n"
MAGIC = b"WARC/1.0\r\n"
#: Payloads of fewer bytes are stored each on its own.
MIN_BYTES = 0
#: Records in a file at most: bounds the rounds of reading to the logarithm of this. Large files are read by many tasks.
RECORDS_PER_FILE = 1000
PROFILE = "http://netpreservation.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "file string, off long, next long, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, sound boolean"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits at a time are four letters."""
    digits = F.sha1(payload)
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        v = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id and the text of a record for each page, without the two line ends after it.

    Only digests that occur twice or more are joined back, broadcast if they are few; pre-aggregation keeps a payload
    that a third of all pages have from making a large group.
    """
    one = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")
    base = pages.select("page_id", one("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    twice = base.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first")
    joined = base.join(broadcast_if_small(cut(twice), 48), "digest", "left")
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("first"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
    )
    return joined.select(F.concat(head, F.lit(CRLF * 2), block).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives under path: one or more files for each task, committed as a whole, so a lost executor leaves no half file."""
    records(pages, min_bytes).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, content) of what lies between two places of the magic, by tasks that own byte ranges of the files.

    Files are split at any byte; a chunk belongs to the range that the magic before it begins in, so none is read twice.
    """
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("content"))


def header(content: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and where the block begins; None if this is no record's beginning."""
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in content[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return (fields, end + 4) if fields.get("content-length", "").isdecimal() else None


def payload(fields: dict[str, str], block: bytes) -> dict:
    """What a record's whole block says: payload_bytes, payload_digest and sound."""
    cut_at = block.find(b"\r\n\r\n")
    at = cut_at + 4 if cut_at >= 0 else 0
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "revisit":
        length = re.search(rb"(?i)(?:^|\r\n)content-length: *(\d+)", block[:at])
        return {"payload_bytes": int(length[1]) if length else None, "payload_digest": digest, "sound": length is not None}
    found = b32encode(hashlib.sha1(block[at:]).digest()).decode()
    return {"payload_bytes": len(block) - at, "payload_digest": found, "sound": found == digest}


def named(fields: dict[str, str]) -> dict:
    return {"page_id": _page(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to"))}


SCAN = f"{SCHEMA}, size long, block long, at long, taken long, whole boolean"
KINDS = dict.fromkeys(["page_id", "refers_to", "payload_bytes", "off", "next", "size", "block", "at", "taken"], "Int64") | {"sound": "boolean", "whole": "boolean"}


def framed(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows as columns of their kinds, also where none has a value."""
    return pd.DataFrame({c: pd.array([r.get(c) for r in rows], KINDS[c]) if c in KINDS else pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each chunk: at, and, where it may begin a record, off and next, all counted from the first chunk of its byte range.

    taken is the length of the chunk and the magic after it; whole says that the record ends with the chunk, payload included.
    """
    columns, key, at = [x.split()[0] for x in SCAN.split(", ")], None, 0
    for f in frames:
        rows = []
        for name, size, block, content in zip(f["file"], f["size"], f["block"], f["content"], strict=True):
            if key != (name, block):
                key, at = (name, block), 0
            row = {"file": name, "size": size, "block": block, "at": at, "taken": len(content) + len(MAGIC), "whole": False}
            if found := header(content):
                fields, start = found
                stop = start + int(fields["content-length"])
                # the record's own magic lies before the chunk
                row |= {"off": at - len(MAGIC), "next": at + stop + 4, "whole": stop + 4 == len(content) and content[stop:] == b"\r\n\r\n"} | named(fields)
                if row["whole"]:
                    row |= payload(fields, content[start:stop])
            rows.append(row)
            at += row["taken"]
        yield framed(rows, columns)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk of the files under path; off and next are null where its header doesn't parse."""
    with arrow_rows(spark, 32):  # a few payloads at a time
        found = cut(chunks(spark, path).mapInPandas(scan, SCAN))
    # ranges of a file are few; a range begins where the chunks of those before it end
    ranges = found.groupBy("file", "block").agg(F.sum("taken").alias("taken"))
    base = F.sum("taken").over(Window.partitionBy("file").orderBy("block")) - F.col("taken")
    placed = found.drop("taken").join(broadcast_if_small(cut(ranges.select("file", "block", base.alias("base")), 0), 160), ["file", "block"])
    return placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "off", "next")}).drop("base")


def reachable(jumps: DataFrame) -> DataFrame:
    """(file, off) of the candidates that a chain of successors reaches from offset 0; jumps: (file, off, next).

    Pointer jumping: after k rounds a jump spans 2**k records, and all within that many of the start are marked.
    """
    jumps = cut(jumps.select("file", "off", "next"))
    rows = jumps.count()
    seen = cut(jumps.where("off = 0").select("file", "off"), rows)
    n = seen.count()
    while n:
        further = seen.join(jumps, ["file", "off"]).select("file", F.col("next").alias("off"))
        seen = cut(seen.union(further).distinct(), rows)
        m = seen.count()
        if m == n:
            break
        n = m
        ahead = jumps.select("file", F.col("off").alias("next"), F.col("next").alias("then"))
        jumps = cut(jumps.join(ahead, ["file", "next"]).select("file", "off", F.col("then").alias("next")), rows)
    return seen


def joined_blocks(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Rows of SCHEMA for true records (broken: file, off, next) whose payloads hold the magic, put together from their chunks.

    Which chunk lies in which record is told by a window over offsets alone. Only chunks of such records are shuffled, to the
    record they lie in; each task then holds one record's payload.
    """
    starts = broken.select("file", (F.col("off") + len(MAGIC)).alias("at"), "off", "next")
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.select("file", "block", "at").join(starts, ["file", "at"], "left")
    marked = marked.select("file", "block", "at", F.last("off", True).over(last).alias("off"), F.last("next", True).over(last).alias("next")).where("at < next")
    first = found.groupBy("file", "block").agg(F.min("at").alias("base"))
    inside = cut(marked.join(first, ["file", "block"]).select("file", "block", (F.col("at") - F.col("base")).alias("at"), F.col("at").alias("place"), "off", "next"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at = None, 0
        for f in frames:
            offs = []
            for name, block, content in zip(f["file"], f["block"], f["content"], strict=True):
                if key != (name, block):
                    key, at = (name, block), 0
                offs.append(at)
                at += len(content) + len(MAGIC)
            yield pd.DataFrame({"file": f["file"].tolist(), "block": f["block"].tolist(), "at": offs, "content": f["content"].tolist()})

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        row = {"file": g["file"].iloc[0], "off": int(g["off"].iloc[0]), "next": int(g["next"].iloc[0])}
        content = MAGIC.join(g["content"])[: row["next"] - row["off"] - len(MAGIC)]
        fields, start = header(content)
        row |= named(fields) | payload(fields, content[start:-4])
        return framed([row | {"sound": row["sound"] and content.endswith(b"\r\n\r\n")}], [x.split()[0] for x in SCHEMA.split(", ")])

    with arrow_rows(spark, 32):
        some = cut(chunks(spark, path).join(broadcast_if_small(cut(broken.select("file").distinct()), 200), "file", "left_semi").mapInPandas(place, "file string, block long, at long, content binary"))
    return some.join(inside, ["file", "block", "at"]).groupBy("file", "off").applyInPandas(build, SCHEMA)


def verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all chunks; the true records among them; for each file: file, size and read_to, where its chain of records ends)."""
    found = candidates(spark, path)
    begins = found.where("off >= 0")  # what lies before a file's first magic begins no record
    true = cut(begins.join(reachable(begins), ["file", "off"]))
    ends = found.select("file", "size").distinct().join(true.groupBy("file").agg(F.max("next").alias("read_to")), "file", "left")
    return found, true, ends.select("file", "size", F.coalesce("read_to", F.lit(0)).alias("read_to"))


class DamagedArchive(ValueError):
    """A file's chain of records does not end where the file does."""


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The true records of the archives under path, one row each (columns of SCHEMA).

    sound tells that a response's payload has the digest its header names. An empty folder gives an empty table. A file whose
    chain breaks, or ends before or after the file does, raises DamagedArchive; unless strict, records up to there are returned, and
    damage() tells the rest.
    """
    found, true, ends = verified(spark, path)
    if strict and (bad := ends.where("read_to <> size").limit(5).collect()):
        raise DamagedArchive("; ".join(f"{r['file']}: records end at byte {r['read_to']} of {r['size']}" for r in bad))
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    broken = cut(true.where("NOT whole AND next <= size").select("file", "off", "next"), 0)
    whole = true.where("whole").select(*columns)
    return whole if broken.isEmpty() else whole.unionByName(joined_blocks(spark, path, found, broken))


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, read_to) of the archives whose chain of records does not end with the file."""
    return verified(spark, path)[2].where("read_to <> size")


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in the shared folder and returns what reading them gives; then the files go.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri and sound for each row of pages. Null html: empty payload.
    Null url: empty. Of rows that repeat a page in full, all with the largest id of their payload are responses. A null page_id
    reads back as null, and is a revisit if a row with an id has the same payload. No page, no file. A payload of any length that
    holds the magic is put together by one task. Other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    # what read() returns rests on tables it has written, not on the archives any more
    found = read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "sound")
    remove(spark, path)
    return found
