"""Word documents as ordered paragraphs.

Files are found and read by Spark (binaryFile), one row a file; each is unzipped and parsed where it was read.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from textloom.functions import text as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "file string, pos int, text string, style string, first_bold boolean, runs array<struct<text:string,bold:boolean>>"


def _on(properties: ElementTree.Element | None) -> bool:
    bold = None if properties is None else properties.find(f"{W}b")
    return bold is not None and bold.get(f"{W}val", "1") not in ("0", "false")


def parse(data: bytes) -> Iterator[tuple[str, str | None, bool, list[dict]]]:
    """(text, style, first_bold, runs) of each body paragraph, in order, empty ones included."""
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
        body = ElementTree.parse(f).getroot().find(f"{W}body")
    for p in [] if body is None else body.findall(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        first = p.find(f".//{W}rPr")
        runs = [{"text": "".join(t.text or "" for t in r.iter(f"{W}t")), "bold": _on(r.find(f"{W}rPr"))} for r in p.iter(f"{W}r")]
        yield "".join(r["text"] for r in runs).strip(), None if style is None else style.get(f"{W}val"), first is not None and first.find(f"{W}b") is not None, runs


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """paragraphs_of all Word files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return paragraphs_of(files)


def paragraphs_of(files: DataFrame) -> DataFrame:
    """(file, pos, text, style, first_bold, runs, bold) of Word files (path, content).

    Two senses of bold are kept apart: first_bold says that the first run properties name it, bold that half or more
    of the non-blank characters are. A file that is no Word document gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows = list(parse(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame([(name, k, *r) for k, r in enumerate(rows)], columns=["file", "pos", "text", "style", "first_bold", "runs"])

    parsed = files.select("path", "content").mapInPandas(run, SCHEMA)
    return parsed.withColumn("bold", T.bold_share("runs") >= 0.5)
