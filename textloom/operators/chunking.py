"""Overlapping chunks of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

SIZE, OVERLAP, CONTEXT, LEAST = 720, 80, 1100, 0.45
#: Texts that Python should get at a time, as they may be long.
TEXTS = 256


def split_text(text: str, marks: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of size characters, each ended after its last mark if that lies beyond 45 per cent, the next overlapping it."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = max(text.rfind(m, start, end) for m in marks) - start
            if cut > size * LEAST:
                end = start + cut + 1
        part = text[start:end].strip()
        if part:
            out.append(part)
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", marks: str = "。；！？\n") -> DataFrame:
    """(key, part, chunk, ctx): chunks in order, and the first characters of the whole text as their context.

    The next start depends on the last cut, which no column expression can say, hence one Arrow function over texts.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_text(t, marks) if t else [])

    cut = F.pandas_udf(run, "array<string>")
    stripped = docs.select(key, T.strip(F.coalesce(text, F.lit(""))).alias("t"))
    return stripped.select(key, F.posexplode(cut("t")).alias("part", "chunk"), F.left("t", F.lit(CONTEXT)).alias("ctx"))
