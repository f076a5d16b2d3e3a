"""Overlapping chunks of a text: ends snap back to white space within a limit, starts to white space before them."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import ship_package

#: Sizes for unusable arguments, and how far an end may snap back.
DEFAULT_SIZE, DEFAULT_OVERLAP, SNAP = 1500, 200, 150
_BOUNDARY = regex.compile(r"[ \n]")


def spans(text: str, size: int = 800, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the chunks, in code points. Boundaries are blanks and line feeds; one sorted list of them serves both searches."""
    size = size if size > 0 else DEFAULT_SIZE
    overlap = overlap if 0 < overlap < size else DEFAULT_OVERLAP
    marks = [m.start() for m in _BOUNDARY.finditer(text)]
    n, start, out = len(text), 0, []
    while n:
        end = start + size
        if end >= n:
            out.append((start, n))
            break
        k = bisect.bisect_right(marks, end) - 1
        if k >= 0 and marks[k] > max(end - SNAP, start):
            end = marks[k]
        out.append((start, end))
        back = end - overlap
        k = bisect.bisect_left(marks, back) - 1
        if k >= 0 and marks[k] + 1 > start:
            back = marks[k] + 1
        start = max(back, start + 1)
    return out


def chunk(documents: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, content) of each document; null and empty texts have no chunks."""
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index, content = [], [], []
            for k, t in zip(batch.column(0), batch.column(1)):
                s = t.as_py()
                for i, (a, b) in enumerate(spans(s, size, overlap)):
                    keys.append(k)
                    index.append(i)
                    content.append(s[a:b])
            yield pa.record_batch([pa.array([k.as_py() for k in keys], batch.column(0).type), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=["k", "chunk_index", "content"])

    return rows.mapInArrow(run, f"k {kind}, chunk_index int, content string").withColumnRenamed("k", key)
