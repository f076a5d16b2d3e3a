"""Splitting oversized items at natural boundaries.

Each place of a text has a boundary strength: paragraph 4, line 3, sentence 2, other white space 1, none 0. A sparse
table answers range-maximum queries over the strengths, so the strongest cut of each permissible window is found at
once; of equal ones the rightmost is taken. The next piece starts up to ``overlap`` characters before the cut, at a
boundary where there is one.

Defined results
* Lengths are code points; white space is Unicode's White_Space. Pieces are the text's own characters, untrimmed.
* An item within the limit is one piece; an empty text is one empty piece; a null text or id gives none.
* A cut inside a run without white space is made only where such a run is longer than the limit; it is marked hard.
* Pieces are numbered from 0 within their item. Equal rows give equal pieces twice. renumbered() numbers them anew
  within a document, in the order of its items.
* Texts of 2**24 characters and more are cut like others; strengths and places are kept in one 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize, ship_package

BLOCK = 1 << 16
#: Fixed value: the Unicode White_Space characters.
WHITE_SPACE = np.array([*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class RangeMax:
    """Sparse table over the strengths of places base..base+len-1; keys order by strength, then by place."""

    def __init__(self, strength: np.ndarray, base: int, widest: int):
        self.base = base
        level = (strength.astype(np.int64) << 32) | np.arange(len(strength), dtype=np.int64)
        self.levels = [level]
        step = 1
        while 2 * step <= min(widest, len(strength)):
            level = np.maximum(level[: len(level) - step], level[step:])
            self.levels.append(level)
            step *= 2

    def best(self, low: int, high: int) -> tuple[int, int]:
        """Strength and place of the strongest cut of low..high, the last of equals."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        key = max(int(level[low - self.base]), int(level[high - self.base - (1 << k) + 1]))
        return key >> 32, (key & 0xFFFFFFFF) + self.base


def strengths(points: np.ndarray) -> np.ndarray:
    """Strength of a cut before each place 0..n."""
    n = len(points)
    white = np.isin(points, WHITE_SPACE)
    line = (points == 10) | (points == 13)
    out = np.zeros(n + 1, np.int8)
    out[:n][white] = 1
    after = white.astype(np.int8)
    ends = np.isin(points, np.array([ord(c) for c in ".!?…"], np.uint32))
    after[1:][white[1:] & ends[:-1]] = 2
    after[line] = 3
    after[1:][line[1:] & line[:-1] & ~((points[1:] == 10) & (points[:-1] == 13))] = 4
    out[1:] = np.maximum(out[1:], after)
    return out


def split(points: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of the pieces of a text."""
    n = len(points)
    if n <= limit:
        return [(0, n, False)]
    out: list[tuple[int, int, bool]] = []
    start, end, table, strong = 0, 0, None, None
    cut = strengths(points)
    while True:
        if n - start <= limit:
            out.append((start, n, False))
            return out
        if table is None or start + limit > table.base + len(table.levels[0]) - 1 or start < table.base:
            table = RangeMax(cut[start : start + max(BLOCK, limit + 1)], start, limit + 1)
        low, high = max(end + 1, start + 1, start + limit // 2), start + limit
        strong, place = table.best(low, high)
        if not strong and low > max(end, start) + 1:
            strong, place = table.best(max(end, start) + 1, low - 1)
        if not strong and start < end:
            start = end  # without overlap the window reaches further
            continue
        end = place if strong else high
        out.append((start, end, not strong))
        earliest = max(start + 1, end - overlap)
        back = np.flatnonzero(cut[earliest:end])
        start = earliest + int(back[0]) if len(back) else earliest


PIECES = "k long, piece_index int, content string, start_at int, end_at int, hard boolean"


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                for i, (a, b, hard) in enumerate(split(points, limit, overlap)):
                    rows.append((key, i, text[a:b], a, b, hard))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["k", "piece_index", "content", "start_at", "end_at", "hard"])

    return run


def split_oversized(items: DataFrame, id_col: str, text_col: str, limit: int = 800, overlap: int = 100, whole: bool = True) -> DataFrame:
    """Pieces (id, chunk_index, content, start_at, end_at, hard) of every item; whole=False leaves out items within the limit.

    Items within the limit never leave the JVM.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap smaller")
    ship_package(items.sparkSession)
    rows = items.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).where("k is not null and t is not null")
    out = rows.where(F.length("t") > limit).mapInArrow(_pieces(limit, overlap), PIECES)
    if whole:
        short = rows.where(F.length("t") <= limit).select("k", F.lit(0).alias("piece_index"), F.col("t").alias("content"), F.lit(0).alias("start_at"), F.length("t").alias("end_at"), F.lit(False).alias("hard"))
        out = short.unionByName(out)
    return out.withColumnRenamed("piece_index", "chunk_index").withColumnRenamed("k", id_col)


#: Tables of at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000
#: Items of a document that are numbered in one task.
NUMBER_BLOCK = 4_096


def renumbered(pieces: DataFrame, items: DataFrame, id_col: str, doc_col: str, order_col: str) -> DataFrame:
    """Pieces with their document and chunk_index from 0 on within it, its items in the order of order_col, then id.

    items: one row for each id; null documents count as one, null places come first. A large document is numbered by blocks of
    neighbouring places, of which only the counts meet in one task.
    """
    counts = pieces.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n"))
    own = items.select(F.col(id_col).cast("long").alias("i"), F.col(doc_col).alias("d"), F.coalesce(F.col(order_col).cast("long"), F.lit(-1)).alias("o"))
    own = own.withColumn("b", F.floor(F.col("o") / NUMBER_BLOCK))
    keyed = materialize(own.join(counts, "i"), "piece-counts")
    blocks = keyed.groupBy("d", "b").agg(F.sum("n").alias("m"))
    before = blocks.select("d", "b", (F.sum("m").over(Window.partitionBy("d").orderBy("b")) - F.col("m")).alias("earlier"))
    inside = Window.partitionBy("d", "b").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, 0)
    places = keyed.withColumn("within", F.sum("n").over(inside) - F.col("n")).alias("k")
    places = places.join(before.alias("e"), F.col("k.d").eqNullSafe(F.col("e.d")) & (F.col("k.b") == F.col("e.b")))
    places = places.select(F.col("i").alias(id_col), F.col("k.d").alias(doc_col), (F.col("earlier") + F.col("within")).alias("offset"))
    return pieces.join(places, id_col).withColumn("chunk_index", (F.col("offset") + F.col("chunk_index")).cast("int")).drop("offset")


def oversized(items: DataFrame, id_col: str, text_col: str, limit: int = 800, overlap: int = 100) -> DataFrame:
    """(id, reason): long for each item that had to be cut, unbroken for each that had to be cut within a run."""
    pieces = split_oversized(items, id_col, text_col, limit, overlap, whole=False)
    reasons = F.when(F.col("hard"), F.array(F.lit("long"), F.lit("unbroken"))).otherwise(F.array(F.lit("long")))
    return pieces.select(id_col, F.explode(reasons).alias("reason")).distinct()
