"""References to records that do not exist.

Parent keys become integers, sorted and compressed into contiguous runs (first, last). Each distinct reference meets,
as of its own value, the last run that starts at or before it, and is an orphan if it lies beyond that run's end.

Integer keys are compared as they are, in blocks of 65,536 neighbouring values. String keys, compared exactly as
written, are spread over blocks by their hash; within a block the integer of a key is its dense rank among all keys of
parents and references. So a run of string keys ends only where a reference without parent stands between, and there
are at most as many runs as orphans and blocks. Runs never cross blocks, which are searched side by side.

Defined results: null references are none; null parent keys are no parents; an empty parent table makes every
reference an orphan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize

BLOCK_BITS = 16
#: Parent keys a block of string keys is meant to hold.
BLOCK_KEYS = 32_768
#: Orphan keys that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Reference:
    """References of one field: rows with the key, and the parents' key column."""

    table: str
    field: str
    rows: DataFrame
    parents: DataFrame
    parent_key: str


def _columns(key: Column, kind: str, blocks: int) -> tuple[Column, Column, Column]:
    """Block, integer (0 for strings) and string (empty for integers) of a key."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        k = key.cast("long")
        return F.shiftright(k, BLOCK_BITS), k, F.lit("")
    text = key.cast("string")
    return F.pmod(F.xxhash64(text), F.lit(blocks)).cast("long"), F.lit(0).cast("long"), text


def runs(keys: DataFrame) -> DataFrame:
    """(f, block, first, last): the contiguous runs of distinct integer keys (f, block, k)."""
    by_block = Window.partitionBy("f", "block").orderBy("k")
    islands = keys.distinct().withColumn("island", F.col("k") - F.row_number().over(by_block))
    return islands.groupBy("f", "block", "island").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("island")


def ranked_keys(references: list[Reference]) -> DataFrame:
    """(f, block, n, s, k, parent, asked) of each distinct key; f is the number of the reference, k the integer by which
    keys of a block are ordered."""
    keys = None
    for f, r in enumerate(references):
        kind = dict(r.rows.dtypes)[r.field]
        blocks = max(1, -(-r.parents.count() // BLOCK_KEYS))
        for parent, frame, col in ((True, r.parents, r.parent_key), (False, r.rows, r.field)):
            block, n, s = _columns(F.col(col), kind, blocks)
            part = frame.where(F.col(col).isNotNull()).select(F.lit(f).alias("f"), block.alias("block"), n.alias("n"), s.alias("s"), F.lit(parent).alias("parent"))
            keys = part if keys is None else keys.unionByName(part)
    once = keys.groupBy("f", "block", "n", "s").agg(F.bool_or("parent").alias("parent"), (~F.bool_and("parent")).alias("asked"))
    rank = F.row_number().over(Window.partitionBy("f", "block").orderBy("n", "s"))
    return once.withColumn("k", F.when(F.col("s") == "", F.col("n")).otherwise(rank.cast("long")))


def orphan_keys(references: list[Reference]) -> DataFrame:
    """(f, n, s) of the distinct references that no run holds."""
    keys = materialize(ranked_keys(references), "keys")
    starts = runs(keys.where("parent").select("f", "block", "k"))
    starts = starts.select("f", "block", F.col("first").alias("k"), F.lit(0).alias("what"), "last", F.lit(0).cast("long").alias("n"), F.lit("").alias("s"))
    asked = keys.where("asked").select("f", "block", "k", F.lit(1).alias("what"), F.lit(None).cast("long").alias("last"), "n", "s")
    as_of = Window.partitionBy("f", "block").orderBy("k", "what").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(asked).withColumn("end", F.last("last", ignorenulls=True).over(as_of))
    return met.where((F.col("what") == 1) & (F.col("end").isNull() | (F.col("k") > F.col("end")))).select("f", "n", "s")


def orphans(references: list[Reference], id_cols: list[str], time_cols: list[str]) -> DataFrame:
    """(tbl, field, row_id, period): each reference without a parent, by the month of its time column."""
    missing, rows = materialize(orphan_keys(references), "orphans"), None
    for f, (r, row_id, when) in enumerate(zip(references, id_cols, time_cols)):
        _, n, s = _columns(F.col(r.field), dict(r.rows.dtypes)[r.field], 1)
        part = r.rows.where(F.col(r.field).isNotNull()).select(
            F.lit(f).alias("f"), n.alias("n"), s.alias("s"), F.lit(r.table).alias("tbl"), F.lit(r.field).alias("field"),
            F.col(row_id).cast("long").alias("row_id"), F.date_format(when, "yyyy-MM").alias("period"),
        )
        rows = part if rows is None else rows.unionByName(part)
    few = missing.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(missing) if few else missing, ["f", "n", "s"], "left_semi").select("tbl", "field", "row_id", "period")
