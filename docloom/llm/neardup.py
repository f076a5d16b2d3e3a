"""Near-duplicate records by anchor-point covering.

A record is the set of its word shingles. Its fingerprint is made of blocks of n minhash symbols, and the anchors are
the words of the parity-check code over the symbols of a block: all (c1..cn) whose sum is 0. That code has covering
radius 1, and the anchors within radius 1 of a fingerprint are got by correcting one of its n symbols. Two
fingerprints that differ in at most one symbol of a block (the threshold) have the anchor in common that corrects
that symbol. So each fingerprint is replicated to n anchors a block, and only fingerprints of one anchor are
compared: first by a 128-bit sketch, then exactly by the shingle sets. An anchor that more than HOT fingerprints share is
split: there, only those are compared that agree in one of SPLITS further keys of two minhash symbols each, which a pair
at the least similarity s misses with a chance of (1 - s * s) ** SPLITS (4 in a million at 0.6).

Defined results
* Words are maximal runs of letters and digits of the lower-cased text; shingles are distinct.
* Null ids and null texts, and records of fewer than ``least`` shingles, are in no pair.
* Rows of one id count as one record; if their texts differ, the least text counts.
* Records of equal shingle sets form a class; one of each class is compared, and the class follows its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize, ship_package

#: Blocks of the fingerprint and symbols of a block.
BLOCKS, SYMBOLS = 7, 4
SKETCH_BITS = 128
#: Deviations below its expectation at which the sketch of a pair at the threshold may lie.
SKETCH_SLACK = 3.7
BROADCAST_ROWS = 200_000
#: Fingerprints of one anchor beyond which it is split, and the keys by which it is.
HOT, SPLITS = 4_096, 28


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in their order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _shingles(col: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of size words of each row of word hashes, row after row, and their numbers."""
    n = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    grams = np.maximum(n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), grams)
    flat = np.asarray(col.flatten()).view(np.uint64)
    at = np.repeat(np.cumsum(n) - n, grams) + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    h = np.zeros(len(row), np.uint64)
    for j in range(size):
        h = _mix(h * np.uint64(3) + flat[at + j])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _minima(values: np.ndarray, starts: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count minhashes (32 bits) of each slice of values."""
    odd = _mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) | np.uint64(1)
    out = np.empty((len(starts), count), np.uint32)
    for j, m in enumerate(odd):
        out[:, j] = np.minimum.reduceat(((values * m) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def anchors(minima: np.ndarray, blocks: int, symbols: int) -> np.ndarray:
    """For each row the keys of the code words within radius 1 of its fingerprint."""
    sym = _mix(minima.astype(np.uint64)).reshape(len(minima), blocks, symbols)
    total = sym.sum(axis=2, dtype=np.uint64, keepdims=True)
    fixed = sym - total  # symbol i, if it is the one that is corrected
    place = _mix(np.arange(1, symbols + 1, dtype=np.uint64))
    plain = _mix(sym ^ place)
    moved = _mix(fixed ^ place)
    key = plain.sum(axis=2, dtype=np.uint64, keepdims=True) - plain + moved
    key = _mix(key + np.arange(1, blocks + 1, dtype=np.uint64)[None, :, None])
    return key.reshape(len(minima), blocks * symbols).view(np.int64)


FINGERPRINT = "id long, n int, c1 long, c2 long, s1 long, s2 long, anchors array<long>"


def _fingerprints(size: int, least: int, blocks: int, symbols: int):
    """Batches of (id, word hashes) to fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _shingles(batch.column(1), size)
            ok = n >= max(1, least)
            if not ok.any():
                continue
            values = values[np.repeat(ok, n)]
            n, ids = n[ok], np.asarray(batch.column(0))[ok]
            starts = np.r_[0, np.cumsum(n)[:-1]]
            one = np.add.reduceat(values, starts).view(np.int64)
            two = np.add.reduceat(_mix(values + np.uint64(7)), starts).view(np.int64)
            key = anchors(_minima(values, starts, blocks * symbols, 1), blocks, symbols)
            bits = (_mix(_minima(values, starts, SKETCH_BITS, 2).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
            sketch = np.ascontiguousarray(np.packbits(bits, axis=1)).view("<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, key.shape[1], dtype=np.int32)), pa.array(key.ravel()))
            yield pa.record_batch(
                [pa.array(ids), pa.array(n.astype(np.int32)), pa.array(one), pa.array(two), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), lists],
                names=["id", "n", "c1", "c2", "s1", "s2", "anchors"],
            )

    return run


def _split_keys(size: int):
    """Batches of (id, word hashes) to (id, keys): SPLITS keys of two minhash symbols, none of them in the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _shingles(batch.column(1), size)
            ok = n > 0
            if not ok.any():
                continue
            starts = np.r_[0, np.cumsum(n[ok])[:-1]]
            two = _minima(values, starts, 2 * SPLITS, 3).astype(np.uint64).reshape(-1, SPLITS, 2)
            key = _mix(_mix(two[:, :, 0] + np.arange(1, SPLITS + 1, dtype=np.uint64) * np.uint64(1 << 33)) + two[:, :, 1]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, SPLITS, dtype=np.int32)), pa.array(key.ravel()))
            yield pa.record_batch([pa.array(np.asarray(batch.column(0))[ok]), lists], names=["id", "keys"])

    return run


def _jaccard(size: int):
    """Batches of (a, b, word hashes of a, word hashes of b) to exact similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, nx = _shingles(batch.column(2), size)
            y, ny = _shingles(batch.column(3), size)
            row = np.r_[np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)]
            both = np.r_[x, y]
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][twice], minlength=len(nx))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(common / np.maximum(nx + ny - common, 1))], names=["a", "b", "jaccard"])

    return run


def _near(spread: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (id, n, s1, s2, anchor) of one anchor whose sketches and sizes allow the similarity."""
    expected = SKETCH_BITS * (1 + similarity) / 2
    slack = SKETCH_SLACK * (SKETCH_BITS * (1 - similarity**2) / 4) ** 0.5
    a, b = spread.alias("a"), spread.alias("b")
    differ = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    close = (differ <= int(SKETCH_BITS - expected + slack)) & (F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n"))
    near = a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.id") < F.col("b.id")) & close)
    return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _few(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _links(records: DataFrame, id_col: str, text_col: str, size: int, similarity: float, least: int, blocks: int, symbols: int):
    """Fingerprints of all records, and the links between classes: (a, b, jaccard) of representatives."""
    ship_package(records.sparkSession)
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"))
    hashed = rows.select("id", word_hashes(F.col("text")).alias("words"))
    prints = hashed.mapInArrow(_fingerprints(size, least, blocks, symbols), FINGERPRINT)
    prints = materialize(prints, "fingerprints")
    cls = prints.select("id", "c1", "c2")
    reps = prints.groupBy("c1", "c2").agg(F.min(F.struct("id", "n", "s1", "s2", "anchors")).alias("r")).select("r.*")
    spread = reps.select("id", "n", "s1", "s2", F.explode("anchors").alias("anchor"))
    hot = materialize(spread.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    if hot.limit(1).count():
        hot = _few(hot)
        crowd = materialize(spread.join(hot, "anchor", "left_semi"), "crowd")
        keys = hashed.join(_few(crowd.select("id").distinct()), "id", "left_semi").mapInArrow(_split_keys(size), "id long, keys array<long>")
        split = crowd.join(keys, "id").select("id", "n", "s1", "s2", "anchor", F.explode("keys").alias("key"))
        split = split.select("id", "n", "s1", "s2", F.xxhash64("anchor", "key").alias("anchor"))
        pairs = _near(spread.join(hot, "anchor", "left_anti"), similarity).unionByName(_near(split, similarity))
    else:
        pairs = _near(spread, similarity)
    pairs = materialize(pairs.distinct(), "near")
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    sets = rows.join(_few(ends), "id", "left_semi").select("id", word_hashes(F.col("text")).alias("words"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    both = both.select("a", "b", "wa", "wb").mapInArrow(_jaccard(size), "a long, b long, jaccard double")
    return cls, reps.select(F.col("id").alias("rep")), both.where(F.col("jaccard") >= similarity - 1e-12)


def near_duplicates(
    records: DataFrame, id_col: str, text_col: str, size: int = 5, similarity: float = 0.8, least: int = 1, blocks: int = BLOCKS, symbols: int = SYMBOLS
) -> tuple[DataFrame, DataFrame]:
    """Membership (id, rep), one row for each record of enough shingles, and links (a, b, jaccard) of representatives."""
    cls, _, links = _links(records, id_col, text_col, size, similarity, least, blocks, symbols)
    heads = cls.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    members = cls.join(heads, ["c1", "c2"]).select("id", "rep")
    return members, links


def near_duplicate_pairs(records: DataFrame, id_col: str, text_col: str, size: int, similarity: float, least: int = 1) -> DataFrame:
    """All pairs (id_a, id_b) of similar records, those of equal shingle sets included."""
    members, links = near_duplicates(records, id_col, text_col, size, similarity, least)
    members = materialize(members, "members")
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("p")), members.select(F.col("rep").alias("b"), F.col("id").alias("q"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    z = members.select("rep", F.col("id").alias("id_b"))
    within = members.select("rep", F.col("id").alias("id_a")).join(z, "rep").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).distinct()


def groups(members: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected groups of near duplicates: (id, group_id, links), group_id being the least id of the group.

    Labels spread along links and jump along labels until none changes; each round is written to the shared folder.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges, "edges")
    degree = edges.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "rep")
    label = materialize(edges.select(F.col("a").alias("v"), F.col("a").alias("l")).distinct(), "labels")
    for _ in range(rounds):
        around = edges.join(label.select(F.col("v").alias("b"), F.col("l").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        step = label.join(around.withColumnRenamed("a", "v"), "v").select("v", "l", F.least("l", "nl").alias("m"))
        jump = step.select(F.col("v").alias("m"), F.col("m").alias("far"))
        new = materialize(step.join(jump, "m", "left").select("v", F.least("m", "far").alias("l"), (F.col("l") != F.least("m", "far")).alias("moved")), "labels")
        label = new.select("v", "l")
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    out = members.join(label.withColumnRenamed("v", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("l", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
