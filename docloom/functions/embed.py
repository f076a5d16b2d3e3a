"""Embedding of texts: any function of a batch of texts to unit vectors; here one by hashing, as no model is at hand."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import ship_package

Embedder = Callable[[list[str]], np.ndarray]
DIM, BATCH = 384, 256


def hashing(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed counts of words and word pairs, at length 1: the same text gives the same vector, shared words bring texts near."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        words = re.findall(r"\w+", text.lower()) or [text]
        for w in (*words, *map(" ".join, zip(words, words[1:]))):
            h = crc32(w.encode())
            row[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        if not row.any():
            row[0] = 1.0
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder = hashing) -> DataFrame:
    """(key, embedding, error): empty and null texts have an error and no vector."""
    ship_package(rows.sparkSession)
    src = rows.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                texts = part.column(1).to_pylist()
                good = [t for t in texts if t]
                vectors = iter(embedder(good).tolist()) if good else iter(())
                out = [next(vectors) if t else None for t in texts]
                yield pa.record_batch([part.column(0), pa.array(out, pa.list_(pa.float32())), pa.array([None if t else "empty text" for t in texts], pa.string())], names=["k", "embedding", "error"])

    return src.mapInArrow(run, f"k {kind}, embedding array<float>, error string").withColumnRenamed("k", key)
