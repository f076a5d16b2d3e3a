"""Exact nearest vectors by L2 distance in Arrow batches: a bounded set of queries against a stream of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def firsts(group: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Of each group, the places of the k least values of different ids, ties to the smaller id; groups in order."""
    order = np.lexsort((value, ids, group))
    g, i = group[order], ids[order]
    order = order[np.r_[True, (np.diff(g) != 0) | (np.diff(i) != 0)][: len(g)]]
    order = order[np.lexsort((ids[order], value[order], group[order]))]
    g = group[order]
    start = np.flatnonzero(np.r_[True, np.diff(g) != 0][: len(g)])
    return order[np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) < k]


class Nearest:
    """The running k nearest of each query. Distances are first bounded by a matrix product, then computed exactly."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries.astype(np.float64), k
        self.narrow = queries.astype(np.float32)
        self.size = (self.q * self.q).sum(1)
        self.bound = np.full(len(queries), np.inf)
        self.row, self.ids, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        wide = x.astype(np.float64)
        size = (wide * wide).sum(1)
        near = size + self.size[:, None] - 2 * (self.narrow @ x.T).astype(np.float64)
        # The product of floats is off by less than this part of the vectors' sizes.
        slack = 1e-5 * (size.max(initial=0) + self.size) + 1e-12
        bound = self.bound
        new = np.unique(ids, return_index=True)[1]
        if len(new) >= self.k:
            bound = np.minimum(bound, np.partition(near[:, new], self.k - 1, axis=1)[:, self.k - 1] + slack)
        r, c = np.nonzero(near <= (bound + slack)[:, None])
        exact = np.concatenate([((wide[c[i : i + 4096]] - self.q[r[i : i + 4096]]) ** 2).sum(1) for i in range(0, len(r), 4096)] or [np.zeros(0)])
        row, ids, distance = np.r_[self.row, r], np.r_[self.ids, ids[c]], np.r_[self.distance, exact]
        best = firsts(row, ids, distance, self.k)
        self.row, self.ids, self.distance = row[best], ids[best], distance[best]
        held = np.bincount(self.row, minlength=len(self.q))
        last = np.cumsum(held)[held == self.k] - 1
        self.bound[held == self.k] = self.distance[last]


def usable_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows of (id, embedding) that have an id and dim finite values, not all zero."""
    col = batch.column(1)
    ok = (np.asarray(col.value_lengths().fill_null(-1)) == dim) & np.asarray(batch.column(0).is_valid())
    x = np.asarray(col.filter(pa.array(ok)).flatten().fill_null(float("nan")), np.float32).reshape(-1, dim)
    fine = np.isfinite(x).all(1) & x.any(1)
    return np.asarray(batch.column(0).fill_null(0))[ok][fine], x[fine]


def nearest(shared, dim: int, k: int, step: int = 4_096):
    """Batches of (id, embedding) to a partition's (query_id, key, distance) of the k nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        best = Nearest(queries, k)
        for batch in batches:
            ids, x = usable_rows(batch, dim)
            for i in range(0, len(ids), step):
                best.add(ids[i : i + step], x[i : i + step])
        yield pa.record_batch([pa.array(names[best.row], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(np.sqrt(best.distance))], names=["query_id", "key", "distance"])

    return run
