"""Most similar vectors for every vector: inverted file with product-quantised residuals.

Coarse centroids split the vectors into cells; beyond MAX_COARSE of them, a second set of centroids for the residuals,
shared by all coarse cells, splits each further, so that cells stay small while the trained part stays bounded. A
vector is kept in its nearest cells as the code of its residual (one byte for each group of dimensions); a query walks
the cells it probes and sums, for each code there, the entries of its distance tables that the code names
(Tables). What passes is re-ranked with exact cosines.

Which scores pass: the k-th best cosine of a query among sampled rows of its own coarse cell is a lower bound of its
k-th best among all rows, as is the floor. A code must reach the score that a vector at that cosine is expected to
have, less FLOOR_DEVIATIONS deviations; the exact cosine decides. With a floor, no shortlist is cut: where more codes
pass than it holds, the query is compared exactly with all vectors that passed in its cell, in blocks. shortlist=0 cuts
nothing and lets everything in the probed cells through: with all cells probed that is exact search. Where a vector is
kept in one cell only, it goes there itself beside its code, so that the exact cosines are computed in the cell.

Defined results
* Usable is a vector that is not null, has ``dim`` finite values and is not all zero; all others are left out.
* Rows of one id with equal vectors count once. If an id has several different vectors, each is searched, and the
  best cosine counts.
* Ties go to the smaller id.
* Copies (equal vectors) beyond the first k + 1 of a class never enter the index: their nearest are the class's
  first ids, which is exact.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize, release, ship_package

#: Bound of the training sample (of 384 floats: 50 MB), and of the centroids of each level: with two levels, cells keep
#: their size up to MAX_COARSE * MAX_FINE * ROWS_PER_CELL (about 10^9) rows.
SAMPLE_ROWS = 32_768
MAX_COARSE = MAX_FINE = 2_048
ROWS_PER_CELL = 256
#: Queries, and codes, of one cell that a task takes at a time; cells expected to hold more are divided.
CELL_BLOCK, CODE_BLOCK = 8_192, 65_536
#: Sampled rows of a cell from which its share of all rows is judged.
LEAST_SHARE = 8
#: Tables of at most so many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Of a normal drift, one in 740 lies lower.
FLOOR_DEVIATIONS = 3.0


@dataclass
class Index:
    """Coarse and fine centroids (cell = coarse * number of fine + fine), codebooks, and what a query may assume."""

    coarse: np.ndarray
    fine: np.ndarray
    codebooks: np.ndarray
    slack: float = 0.0
    #: Of each cell, the parts into which its queries and its codes are cut.
    query_parts: np.ndarray = field(default_factory=lambda: np.ones(1, np.int32))
    code_parts: np.ndarray = field(default_factory=lambda: np.ones(1, np.int32))
    #: Sampled rows in the order of their coarse cells, which begin at starts.
    known_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float16))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @property
    def cells(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroid(self, cells: np.ndarray) -> np.ndarray:
        return self.coarse[cells // len(self.fine)] + self.fine[cells % len(self.fine)]

    @cached_property
    def half_norms(self) -> np.ndarray:
        """Half the squared length of each cell's centroid, by coarse and fine cell."""
        return ((self.coarse * self.coarse).sum(1)[:, None] + (self.fine * self.fine).sum(1) + 2 * self.coarse @ self.fine.T) / 2

    def nearest(self, x: np.ndarray, many: int) -> np.ndarray:
        """The nearest cells of each vector, the nearest first. Fine cells are looked at in the nearest coarse ones."""
        many, width, size = min(many, self.cells), len(self.fine), self.half_norms
        most = min(many, len(self.coarse))
        out = np.empty((len(x), many), np.int32)
        step = max(16, min(2048, 4_000_000 // (most * width)))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            s = part @ self.coarse.T
            if width == 1:
                s, cells = s - size[:, 0], None
            else:
                top = np.argpartition(-s, most - 1, axis=1)[:, :most]
                s = np.take_along_axis(s, top, 1)[:, :, None] + (part @ self.fine.T)[:, None, :] - size[top]
                cells = (top[:, :, None] * width + np.arange(width)).reshape(len(part), -1)
                s = s.reshape(len(part), -1)
            best = np.argpartition(-s, many - 1, axis=1)[:, :many]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
            out[i : i + step] = best if cells is None else np.take_along_axis(cells, best, 1)
        return out

    def bounds(self, ids: np.ndarray, x: np.ndarray, home: np.ndarray, k: int) -> np.ndarray:
        """For each vector the k-th best cosine among the sampled rows of its coarse cell, -1 if there are too few."""
        out = np.full(len(x), -1.0, np.float32)
        for cell, rows in _groups(home // len(self.fine), np.arange(len(x))):
            a, b = self.starts[cell], self.starts[cell + 1]
            if b - a > k:
                s = x[rows] @ self.known[a:b].astype(np.float32).T
                s[ids[rows, None] == self.known_ids[a:b]] = -1
                out[rows] = np.partition(s, b - a - k, axis=1)[:, b - a - k] - 1e-3
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        filled = near[order][starts]
        c[filled] = np.add.reduceat(x[order], starts) / np.diff(np.r_[starts, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), filled)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 2048) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ c.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def fit(sample: np.ndarray, rows: int, subspaces: int, seed: int = 7, ids: np.ndarray | None = None, base_cells: int = 1) -> Index:
    """Train cells and codebooks on unit vectors. slack is how far below its expectation, in units of the code's
    own deviation, a score may lie (FLOOR_DEVIATIONS times the drift's deviation over sampled directions)."""
    rng = np.random.default_rng(seed)
    wanted = max(1.0, rows / ROWS_PER_CELL)
    coarse = _kmeans(sample, int(min(MAX_COARSE, 2 ** round(np.log2(wanted)))), 8, rng, unit=True)
    width = int(min(MAX_FINE, max(1, round(wanted / MAX_COARSE))))
    fine = np.zeros((1, sample.shape[1]), np.float32)
    if width > 1:
        fine = _kmeans(sample - coarse[_nearest(sample, coarse)], width, 8, rng, unit=False)
    sub = sample.shape[1] // subspaces
    index = Index(coarse, fine, np.zeros((subspaces, 256, sub), np.float32))
    home = index.nearest(sample, 1)[:, 0]
    res = sample - index.centroid(home)
    part = res[rng.permutation(len(res))[:12_288]]
    for m in range(subspaces):
        b = _kmeans(np.ascontiguousarray(part[:, m * sub : (m + 1) * sub]), 256, 6, rng, unit=False)
        index.codebooks[m, : len(b)] = b
        index.codebooks[m, len(b) :] = b[0]
    held = np.bincount(home, minlength=index.cells)
    share = np.where(held >= LEAST_SHARE, held, 0) / max(1, len(sample))
    index.query_parts = np.maximum(1, np.ceil(share * rows / CELL_BLOCK)).astype(np.int32)
    index.code_parts = np.maximum(1, np.ceil(share * rows * base_cells / CODE_BLOCK)).astype(np.int32)
    first = np.unique(ids, return_index=True)[1] if ids is not None else np.arange(len(sample))
    order = first[np.argsort(home[first], kind="stable")]
    index.known_ids = (ids if ids is not None else np.arange(len(sample)))[order].astype(np.int64)
    index.known = sample[order].astype(np.float16)
    index.starts = np.searchsorted(home[order] // len(fine), np.arange(len(coarse) + 1))
    probe = sample[:2048]
    _, approx = encode(index, probe, home[:2048])
    along, spread = _along(probe, approx)
    w = probe[rng.permutation(len(probe))]
    w = w - (w * probe).sum(1, keepdims=True) * probe
    size = np.linalg.norm(w, axis=1)
    ok = (size > 1e-3) & (spread > 1e-4)
    drift = (w[ok] * approx[ok]).sum(1) / size[ok] / spread[ok]
    index.slack = float(FLOOR_DEVIATIONS * np.sqrt((drift**2).mean())) if ok.any() else 0.1 * FLOOR_DEVIATIONS
    return index


def encode(index: Index, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals, and the vectors they stand for."""
    m, _, sub = index.codebooks.shape
    approx = index.centroid(home)
    res = x - approx
    code = np.empty((len(x), m), np.uint8)
    for j in range(m):
        code[:, j] = _nearest(np.ascontiguousarray(res[:, j * sub : (j + 1) * sub]), index.codebooks[j])
        approx[:, j * sub : (j + 1) * sub] += index.codebooks[j][code[:, j]]
    return code, approx


def _along(x: np.ndarray, approx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each coded vector, its component along the vector, and the size of the rest."""
    along = (x * approx).sum(1)
    return along, np.sqrt(np.maximum((approx * approx).sum(1) - along**2, 0))


class Tables:
    """Asymmetric distance tables of some queries: of each, the products with all codewords, and those with the
    centroids of the cells that codes refer to. A score is the sum of the entries that a code names; the entries of all
    queries for one codeword lie side by side, so that a look-up serves them all."""

    def __init__(self, index: Index, q: np.ndarray):
        m, _, sub = index.codebooks.shape
        self.entries = np.matmul(index.codebooks, q.reshape(len(q), m, sub).transpose(1, 2, 0))
        self.index, self.q = index, q

    def scores(self, code: np.ndarray, home: np.ndarray) -> np.ndarray:
        """(codes, queries): the scores of codes by columns (subspaces, codes)."""
        cells, which = np.unique(home, return_inverse=True)
        out = (self.index.centroid(cells) @ self.q.T)[which]
        named = np.empty_like(out)
        for entries, column in zip(self.entries, code):
            out += np.take(entries, column, axis=0, out=named, mode="clip")
        return out


def _pack(x: np.ndarray) -> bytes:
    """Vectors without loss: half precision where that is exact, bytes of equal weight side by side, compressed."""
    import zstandard

    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = np.array_equal(half.astype(np.float32), x)
    y = half if exact else x
    planes = np.ascontiguousarray(y.view(np.uint8).reshape(y.size, y.itemsize).T)
    return (b"h" if exact else b"f") + zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, dim: int) -> np.ndarray:
    import zstandard

    kind = np.float16 if data[:1] == b"h" else np.float32
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).reshape(-1, dim).astype(np.float32)


def vectors_of(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and raw vectors of the usable rows of (id, embedding)."""
    col = batch.column(1)
    sizes = np.asarray(col.value_lengths().fill_null(-1))
    ids = np.asarray(batch.column(0).fill_null(0))
    ok = (sizes == dim) & np.asarray(batch.column(0).is_valid())
    flat = col.filter(pa.array(ok)).flatten()
    x = np.asarray(flat.fill_null(float("nan")), dtype=np.float32).reshape(-1, dim)
    fine = np.isfinite(x).all(1) & x.any(1)
    return ids[ok][fine], x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True) if len(x) else np.ones((0, 1), np.float32)
    y = (x / scale).astype(np.float32)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


ROUTED = "cell int, blk int, kind int, n int, data binary, vecs binary"


def _record(m: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("home", "<i4"), ("along", "<f2"), ("spread", "<f2"), ("code", "u1", m)])


_ASKED = np.dtype([("id", "<i8"), ("least", "<f4")])


def _router(shared, dim: int, base_cells: int, query_cells: int, query_every: int, floor: float | None, k: int, bounded: bool):
    """Batches of (id, embedding) to packed rows by cell: kind 0 holds codes, kind 1 queries with the cosine they ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            ids, raw = vectors_of(batch, dim)
            if not len(ids):
                continue
            x = unit(raw)
            near = index.nearest(x, base_cells)
            home = near[:, 0]
            code, approx = encode(index, x, home)
            out: list[tuple] = []
            base = np.zeros(len(x), _record(code.shape[1]))
            base["id"], base["home"], base["code"] = ids, home, code
            base["along"], base["spread"] = _along(x, approx)
            for cell, pick in _groups(near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])):
                for part, some in _parted(ids, pick, index.code_parts[cell]):
                    data, vecs = base[some].tobytes(), _pack(raw[some]) if base_cells == 1 else None
                    out += [(cell, part * index.query_parts[cell] + b, 0, len(some), data, vecs) for b in range(index.query_parts[cell])]
            asked = np.flatnonzero(ids % query_every == 0)
            least = np.full(len(x), -1.0 if floor is None else floor, np.float32)
            if bounded:
                least[asked] = np.maximum(least[asked], index.bounds(ids[asked], x[asked], home[asked], k))
            cells = near[asked][:, :query_cells] if query_cells <= base_cells else index.nearest(x[asked], query_cells)
            for cell, pick in _groups(cells.ravel(), np.repeat(asked, cells.shape[1])):
                for b, some in _parted(ids, pick, index.query_parts[cell]):
                    who = np.zeros(len(some), _ASKED)
                    who["id"], who["least"] = ids[some], least[some]
                    data, vecs = who.tobytes(), _pack(raw[some])
                    out += [(cell, part * index.query_parts[cell] + b, 1, len(some), data, vecs) for part in range(index.code_parts[cell])]
            cols = list(zip(*out))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["cell", "blk", "kind", "n", "data", "vecs"])

    return run


def _parted(ids: np.ndarray, rows: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows cut into parts by their ids."""
    if parts == 1:
        return iter([(0, rows)])
    return _groups((ids[rows] * np.int64(2654435761) >> 16) % parts, rows)


def _groups(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    for a, b in zip(s := np.flatnonzero(np.r_[True, np.diff(k) != 0]), np.r_[s[1:], len(k)]):
        yield int(k[a]), rows[order[a:b]]


CANDIDATE = "x_id long, q_id long, score double, cell int, blk int"


def _candidates(x_ids, q_ids, scores=None, at=(None, None)) -> pa.RecordBatch:
    n = len(x_ids)
    return pa.record_batch(
        [pa.array(x_ids, pa.int64()), pa.array(q_ids, pa.int64()), pa.array([None] * n if scores is None else scores, pa.float64()),
         pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int32())],
        names=["x_id", "q_id", "score", "cell", "blk"],
    )


def _scorer(shared, dim: int, shortlist: int, whole: bool, k: int, floor: float | None):
    """Sorted packed rows of cells to candidate pairs, by asymmetric distance tables.

    Where more than shortlist codes pass for a query, the best are kept, or if whole, the query and all that passed for
    it come out as members of the cell's block (rows of only q_id or only x_id), to be compared exactly. shortlist=0
    keeps all. If the vectors came with their codes, all that are kept (with whole, all that passed) are compared here,
    and the k best of a query in the cell come out with their cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        record = _record(index.codebooks.shape[0])
        most = shortlist or 1 << 62
        at, held, own, base, asking, passed, exact = None, [], [], None, [], None, None

        def crowded() -> Iterator[pa.RecordBatch]:
            if asking:
                q, x = np.unique(np.concatenate(asking)), np.unique(base["id"][passed])
                yield _candidates([None] * len(q), q, at=at)
                yield _candidates(x, [None] * len(x), at=at)

        for batch in batches:
            for cell, blk, kind, n, data, vecs in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (cell, blk) != at:
                    yield from crowded()
                    at, held, own, base, asking, exact = (cell, blk), [], [], None, [], None
                if kind == 0:
                    held.append(np.frombuffer(data, record))
                    own += [vecs] if vecs is not None else []
                    continue
                if base is None:
                    if not held:
                        continue
                    base, held = np.concatenate(held), []
                    exact, own = (np.concatenate([_unpack(v, dim) for v in own]) if own else None), []
                    columns = np.ascontiguousarray(base["code"].T)
                    along, spread = base["along"].astype(np.float32), base["spread"].astype(np.float32)
                    passed = np.zeros(len(base), bool)
                who, raw = np.frombuffer(data, _ASKED), _unpack(vecs, dim)
                vectors = unit(raw)
                for i in range(0, n, 256):
                    tables, least = Tables(index, vectors[i : i + 256]), who["least"][i : i + 256]
                    drift = index.slack * np.sqrt(np.maximum(1 - least**2, 0))
                    rows, cols, reached = [], [], []
                    for a in range(0, len(base), 512):
                        part = slice(a, a + 512)
                        score = tables.scores(columns[:, part], base["home"][part])
                        ok = np.ones(score.shape, bool)
                        if (least > -1).any():
                            ok = score >= along[part, None] * least - spread[part, None] * drift
                        c, r = np.nonzero(ok)
                        rows.append(r)
                        cols.append(a + c)
                        reached.append(score[c, r])
                    r, c, score = np.concatenate(rows), np.concatenate(cols), np.concatenate(reached)
                    ids = who["id"][i : i + 256]
                    other = ids[r] != base["id"][c]
                    r, c, score = r[other], c[other], score[other]
                    many = np.bincount(r, minlength=len(ids)) > most
                    if exact is not None and whole:
                        many[:] = False
                    if whole and many.any():
                        asking.append(ids[many])
                        passed[c[many[r]]] = True
                        few = ~many[r]
                        r, c, score = r[few], c[few], score[few]
                    elif many.any():
                        order = np.lexsort((base["id"][c], -score, r))
                        r, c, score = r[order], c[order], score[order]
                        first = np.flatnonzero(np.r_[True, np.diff(r) != 0])
                        short = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < most
                        r, c, score = r[short], c[short], score[short]
                    if exact is not None:
                        score = np.concatenate([_cosines(exact[c[j : j + 1024]].astype(np.float64), raw[i + r[j : j + 1024]].astype(np.float64)) for j in range(0, len(r), 1024)] or [np.zeros(0)])
                        if floor is not None:
                            r, c, score = r[score >= floor], c[score >= floor], score[score >= floor]
                        r, c, score = _firsts(r, c, base["id"][c], score, k)
                    if len(r):
                        yield _candidates(base["id"][c], ids[r], score)
        yield from crowded()

    return run


def _firsts(r: np.ndarray, c: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each r, the k best of different ids, ties to the smaller id."""
    order = np.lexsort((-cos, ids, r))
    r, c, ids, cos = r[order], c[order], ids[order], cos[order]
    new = np.r_[True, (np.diff(r) != 0) | (np.diff(ids) != 0)][: len(r)]
    r, c, ids, cos = r[new], c[new], ids[new], cos[new]
    order = np.lexsort((ids, -cos, r))
    r, c, cos = r[order], c[order], cos[order]
    first = np.flatnonzero(np.r_[True, np.diff(r) != 0][: len(r)])
    best = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k
    return r[best], c[best], cos[best]


class _Best:
    """Exact running k most similar (distinct ids, ties to the smaller) of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: float):
        self.ids, self.q, self.k, self.floor = ids, q, k, floor
        self.unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        self.kth = np.full(len(ids), floor)
        self.row, self.near, self.cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, x: np.ndarray, step: int = 512) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        first = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
        rows, cols = [], []
        for i in range(0, len(self.ids), step):
            s = self.unit[i : i + step] @ u.T
            s[self.ids[i : i + step, None] == ids] = -2
            bar = self.kth[i : i + step]
            if len(first) > self.k:
                each = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)
                bar = np.maximum(bar, np.partition(each, len(first) - self.k, axis=1)[:, len(first) - self.k])
            r, c = np.nonzero(s >= bar[:, None] - 1e-9)
            rows.append(i + r)
            cols.append(c)
        r, c = np.concatenate(rows), np.concatenate(cols)
        cos = np.concatenate([_cosines(x[c[i : i + 8192]], self.q[r[i : i + 8192]]) for i in range(0, len(r), 8192)] or [np.zeros(0)])
        ok = cos >= self.floor
        row, near, cos = np.r_[self.row, r[ok]], np.r_[self.near, ids[c[ok]]], np.r_[self.cos, cos[ok]]
        order = np.lexsort((-cos, near, row))
        row, near, cos = row[order], near[order], cos[order]
        new = np.r_[True, (np.diff(row) != 0) | (np.diff(near) != 0)][: len(row)]
        row, near, cos = row[new], near[new], cos[new]
        order = np.lexsort((near, -cos, row))
        row, near, cos = row[order], near[order], cos[order]
        starts = np.flatnonzero(np.r_[True, np.diff(row) != 0][: len(row)])
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        last = place == self.k - 1
        self.kth[row[last]] = cos[last]
        self.row, self.near, self.cos = row[place < self.k], near[place < self.k], cos[place < self.k]

    def found(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.ids[self.row]), pa.array(self.near), pa.array(self.cos)], names=["q_id", "x_id", "cosine"])


def _exhaust(dim: int, k: int, floor: float):
    """Vectors of crowded blocks (cell, blk, kind, id, embedding), sorted, the queries (kind 0) of a block before what
    passed for them (kind 1), to each query's k most similar. The queries of one block are held, the others stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, blk, kind, ids = (np.asarray(batch.column(i)) for i in range(4))
            x = np.asarray(batch.column(4).flatten(), np.float32).reshape(-1, dim)
            turn = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(kind) != 0)])
            for a, b in zip(turn, np.r_[turn[1:], len(ids)]):
                if (cell[a], blk[a]) != at:
                    if best is not None:
                        yield best.found()
                    at, held, best = (cell[a], blk[a]), [], None
                if kind[a] == 0:
                    held.append((ids[a:b], x[a:b]))
                    continue
                if best is None:
                    best = _Best(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).astype(np.float64), k, floor)
                for i in range(a, b, 4096):
                    best.add(ids[i : min(b, i + 4096)], x[i : min(b, i + 4096)].astype(np.float64))
        if best is not None:
            yield best.found()

    return run


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum(1))


def _rerank(dim: int, floor: float | None):
    """(x_id, q_id, embeddings x and q) to exact cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, q = (np.asarray(batch.column(c).flatten(), np.float32).reshape(-1, dim) for c in ("x", "q"))
            cos = np.concatenate([_cosines(x[i : i + 1024].astype(np.float64), q[i : i + 1024].astype(np.float64)) for i in range(0, len(x), 1024)])
            ok = cos >= floor if floor is not None else np.ones(len(cos), bool)
            yield pa.record_batch([pa.array(np.asarray(batch.column("q_id"))[ok]), pa.array(np.asarray(batch.column("x_id"))[ok]), pa.array(cos[ok])], names=["q_id", "x_id", "cosine"])

    return run


def usable(emb: Column, dim: int) -> Column:
    """SQL condition for a vector that can be compared."""
    fine = ~F.exists(emb, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return emb.isNotNull() & (F.size(emb) == dim) & fine & F.exists(emb, lambda v: v != 0)


def _compared(passed: DataFrame, good: DataFrame, dim: int, k: int, floor: float | None, shortlist: int, whole: bool, query_cells: int, query_every: int) -> DataFrame:
    """(q_id, x_id, cosine) of what passed, with the vectors fetched by their ids."""
    crowded, cand = passed.where("cell is not null"), passed.where("cell is null").drop("cell", "blk")
    dense = None
    if whole and crowded.limit(1).count():
        members = crowded.select("cell", "blk", F.col("q_id").isNull().cast("int").alias("kind"), F.coalesce("q_id", "x_id").alias("x_id"))
        vecs = members.join(good, "x_id").select("cell", "blk", "kind", "x_id", "embedding")
        vecs = vecs.repartition("cell", "blk").sortWithinPartitions("cell", "blk", "kind")
        dense = materialize(vecs.mapInArrow(_exhaust(dim, k, floor), "q_id long, x_id long, cosine double"), "dense")
    if query_cells > 1 and shortlist and not whole:
        w = Window.partitionBy("q_id").orderBy(F.desc("score"), "x_id")
        cand = cand.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * shortlist).drop("place")
    cand = cand.select("x_id", "q_id")
    if query_every == 1:
        # Either side may have found a pair: it is compared once and counts for both.
        cand = cand.select(F.least("x_id", "q_id").alias("x_id"), F.greatest("x_id", "q_id").alias("q_id"))
    cand = materialize(cand.distinct(), "once")
    release(passed)
    wanted = cand.select(F.explode(F.array("x_id", "q_id")).alias("x_id")).distinct()
    n = wanted.count()
    look = good.join(F.broadcast(wanted), "x_id", "left_semi") if n <= BROADCAST_ROWS else good
    both = cand.join(look.select("x_id", F.col("embedding").alias("x")), "x_id").join(look.select(F.col("x_id").alias("q_id"), F.col("embedding").alias("q")), "q_id")
    pairs = both.select("x_id", "q_id", "x", "q").mapInArrow(_rerank(dim, floor), "q_id long, x_id long, cosine double")
    return pairs.unionByName(dense) if dense is not None else pairs


def similar(
    vectors: DataFrame,
    id_col: str,
    emb_col: str,
    dim: int = 384,
    k: int = 10,
    floor: float | None = None,
    base_cells: int = 7,
    query_cells: int = 1,
    query_every: int = 1,
    shortlist: int = 96,
    subspaces: int = 48,
) -> DataFrame:
    """The k most similar other vectors of each query vector: (id, neighbour, cosine, rank).

    Queries are the ids divisible by query_every. floor leaves out neighbours of a smaller cosine. base_cells is the
    number of cells that keep a vector's code, query_cells the number a query probes; shortlist is the number of codes
    of a cell (and, if vectors are kept in several cells, twice that of all cells) that are re-ranked for a query (0: all).
    """
    if dim % subspaces:
        raise ValueError("dim must be a multiple of subspaces")
    spark = vectors.sparkSession
    ship_package(spark)
    keep = k + 1
    src = vectors.select(F.col(id_col).cast("long").alias("x_id"), F.col(emb_col).cast("array<float>").alias("embedding"))
    src = src.where(F.col("x_id").isNotNull() & (F.size("embedding") == dim))
    good = src.where(usable(F.col("embedding"), dim))
    marks = good.select("x_id", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    marks = materialize(marks, "marks").distinct()
    crowd = marks.groupBy("h1", "h2").count().where(F.col("count") > keep).select("h1", "h2")
    crowd = materialize(crowd, "crowd")
    crowds, rows = crowd.count(), marks.count()
    by_class = Window.partitionBy("h1", "h2").orderBy("x_id")
    copies = None
    if crowds:
        small = (lambda d: F.broadcast(d)) if crowds <= BROADCAST_ROWS else (lambda d: d)
        first = marks.join(small(crowd), ["h1", "h2"], "left_semi").withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= keep)
        first = materialize(first, "first")
        heads = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("x_id")).alias("heads"))
        members = marks.join(small(heads), ["h1", "h2"])
        copies = members.select(F.col("x_id").alias("id"), F.explode(F.slice(F.array_remove("heads", F.col("x_id")), 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine"))
        copies = copies.where(F.col("id") % query_every == 0)
        cut = first.groupBy("h1", "h2").agg(F.max("x_id").alias("cut"))
        src = src.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
        src = src.join(small(cut), ["h1", "h2"], "left").where(F.col("cut").isNull() | (F.col("x_id") <= F.col("cut"))).select("x_id", "embedding")
        good = src.where(usable(F.col("embedding"), dim))
    want = int(min(SAMPLE_ROWS, max(4096, 32 * rows / ROWS_PER_CELL)))
    # The rows of the least hashes: the same sample, so the same index, whatever the partitions are.
    draw = F.pmod(F.xxhash64(F.col("x_id"), F.lit(11)), F.lit(1 << 40))
    share = min(1.0, 1.2 * want / max(1, rows) + 1e-6)
    picked = good.withColumn("draw", draw).where(F.col("draw") < int(share * (1 << 40))).orderBy("draw", "x_id", F.xxhash64("embedding")).limit(want)
    got = picked.select("x_id", "embedding").toArrow()
    sample_ids = np.asarray(got.column("x_id"))
    sample = unit(np.asarray(got.column("embedding").combine_chunks().flatten(), np.float32).reshape(-1, dim)) if len(got) else np.eye(1, dim, dtype=np.float32)
    index = fit(sample, rows, subspaces, ids=sample_ids if len(got) else np.zeros(1, np.int64), base_cells=base_cells)
    shared = spark.sparkContext.broadcast(index)
    routed = src.mapInArrow(_router(shared, dim, base_cells, query_cells, query_every, floor, k, shortlist > 0), ROUTED)
    cells = routed.repartition("cell", "blk").sortWithinPartitions("cell", "blk", "kind")
    whole = floor is not None and shortlist > 0
    cand = cells.mapInArrow(_scorer(shared, dim, shortlist, whole, k, floor), CANDIDATE)
    cand = materialize(cand, "candidates")
    pairs = cand.select("q_id", "x_id", F.col("score").alias("cosine")) if base_cells == 1 else _compared(cand, good, dim, k, floor, shortlist, whole, query_cells, query_every)
    if query_every == 1:
        pairs = materialize(pairs, "pairs")
        pairs = pairs.unionByName(pairs.select(F.col("x_id").alias("q_id"), F.col("q_id").alias("x_id"), "cosine"))
    found = pairs.select(F.col("q_id").alias("id"), F.col("x_id").alias("neighbour"), "cosine")
    if copies is not None:
        found = found.unionByName(copies)
    best = found.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, id_col: str, emb_col: str, floor: float = 0.8, k: int = 10, dim: int = 384) -> DataFrame:
    """Pairs (id_a, id_b) of a cosine of at least floor of which one is among the other's k most similar."""
    near = similar(vectors, id_col, emb_col, dim=dim, k=k, floor=floor)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
