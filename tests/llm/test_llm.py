"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import os
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import ann, fusion, leakage, neardup, quality, queries, splitting, tokenizer
from tools_compare import rows_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df, cur = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


# Fusion


def test_borda_by_hand(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 2, 0.2), (1, 3, 0.2), (1, 4, None), (1, 5, nan), (None, 1, 0.1), (1, None, 0.1)], "q long, i long, s double")
    b = spark.createDataFrame([(1, 4, 900.0, "x"), (1, 1, 5.0, "y")], "q long, i long, t double, s string")
    got = {r.i: r.points for r in fusion.borda([fusion.Scores(a, "s"), fusion.Scores(b, "t", ascending=False)], "q", "i").collect()}
    # Four items: list a ranks 1, 2.5, 2.5 and leaves place 4; list b ranks 4 before 1 and leaves 3 and 4.
    assert got == {1: 3 + 2, 2: 1.5 + 0.5, 3: 1.5 + 0.5, 4: 0 + 3}
    top = fusion.borda([fusion.Scores(a, "s"), fusion.Scores(b, "t", ascending=False)], "q", "i", top=3).collect()
    assert sorted((r.place, r.i) for r in top) == [(1, 1), (2, 4), (3, 2)]
    assert fusion.borda([fusion.Scores(a.limit(0), "s"), fusion.Scores(b.limit(0), "t")], "q", "i").count() == 0


def test_ranks_of_a_large_group(spark):
    rnd = random.Random(1)
    rows = [(q, i, float(rnd.randint(0, 300))) for q in (1, 2) for i in range(2000 if q == 1 else 5)]
    got = fusion.ranked([fusion.Scores(spark.createDataFrame(rows, "q long, i long, s double"), "s")], "q", "i").collect()
    scores = {q: [s for p, _, s in rows if p == q] for q in (1, 2)}
    of = {(q, i): s for q, i, s in rows}
    assert len(got) == len(rows)
    assert all(r.above == sum(x < of[r.g, r.i] for x in scores[r.g]) and r.tied == scores[r.g].count(of[r.g, r.i]) and r.n == len(scores[r.g]) for r in got)


# Splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n é😀", max_size=1500), st.integers(1, 200), st.integers(0, 199))
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = splitting.split(np.frombuffer(text.encode("utf-32-le"), np.uint32), limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= limit for a, b, _ in got)
    assert all(c <= b and b - c <= overlap and d > b for (_, b, _), (c, d, _) in zip(got, got[1:]))
    assert any(h for *_, h in got) == (max(map(len, re.split(r"[\s]", text))) > limit)


def _plain_split(text, limit, overlap):
    """The rules of cutting, place by place."""

    def strength(j):
        a, b = text[j - 1], text[j] if j < len(text) else ""
        out = 1 if b and b.isspace() else 0
        if a.isspace():
            out = max(out, 1)
            if j > 1 and text[j - 2] in ".!?…":
                out = max(out, 2)
            if a in "\n\r":
                out = 4 if j > 1 and text[j - 2] in "\n\r" and text[j - 2 : j] != "\r\n" else 3
        return out

    start, end, out = 0, 0, []
    while len(text) - start > limit:
        low, high = max(end + 1, start + 1, start + limit // 2), start + limit
        cuts = [j for j in range(low, high + 1) if strength(j)] or [j for j in range(max(end, start) + 1, low) if strength(j)]
        if not cuts and start < end:
            start = end
            continue
        end = max(cuts, key=lambda j: (strength(j), j)) if cuts else high
        out.append((start, end, not cuts))
        early = max(start + 1, end - overlap)
        start = next((j for j in range(early, end) if strength(j)), early)
    return [*out, (start, len(text), False)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.! \n\r…", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_pieces_are_those_of_plain_rules(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = splitting.split(np.frombuffer(text.encode("utf-32-le"), np.uint32), limit, overlap)
    assert got == _plain_split(text, limit, overlap)


def test_pieces_numbered_within_documents(spark, monkeypatch):
    monkeypatch.setattr(splitting, "NUMBER_BLOCK", 3)
    rows = [(i, "d" if i < 40 else None, (i * 7) % 20 if i % 5 else None, "x " * (i * 5)) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, doc string, place int, content string")
    pieces = splitting.split_oversized(items, "id", "content", 50, 10)
    got = sorted((r.doc or "", r.chunk_index, r.id, r.start_at) for r in splitting.renumbered(pieces, items, "id", "doc", "place").collect())
    want = []
    for doc in ("d", None):
        k = 0
        for i, _, _, text in sorted((r for r in rows if r[1] == doc), key=lambda r: (-1 if r[2] is None else r[2], r[0])):
            for a, _, _ in splitting.split(np.frombuffer(text.encode("utf-32-le"), np.uint32), 50, 10):
                want.append((doc or "", k, i, a))
                k += 1
    assert got == sorted(want)


def test_range_maximum():
    rnd = np.random.default_rng(3)
    s = rnd.integers(0, 5, 300).astype(np.int8)
    table = splitting.RangeMax(s, 10, 64)
    for _ in range(500):
        a = int(rnd.integers(0, 236))
        b = a + int(rnd.integers(0, 64))
        best = max(range(a, b + 1), key=lambda i: (s[i], i))
        assert table.best(a + 10, b + 10) == (s[best], best + 10)


def test_split_frame(spark):
    long = "word " * 60_000
    rows = spark.createDataFrame([(1, "x" * 900, "z"), (2, "", "z"), (3, None, "z"), (None, "a", "z"), (4, long, "z"), (5, "fits", "z")], "id long, content string, hard string")
    got = splitting.split_oversized(rows, "id", "content").collect()
    by = {k: sorted((r.chunk_index, r.start_at, r.end_at, r.content) for r in got if r.id == k) for k in (1, 2, 4, 5)}
    assert {r.id for r in got} == {1, 2, 4, 5} and by[2] == [(0, 0, 0, "")] and by[5] == [(0, 0, 4, "fits")]
    whole, at = "", 0
    for _, a, b, c in by[4]:
        whole, at = whole + c[at - a :], b
    assert whole == long
    assert sorted(tuple(r) for r in splitting.oversized(rows, "id", "content").collect()) == [(1, "long"), (1, "unbroken"), (4, "long")]


# Similar vectors


def _vectors(n: int, dim: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] * 0.5 + rng.normal(size=(n, dim)) * 0.5
    x[1::5] = x[: len(x[1::5])] + rng.normal(size=(len(x[1::5]), dim)) * 0.08
    return x.astype(np.float32)


def test_similar_pairs_find_all(spark):
    x = _vectors(3000, 384)
    x[100:140] = x[100]  # copies
    u = ann.unit(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, [1.0]), (9002, [0.0] * 384), (9003, [float("nan")] * 384), (None, x[0].tolist()), (9004, [float("inf")] * 384)]
    df = spark.createDataFrame(rows + rows[:50] + bad, "chunk_id long, embedding array<float>").repartition(4)
    got = {tuple(r) for r in ann.similar_pairs(df, "chunk_id", "embedding").collect()}
    g = u.astype(np.float64) @ u.T.astype(np.float64)
    np.fill_diagonal(g, -1)
    truth = set()
    for i in range(len(u)):
        for j in np.lexsort((np.arange(len(u)), -np.round(g[i], 6)))[:10]:
            if g[i, j] >= 0.8:
                truth.add((min(i, j), max(i, j)))
    assert len(truth) > 300 and len(got & truth) >= 0.98 * len(truth)
    assert len(got - truth) <= 0.01 * len(truth)


def _true_pairs(x):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True).astype(np.float64)
    g = u @ u.T
    np.fill_diagonal(g, -1)
    return {(min(i, j), max(i, j)) for i in range(len(u)) for j in np.argsort(-g[i], kind="stable")[:10].tolist() if g[i, j] >= 0.8}


def test_similar_pairs_of_a_dense_group(spark):
    rng = np.random.default_rng(3)
    x = _vectors(3000, 384, 3)
    x[::3] = (rng.normal(size=384) + rng.normal(size=(1000, 384)) * 0.3) * rng.uniform(0.5, 2, (1000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    got = {tuple(r) for r in ann.similar_pairs(df, "chunk_id", "embedding").collect()}
    truth = _true_pairs(x)
    group = {p for p in truth if p[0] % 3 == 0 and p[1] % 3 == 0}
    assert len(group) > 5000 and len(got & group) >= 0.98 * len(group)
    assert len(got & truth) >= 0.98 * len(truth) and len(got - truth) <= 0.02 * len(truth)


def test_similar_pairs_of_a_hub(spark):
    rng = np.random.default_rng(6)

    def away(v, c):
        w = rng.normal(size=384)
        w -= (w @ v) * v
        return c * v + np.sqrt(1 - c * c) * w / np.linalg.norm(w)

    hubs = ann.unit(rng.normal(size=(8, 384))).astype(np.float64)
    near = [away(h, c) for h in hubs for c in [0.95] * 12 + [0.81] * 150]
    late = [away(h, 0.83) for h in hubs for _ in range(10)]
    x = np.array([*hubs, *near, *late], np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    # All 172 others pass for a hub, and fewer than 165 for a late one: only the hub is crowded.
    got = {(r.id, r.neighbour) for r in ann.similar(df, "chunk_id", "embedding", floor=0.8, shortlist=165).collect()}
    # A hub's ten best are others, but it is the best of each of its late ones, which have greater ids.
    true = {(8 + len(near) + i, i // 10) for i in range(len(late))}
    assert len(got & true) >= 0.95 * len(true)


def test_pairs_at_the_floor_pass_the_codes():
    rng = np.random.default_rng(9)
    x = ann.unit(_vectors(4000, 384, 9))
    index = ann.fit(x, len(x), 32)
    code, approx = ann.encode(index, x, index.nearest(x, 1)[:, 0])
    along, spread = ann._along(x, approx)
    w = x[rng.permutation(len(x))]
    w = w - (w * x).sum(1, keepdims=True) * x
    q = 0.8 * x + 0.6 * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-6)
    tau = 0.8 * along - index.slack * 0.6 * spread
    assert ((q * approx).sum(1) < tau).mean() < 0.002


@pytest.mark.parametrize("coarse", [2_048, 8])
def test_distance_tables_give_the_scores_of_decoded_codes(coarse, monkeypatch):
    monkeypatch.setattr(ann, "MAX_COARSE", coarse)
    x = ann.unit(_vectors(6000, 384, 10))
    index = ann.fit(x, len(x), 48, base_cells=3)
    assert index.cells >= 16 and (len(index.fine) > 1) == (coarse == 8)
    home = index.nearest(x, 3)
    # The nearest cell is the nearest of all composed centroids, for nearly all (fine cells are sought in the nearest coarse ones).
    every = index.centroid(np.arange(index.cells))
    best = np.argmax(x @ every.T - (every * every).sum(1) / 2, axis=1)
    assert (home[:, 0] == best).mean() > 0.99
    code, approx = ann.encode(index, x, home[:, 0])
    tables = ann.Tables(index, x[:100])
    assert np.allclose(tables.scores(np.ascontiguousarray(code.T), home[:, 0]), approx @ x[:100].T, atol=1e-5)
    bound = index.bounds(np.arange(len(x)), x, home[:, 0], 10)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    assert (bound > 0).mean() > 0.9 and (bound <= np.partition(s, len(x) - 10, axis=1)[:, len(x) - 10]).all()


@pytest.mark.parametrize("k", [10, 20])
def test_copies_for_any_k(spark, k):
    rows = [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(30)] + [(90, [0.0, 1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    got = ann.similar(df, "chunk_id", "embedding", dim=4, k=k, subspaces=2, shortlist=0).collect()
    by = {i: [r.neighbour for r in sorted(got, key=lambda r: r.rank) if r.id == i] for i in [*range(30), 90]}
    assert all(by[i] == [j for j in range(30) if j != i][:k] for i in range(30)) and by[90] == list(range(k))


@pytest.mark.parametrize("cells", [1, 10_000])
def test_no_shortlist_is_exact(spark, cells):
    x = _vectors(1500, 48, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    kind = {"base_cells": 10_000, "query_cells": 1} if cells == 1 else {"base_cells": 1, "query_cells": cells}
    got = ann.similar(df, "chunk_id", "embedding", dim=48, k=10, shortlist=0, subspaces=8, **kind).collect()
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True).astype(np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert len(got) == 15_000
    assert {(r.id, r.neighbour) for r in got} == {(i, j) for i in range(1500) for j in np.argsort(-s[i], kind="stable")[:10].tolist()}


def test_hot_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_BLOCK", 100)
    monkeypatch.setattr(ann, "CODE_BLOCK", 300)
    x = _vectors(1200, 384, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    truth = _true_pairs(x)
    assert len({tuple(r) for r in ann.similar_pairs(df, "chunk_id", "embedding").collect()} & truth) >= 0.98 * len(truth)


def test_exact_best_in_blocks():
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + rng.normal(size=(400, 8)) * 0.3
    ids = np.arange(400) // 2  # two vectors of each id
    x[20:40] = x[0]
    best = ann._Best(ids[:100], x[:100], 10, 0.8)
    for i in range(0, 400, 150):
        best.add(ids[i : i + 150], x[i : i + 150], 64)
    got = {}
    for row, near in zip(best.row.tolist(), best.near.tolist()):
        got.setdefault(row, []).append(near)
    for row in range(100):
        cos = {}
        for j, c in zip(ids.tolist(), ann._cosines(x, x[row : row + 1]).tolist()):
            if j != ids[row] and c >= 0.8:
                cos[j] = max(cos.get(j, -1), c)
        assert got.get(row, []) == sorted(cos, key=lambda j: (-cos[j], j))[:10]


def test_knn_recall(spark):
    x = _vectors(4000, 384, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    got = ann.similar(df, "chunk_id", "embedding", base_cells=1, query_cells=48, query_every=50, shortlist=64, subspaces=96).collect()
    u = ann.unit(x)
    hits = 0
    for i in range(0, 4000, 50):
        s = u @ u[i]
        s[i] = -1
        hits += len({r.neighbour for r in got if r.id == i} & set(np.argsort(-s)[:10].tolist()))
    assert hits / (80 * 10) >= 0.9


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "chunk_id long, embedding array<float>")
    assert ann.similar_pairs(df, "chunk_id", "embedding").count() == 0
    assert ann.similar_pairs(df.limit(0), "chunk_id", "embedding").count() == 0


# Near duplicates


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = {i: [rnd.choice(words) for _ in range(120)] for i in range(300)}
    for i in range(300, 420):
        t = list(texts[i - 300])
        for _ in range(rnd.randint(0, 18)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts[i] = t
    rows = [(i, " ".join(t).upper(), "x") for i, t in texts.items()]
    rows += rows[:20] + [(900, None, "x"), (901, "", "x"), (902, "one two", "x"), (None, rows[0][1], "x"), (903, rows[0][1], "x"), (904, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "id long, content string, rep string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", 2, 0.6, 80).collect()}
    sets = {i: set(zip(w, w[1:])) for i, c, _ in rows if i is not None and c for w in [c.lower().split()]}
    sets = {i: s for i, s in sets.items() if len(s) >= 80}
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got <= truth and len(got) >= 0.98 * len(truth) and (0, 903) in got and (903, 904) in got
    members, links = neardup.near_duplicates(df, "id", "content", 2, 0.6, 80)
    groups = {r.id: r.group_id for r in neardup.groups(members, links).collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in got)
    assert neardup.near_duplicate_pairs(df.limit(0), "id", "content", 2, 0.6).count() == 0


def test_hot_anchors_are_split_without_loss(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(150)]
    # A third shares one text with few edits, a third only its beginning, the rest nothing.
    texts = {}
    for i in range(240):
        t = list(base) if i % 3 == 0 else base[:40] + [rnd.choice(words) for _ in range(110)] if i % 3 == 1 else [rnd.choice(words) for _ in range(150)]
        for _ in range(rnd.randint(1, 12)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts[i] = t
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, content string")
    sets = {i: set(zip(w, w[1:])) for i, w in texts.items()}
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    whole = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", 2, 0.6, 80).collect()}
    monkeypatch.setattr(neardup, "HOT", 10)
    split = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", 2, 0.6, 80).collect()}
    assert len(truth) > 2500 and split == whole and whole <= truth and len(whole) >= 0.98 * len(truth)


def test_least_text_of_an_id_counts(spark):
    rnd = random.Random(5)
    text = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    rows, truth = [], set()
    for g in range(20):
        least, other = ["a", *text(119)], ["b", *text(119)]
        like = [*other[:-2], "x", "y"]
        rows += [(10 * g, " ".join(least)), (10 * g, " ".join(other)), (10 * g + 1, " ".join(other)), (10 * g + 2, " ".join(other)), (10 * g + 3, " ".join(like)), (10 * g + 4, " ".join(least))]
        truth |= {(10 * g + 1, 10 * g + 2), (10 * g + 1, 10 * g + 3), (10 * g + 2, 10 * g + 3), (10 * g, 10 * g + 4)}
    df = spark.createDataFrame(rows, "id long, content string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", 2, 0.6, 80).collect()} == truth


def test_shared_anchor_within_the_threshold():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, (200, 4), dtype=np.uint64).astype(np.uint32)
    other = base.copy()
    other[np.arange(200), rng.integers(0, 4, 200)] = 7
    a, b = neardup.anchors(base, 1, 4), neardup.anchors(other, 1, 4)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    other[:, :] = rng.integers(0, 1 << 32, (200, 4), dtype=np.uint64).astype(np.uint32)
    assert not any(set(x) & set(y) for x, y in zip(a.tolist(), neardup.anchors(other, 1, 4).tolist()))


# Tokens


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_and_round_trip(spark, reference):
    rnd = random.Random(4)
    alphabet = "aàbcdeéinostrlü 's\n\t 0179.,;-_=/\\<|endoftext|>😀한국語​ \x85"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 150))) for _ in range(800)] + ["x" * 3000, "ab" * 1500, " " * 2000, "<|endoftext|>"]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenizer.encode_corpus(rows, "doc_id", "text").collect()}
    assert got.pop(-1) == [] and got.pop(-2) == []
    assert [got[i] for i in range(len(texts))] == reference(texts)
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(rows, "doc_id", "text"), "doc_id", "ids").collect()
    assert all(r.text == texts[r.doc_id] for r in back if r.doc_id >= 0)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 7))
def test_incremental_utf8(data, step):
    d = tokenizer.Utf8()
    got = "".join(d.feed(data[i : i + step]) for i in range(0, len(data), step)) + d.close()
    assert got == data.decode("utf-8", "replace")


# Leakage


def test_suffixes_and_search():
    rng = np.random.default_rng(0)
    seq = np.r_[rng.integers(1, 4, 400), 0]
    assert leakage.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    index = leakage.FMIndex.of(seq)
    rows = rng.integers(1, 5, (50, 4))
    live, lo, hi = index.search(rows)
    for k, row in enumerate(rows):
        places = [i for i in range(len(seq) - 4) if (seq[i : i + 4] == row).all()]
        at = np.flatnonzero(live == k)
        found = sorted(index.locate(np.arange(lo[at[0]], hi[at[0]])).tolist()) if len(at) else []
        assert found == places


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(30))
    part = " ".join(f"word{i}" for i in range(5, 17))
    filler = " ".join(f"f{i}" for i in range(3000))
    docs = spark.createDataFrame(
        [(1, f"{filler} {part} end"), (2, part.rsplit(" ", 1)[0]), (3, None), (4, ""), (None, part), (5, part.upper().replace("word7", "WÓRD7").replace("WORD9", "WO-\nRD9")), (6, f"{item} {filler} {item}"), (6, item), (7, filler * 100 + " " + item)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(10, item), (11, part), (12, "too short"), (13, None), (None, item)], "item_id long, text string")
    got = leakage.leaked_spans(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 5, 6, 7) for i in (10, 11)}
    assert [(r.first_word, r.last_word) for r in got if (r.doc_id, r.item_id) == (1, 10)] == [(3000, 3011)]
    assert sorted((r.first_word, r.last_word) for r in got if (r.doc_id, r.item_id) == (6, 10)) == [(0, 29), (3030, 3059)]
    assert leakage.leaked_spans(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.leaked_spans(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_one_index_serves_many_searches_in_passes(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    docs = {i: [rnd.choice(words) for _ in range(rnd.randint(0, 300))] for i in range(60)}
    docs[61] = [rnd.choice(words) for _ in range(5000)]
    items = {100 + i: docs[rnd.randrange(60)][5:30] + [rnd.choice(words)] * 3 for i in range(20)} | {200: docs[61][1000:1040], 201: docs[61][4900:]}
    monkeypatch.setattr(leakage, "PASS_CHARS", 300)
    corpus = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    index = leakage.materialize(leakage.build_index(corpus, "doc_id", "text"), "test-index")
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for size in (12, 5):
        truth = {(d, i) for d, w in docs.items() for i, v in items.items() if grams(w, size) & grams(v, size)}
        assert {(r.doc_id, r.item_id) for r in leakage.search_index(index, asked, "item_id", "text", size).collect()} == truth
    with pytest.raises(ValueError):
        leakage.search_index(index, asked, "item_id", "text", leakage.OVERLAP + 2)


def test_parts_of_a_long_document_share_words():
    import pyarrow as pa

    words = [f"w{i % 977}x{i}" for i in range(leakage.SHARD_WORDS + 500)]
    batch = pa.record_batch([pa.array([7]), pa.array([" ".join(words)])], names=["doc_id", "text"])
    rows = [r for b in leakage._indexed(iter([batch])) for r in b.to_pylist()]
    a = leakage.SHARD_WORDS
    phrases = leakage.Phrases([(1, " ".join(words[a - 30 : a + 30])), (2, " ".join(words[-12:])), (3, " ".join(words[-11:]))], 12)
    spans = {(s["item_id"], s["first_word"], s["last_word"]) for r in rows if (b := leakage._spans_of(r, phrases)) for s in b.to_pylist()}
    # The whole passage lies in the first part, which reaches OVERLAP words further, and partly in the second.
    assert len(rows) == 2 and spans == {(1, a - 30, a + 29), (1, a, a + 29), (2, len(words) - 12, len(words) - 1)}


def test_normal_words():
    assert leakage.normal_words("Ünï-\n  ted ﬁne x² Straße a-\nb c- d") == ["united", "fine", "x2", "strasse", "ab", "c", "d"]
    assert leakage.normal_words(unicodedata.normalize("NFD", "Café")) == ["cafe"]


# Quality


def test_rules_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/doc_labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/doc_labels.parquet").where("kind is not null"), "doc_id")
    both = docs.select("doc_id", "text").unionByName(big.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    extra = big.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "kind")
    train = labels.unionByName(extra.where("doc_id % 2 = 0"))
    got = quality.judge(both, "doc_id", "text", train, "doc_id", "kind").select("id", "rule")
    held = extra.where("doc_id % 2 = 1").join(got, F.col("doc_id") == F.col("id")).collect()
    right = sum((r.rule > 0) == (r.kind != "prose") for r in held) / len(held)
    assert right >= 0.92  # about one label in twenty is wrong


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " 　\n"), (None, "text"), (4, "a"), (5, "é" * 50_000), (6, "One two. Three!")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, kind string")
    got = quality.judge(docs, "doc_id", "text", none, "doc_id", "kind").collect()
    assert sorted((r.id, r.rule) for r in got) == [(4, 0), (5, 0), (6, 0)]
    stats = {r.doc_id: r for r in quality.statistics(docs, "doc_id", "text").collect()}
    assert set(stats) == {4, 5, 6} and stats[6].word_count == 3 and stats[6].line_end_ratio == 1.0
    assert quality.judge(docs.limit(0), "doc_id", "text", none, "doc_id", "kind").count() == 0


def test_case_expression(spark):
    rules = [[(0, True, 0.5), (1, False, 2.0)], [(1, True, 3.0)]]
    rows = spark.createDataFrame([(0.6, 1.0), (0.6, 4.0), (0.1, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(F.expr(quality.case_expression(rules, ["a", "b"]))).collect()] == [1, 2, 0]


def test_statistics_in_batches_are_those_of_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null")
    docs = docs.unionByName(spark.createDataFrame([(-1, "One two. Three!\r\n\n  x_1 = 5 　"), (-2, "é" * 5000), (-3, "?"), (-4, "a\r\rb c")], "doc_id long, text string"))
    want = {r.doc_id: tuple(r)[1:5] for r in quality.statistics(docs, "doc_id", "text").collect()}
    none = spark.createDataFrame([], "doc_id long, kind string")
    got = {r.id: (int(r.word_count), *(round(r[f], 6) for f in ("mean_word_length", "symbol_ratio", "line_end_ratio"))) for r in quality.judge(docs, "doc_id", "text", none, "doc_id", "kind").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_lines_and_windows():
    text = "- first item here\n1. second\n[x] third\na) fourth\nmany plain words in a line, with one comma\nname: value\nkey = 5\nname two: value\na|b|c|d\n" + "again\n" * 4 + "x" * 40 + "\nshort. Same. Same. Same.\n"
    t = quality._Texts([text, "other"])
    own, lines = t.lines
    held = text.split("\n")
    of = lambda key: [held[i] for i in np.flatnonzero(lines[key]) if i < len(held)]
    assert of("marked") == ["- first item here", "1. second", "[x] third", "a) fourth"]
    assert of("named") == ["name: value", "key = 5"] and of("cells") == ["a|b|c|d"] and of("ended") == ["short. Same. Same. Same."]
    assert lines["times"][held.index("again")] == 4 and lines["times"][0] == 1
    assert sorted(set(quality._sentences(t)[1].tolist())) == [0, 1, 3, 4]
    words = [t.points[a:b] for a, b in zip(t.start, t.stop)]
    assert "".join(chr(c) for w in words[:4] for c in w) == "-firstitemhere" and t.is_word[:4].tolist() == [False, True, True, True]
    which, weight, x = quality.windows_of(t, quality.Words(), np.zeros((8, 8)))
    assert set(which.tolist()) == {0, 1} and x.shape[1] == len(quality.WINDOWED) and abs(weight.sum() - len(text) - 5) <= 2


def test_pieces_of_long_texts_add_up(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "word one two. " * 500 + "\n- item\n" * 300)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, kind string")
    whole = quality.judge(docs, "doc_id", "text", none, "doc_id", "kind").first()
    # The workers' own pieces, cut here as they would be there.
    monkeypatch.setattr(quality, "PIECE", 100)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array([docs.first().text])], names=["id", "t"])
    sums = sum(quality._statistics_of(t, quality.Words()).sum(0) for _, t in quality._groups_of(batch, 1))
    assert abs(sums[0] - whole.word_count) <= len(docs.first().text) / 100 and sums[3] == len(docs.first().text)
