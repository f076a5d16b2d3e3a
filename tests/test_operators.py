from __future__ import annotations

import io
import os
import zipfile
from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import chunker, embed
from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.operators import filters, search, state
from docloom.operators import incremental
from docloom.operators import orphans as orphan_module
from docloom.operators.incremental import ChangeState, Conflict, content_hash, current_rows
from docloom.operators.orphans import Reference, orphans, runs
from docloom.runtime import materialize, scratch, work_path
from docloom.sources import listing, office
from docloom.plans import text_queries
from docloom.sources import pdf
from docloom.sources.snapshots import Snapshots
from docloom.streaming import events

FIELDS = ["last_modified", "status"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té😀", max_size=900), st.integers(1, 300), st.integers(-5, 320))
def test_chunks_cover_the_text(text, size, overlap):
    got = chunker.spans(text, size, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(a < b <= a + size for a, b in got)
    assert all(a < c <= b for (a, b), (c, _) in zip(got, got[1:]))


def test_chunk_lengths():
    assert chunker.spans("x" * 800) == [(0, 800)]
    assert chunker.spans("x" * 801) == [(0, 800), (700, 801)]
    words = "word " * 1000
    assert all(651 <= b - a <= 800 for a, b in chunker.spans(words)[:-1])
    assert chunker.spans("a\t" * 500)[0] == (0, 800)
    assert chunker.spans("x" * 2000, 0, 0)[0] == (0, 1500)


def test_text_functions(spark):
    rows = spark.createDataFrame([(" a\x00\r\n\r\n\r\nb\t\t c\u3000",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.sanitize(F.col("t"))).collect()] == ["a\n\nb c", None, ""]
    rows = spark.createDataFrame([("pipe-\nline M\nain a\nb\nc",)], "t string")
    assert rows.select(T.repair_pdf_lines(F.col("t"))).first()[0] == "pipeline Main ab c"
    rows = spark.createDataFrame([("C:\\Docs\\a_b\\x.TXT",), ("/a/bc",), ("/a/b/q",), ("/a/b",), ("noext",)], "p string")
    got = rows.select(T.basename("p"), T.extension("p"), T.under(F.col("p"), "/a/b"), T.under(F.col("p"), "C:\\Docs\\a_b")).collect()
    assert [tuple(r) for r in got] == [("x.TXT", ".txt", False, True), ("bc", "", False, False), ("q", "", True, False), ("b", "", True, False), ("noext", "", False, False)]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(V.l2_distance(a, b), V.cosine(a, b), V.normalize(a)).collect()
    assert tuple(got[0]) == (0.0, 1.0, [0.6000000000000001, 0.8]) or got[0][2] == pytest.approx([0.6, 0.8])
    assert tuple(got[1]) == (1.0, None, [0.0, 0.0])


def test_vectors_rounded_as_sql(spark):
    """Bit for bit: the sign of zeros, and halves that only the product with a million shows."""
    x = [-1e-9, -0.0, 0.0, 1e-9, 0.0000005, -0.0000005, 4.9999999999999994e-07, 0.1308335, -0.044401499999999997, 0.8029094999999999, -1.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", V.rounded(F.col("x"))).collect()
    want = {repr(v): repr(duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in x}
    assert {repr(a): repr(b) for a, b in got} == want
    rows = [(1, [0.0, 1.0]), (1, [-0.0, 1.0]), (1, [0.0, -1.0]), (2, [-0.0, 1.0]), (2, [-0.0, 1.0]), (3, [0.0, 1.0]), (None, [-0.0, 1.0])]
    for order in (rows, rows[::-1]):
        got = V.distinct_vectors(spark.createDataFrame(order, "i int, u array<double>").coalesce(1), "i", "u").collect()
        assert sorted(map(repr, map(tuple, got))) == ["(1, [0.0, -1.0])", "(1, [0.0, 1.0])", "(2, [-0.0, 1.0])", "(3, [0.0, 1.0])", "(None, [-0.0, 1.0])"]


def test_filters(spark):
    rows = spark.createDataFrame(
        [("a.txt", "/d", 50), ("a.txt", "/d", 49), ("a.TXT", "/d", 104857600), ("a.txt", "/d", 104857601), (".hidden.txt", "/d", 99), ("~$a.docx", "/d", 99), ("_n.txt", "/d", 99), ("x.log", "/d", 99),
         ("desktop.ini", "/d", 99), ("a.txt", "/d/node_modules", 99), ("a.md", "/d/Build", 99), ("noext", "/d", 99), ("a.txt", "/d", None)],
        "n string, f string, s long",
    )
    got = rows.where(filters.target(F.col("n"), F.col("f"), F.col("s"))).select("n", "s").collect()
    assert [tuple(r) for r in got] == [("a.txt", 50), ("a.TXT", 104857600), ("_n.txt", 99)]
    kinds = spark.createDataFrame([(b"%PDF-1.7",), (b"PK\x03\x04..",), (b" <!DOCTYPE html>",), (b"\xef\xbb\xbfhi",), (b"\xff\xfeh\x00",), (b"plain text",), (b"a\x00b",), (b"",), (b"BM rest",), (b"ID3 tags",), (b"%!PS-Adobe-3.0",), (b"GIF89a",), (b" <!-- x",), (b"<!--x",)], "c binary")
    assert [r[0] for r in kinds.select(filters.sniff(F.col("c"))).collect()] == [
        "application/pdf", "application/zip", "text/html; charset=utf-8", "text/plain; charset=utf-8", "text/plain; charset=utf-16le", "text/plain; charset=utf-8", "application/octet-stream", None,
        "image/bmp", "audio/mpeg", "application/postscript", "image/gif", "text/html; charset=utf-8", "text/plain; charset=utf-8"]
    assert kinds.where(filters.sniffed_ok(F.col("c"))).count() == 5
    assert kinds.where("c = x'706c61696e2074657874'").select(filters.sniff(F.col("c"), True)).first()[0] == "application/octet-stream"


def test_phrases_may_overlap(spark):
    chunks = spark.createDataFrame([(1, "h", 0, "A a á a"), (2, "h", 1, None), (3, "h", 2, "b"), (1, "h", 0, "A a á a")], "id long, document_hash string, chunk_index int, content string")
    got = {r.chunk_id: (r.tf, r.dl) for r in search.phrase_matches(chunks, ["a", "a"]).collect()}
    assert got == {1: (3, 4), 3: (0, 1)}
    assert search.bm25(search.phrase_matches(chunks, [])).count() == 0
    assert search.bm25(search.phrase_matches(chunks.limit(0), ["a"])).count() == 0


def test_changes_survive_failed_runs(spark):
    state_ = ChangeState(spark, work_path(spark, "test-state"))
    rows = spark.createDataFrame([(1, 10, "a", "x"), (2, None, None, "y"), (None, 1, "a", "z")], "id long, last_modified long, status string, k string")
    handed = lambda r: sorted(x.id for x in state_.changed(r, "id", FIELDS).collect())
    assert handed(rows) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        state_.run(rows.where("id = 2"), "id", FIELDS, lambda taken, number: 1 / 0)
    assert handed(rows) == [1, 2]
    # A dead run is not taken for free: it is resumed, with the rows that it took, whatever came since.
    with pytest.raises(Conflict):
        state_.run(rows, "id", FIELDS, lambda taken, number: None)
    given = []
    assert state_.run(rows, "id", FIELDS, lambda taken, number: given.extend((r.id, number) for r in taken.collect()), resume=True) == 1
    assert given == [(2, 1)] and handed(rows) == [1]
    assert state_.run(rows, "id", FIELDS, lambda taken, number: None) == 2
    assert handed(rows) == [] and handed(rows.limit(0)) == []
    assert handed(rows.withColumn("status", F.lit("b"))) == [1, 2]
    # A crash between work and commit: the work isn't done again.
    commit, state_.commit = state_.commit, lambda *a, **k: 1 / 0
    new, times = rows.withColumn("status", F.lit("b")), []
    with pytest.raises(ZeroDivisionError):
        state_.run(new, "id", FIELDS, lambda taken, number: times.append(taken.count()))
    state_.commit = commit
    assert handed(new) == [1, 2]
    assert state_.run(new, "id", FIELDS, lambda taken, number: times.append(taken.count()), resume=True) == 3
    assert times == [2] and handed(new) == [] and not state_.manifests.exists("run-3")


def test_of_two_writers_the_first_wins(spark):
    path = work_path(spark, "test-writers")
    a, b = ChangeState(spark, path), ChangeState(spark, path)
    rows = spark.createDataFrame([(i, i) for i in range(4)], "id long, v long")
    create, manifests = b.manifests.create, b.manifests

    def late(name, text):
        if name == "manifest-1":  # between b's look at the versions and its own file
            a.commit(rows.where("id < 2"), "id", ["v"])
        return create(name, text)

    manifests.create = late
    with pytest.raises(Conflict):
        b.commit(rows.where("id >= 2"), "id", ["v"])
    manifests.create = create
    assert sorted(r.id for r in a.changed(rows, "id", ["v"]).collect()) == [2, 3]
    assert b.commit(rows.where("id >= 2"), "id", ["v"]) == 2 and a.changed(rows, "id", ["v"]).count() == 0
    with pytest.raises(Conflict):
        a.commit(rows, "id", ["v"], after=1)


def test_segments_are_merged_by_levels(spark):
    state_ = ChangeState(spark, work_path(spark, "test-levels"))
    for i in range(18):
        state_.commit(spark.createDataFrame([(i, i)], "id long, v long"), "id", ["v"])
    held = state_.manifest()["segments"]
    assert sorted(s.split("-")[1] for s in held) == ["0", "0", "1", "1"] and state_.seen().count() == 18
    names = [p for p in os.listdir(state_.path.removeprefix("file:")) if p.startswith("segment-")]
    assert set(held) <= set(names) and len(names) <= len(held) + 2 * incremental.FAN


def test_intermediate_folders_go(spark):
    with scratch():
        kept = materialize(spark.range(5), "test-scratch")
        path = kept._docloom_path
        assert kept.count() == 5 and os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_hash_tells_nulls_and_borders_apart(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("~", "ab"), ('a","=b', "")], "x string, y string")
    assert rows.select(content_hash("x", "y").alias("h")).distinct().count() == 6


def test_current_row(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, None, t, "old"), (1, 5, t + timedelta(1), "late"), (1, 5, t, "early"), (1, 5, t, "early"), (2, None, None, "only"), (None, 1, t, "x")], "id long, v long, at timestamp, s string")
    assert {r.id: r.s for r in current_rows(rows, "id", "v", "at").collect()} == {1: "early", 2: "only"}


def test_orphans(spark):
    t = datetime(2024, 3, 9)
    rows = spark.createDataFrame([(1, 5, t), (2, 65536, t), (3, -1, t), (4, None, t), (5, 7, None), (6, 5, t)], "id long, k long, at timestamp")
    parents = spark.createDataFrame([(5,), (6,), (6,), (65535,), (None,)], "p long")
    keys = parents.where("p is not null").select(F.lit(0).alias("f"), F.lit("b").alias("block"), F.col("p").alias("k"))
    assert sorted((r.first, r.last) for r in runs(keys).collect()) == [(5, 6), (65535, 65535)]
    got = orphans([Reference("t", "k", rows, parents, "p")], ["id"], ["at"]).collect()
    assert sorted((r.row_id, r.period) for r in got if r.period) == [(2, "2024-03"), (3, "2024-03")] and [r.row_id for r in got if not r.period] == [5]
    texts = rows.select("id", F.concat(F.lit("A"), F.col("k").cast("string")).alias("k"), "at")
    names = spark.createDataFrame([("a5",), ("A7",)], "p string")
    assert sorted(r.row_id for r in orphans([Reference("t", "k", texts, names, "p")], ["id"], ["at"]).collect()) == [1, 2, 3, 6]
    assert orphans([Reference("t", "k", rows, parents.limit(0), "p")], ["id"], ["at"]).count() == 5
    assert orphans([Reference("t", "k", rows.limit(0), parents, "p")], ["id"], ["at"]).count() == 0


def test_runs_of_string_keys_end_at_orphans_only(spark, monkeypatch):
    names = spark.createDataFrame([(f"{i * 7919:08x}",) for i in range(2000)], "p string")
    rows = spark.createDataFrame([(i, f"{i * 7919:08x}" if i % 100 else f"{i * 7919:08x}z", None) for i in range(2000)], "id long, k string, at timestamp")
    for size, blocks in ((32_768, 1), (100, 20)):
        monkeypatch.setattr(orphan_module, "BLOCK_KEYS", size)
        keys = orphan_module.ranked_keys([Reference("t", "k", rows, names, "p")])
        found = runs(keys.where("parent").select("f", "block", "k"))
        assert found.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == 2000 and found.count() <= 20 + blocks
        assert sorted(r.row_id for r in orphans([Reference("t", "k", rows, names, "p")], ["id"], ["at"]).collect()) == list(range(0, 2000, 100))


def test_state_machine(spark):
    now = 10 * 24 * 3600
    files = spark.createDataFrame(
        [(1, "/a", "/a/x", "x", None, 1, 1, "pending", 2, 5), (2, "/a", "/a/y", "y", "h", 2, 2, "missing", 0, now - state.RETENTION), (3, "/ab", "/ab/z", "z", "h", 2, 2, "missing", 0, now), (4, "/a", "/a/n", "n", None, 1, 1, None, None, None)],
        "id long, folder_path string, path string, file_name string, file_hash string, size long, last_modified long, status string, retry_count int, updated_at long",
    )
    failed = {r.id: (r.status, r.retry_count) for r in state.record_failures(files, files.where("id in (1, 4)"), now).collect()}
    assert failed[1] == ("failed", 3) and failed[4] == ("pending", 1) and failed[2] == ("missing", 0)
    assert sorted(r.id for r in state.expire(files, now).collect()) == [1, 3, 4]
    assert {r.id for r in state.mark_missing(files, "/a", now).where("status = 'missing'").collect()} == {1, 2, 3, 4}
    folders = spark.createDataFrame([("/a", "missing", 1), ("/a/b", None, 1), ("/ab", "ignored", None)], "path string, status string, updated_at long")
    dirs, moved = state.rename_tree(folders, files, "/a", "/q", now)
    assert {(r.path, r.folder_path, r.updated_at == now) for r in moved.collect()} == {("/q/x", "/q", True), ("/q/y", "/q", True), ("/ab/z", "/ab", True), ("/q/n", "/q", True)}
    assert {tuple(r) for r in dirs.collect()} == {("/q", "active", now), ("/q/b", "active", now), ("/ab", "ignored", None)}
    one = {r.id: r for r in state.rename_file(files, "/a/x", "/k/new.txt", now).collect()}
    assert (one[1].path, one[1].file_name, one[1].folder_path, one[1].status, one[1].updated_at) == ("/k/new.txt", "new.txt", "/k", "pending", now) and one[2].path == "/a/y"
    found = spark.createDataFrame([("/new/y", 2, 2, "h"), ("/new/z", 2, 2, "g")], "path string, size long, mtime long, hash string")
    assert [tuple(r) for r in state.ghosts(files, found).collect()] == [("/new/y", 2)]
    done = files.select("path", "folder_path", "file_name", "size", "last_modified", F.lit("k").alias("file_hash"))
    after, refused = state.upsert_active(files, done, now)
    x = {r.path: r for r in after.collect()}["/a/x"]
    assert (x.status, x.retry_count, x.file_hash, x.updated_at) == ("active", 2, "k", now)
    assert [r.path for r in refused.where("path = '/a/x'").collect()] == []
    assert {r.path: r.status for r in after.collect()}["/a/x"] == "active" and sorted(r.path for r in refused.collect()) == ["/a/n", "/a/y", "/ab/z"]


def test_stream_gives_the_same_bursts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(seconds=s), p, "write", None, False) for i, (s, p) in enumerate([(0, "a"), (2, "a"), (9, "a"), (1, "b"), (600, "z")])]
    schema = "event_id long, ts timestamp, path string, op string, old_path string, is_dir boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    got: list[tuple] = []
    q = events.watch(events.read_events(spark, str(tmp_path / "in")), lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    batch = events.debounce(spark.createDataFrame(rows, schema)).where("path <> 'z'").collect()
    assert sorted(got) == sorted(tuple(r) for r in batch) and len(got) == 3


def test_office_readers():
    def packed(parts):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return data.getvalue()

    slide = lambda x: f"<s><p><t>{x}</t></p></s>"
    assert office.extract("a.PPTX", packed({f"ppt/slides/slide{i}.xml": slide(i) for i in (1, 10, 2)} | {"ppt/slides/slide3.xml": "<s>"})) == ("1 2 10", None)
    assert office.extract("a.docx", packed({"word/document.xml": "<d><p><t>one</t><t>two</t></p><t>out</t></d>"})) == ("onetwo out", None)
    assert "missing" in office.extract("a.docx", packed({"x": ""}))[1]
    assert office.extract("a", b"x")[1] == "no extension" and office.extract("a.exe", b"x")[1].startswith("unsupported") and office.extract("a.txt", b" \n ")[1] == office.EMPTY
    assert office.extract("a.md", b"a \xff b\r\n\n\nc")[0] == "a b\nc"
    assert office.extract("a.pdf", b"x", lambda d: ["pipe-\nline", None, " "]) == ("pipeline", None) and office.extract("a.pdf", b"x")[1]


def test_listing_keeps_hidden_and_prunes(spark, tmp_path):
    for p in ("_notes.txt", "_priv/b.txt", "node_modules/c.txt", "d/e/f/g/h.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * 60)
    (tmp_path / "empty").mkdir()
    got = listing.list_tree(spark, [str(tmp_path)])
    names = {r.path.removeprefix(str(tmp_path)) for r in got.collect()}
    assert sorted(names) == sorted(r.path.removeprefix(str(tmp_path)) for r in listing.list_tree(spark, [str(tmp_path)], spread=1).collect())
    assert {"/_notes.txt", "/_priv/b.txt", "/d/e/f/g/h.md", "/empty"} <= names and not any("node_modules" in n for n in names)
    assert {len(r.content) for r in listing.read_contents(got).collect()} == {60}


def test_no_prefix_of_a_large_file(spark, tmp_path):
    for n in (9, 10, 11):
        (tmp_path / f"{n}.txt").write_text("x" * n)
    got = listing.read_contents(listing.list_tree(spark, [str(tmp_path)]), most=10).collect()
    assert {r.path.rsplit("/", 1)[1]: r.content and len(r.content) for r in got} == {"9.txt": 9, "10.txt": 10, "11.txt": None}


def test_snapshots(spark):
    s = Snapshots(spark, work_path(spark, "test-snapshots"))
    s.commit(a=spark.range(3), b=spark.range(2))
    s.commit(a=spark.range(5))
    assert (s.read("a").count(), s.read("b").count()) == (5, 2)
    with pytest.raises(Conflict):
        s.commit(after=1, a=spark.range(1))
    tries = []

    def change(tables):
        tries.append(1)
        if len(tries) == 1:
            s.commit(b=spark.range(7))  # someone else is faster
        return {"a": tables["b"]}

    assert s.transform(change) == 4 and (s.read("a").count(), len(tries)) == (7, 2)


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "the quick fox"), (2, "the quick fox"), (3, ""), (4, None)], "id long, t string")
    got = {r.id: r for r in embed.embed(rows, "id", "t").collect()}
    assert got[1].embedding == got[2].embedding and len(got[1].embedding) == 384 and got[3].error and got[4].embedding is None
    assert sum(x * x for x in got[1].embedding) == pytest.approx(1, abs=0.01)


def test_places_of_tied_matches(spark):
    rows = [(i * 40_000, -float(i % 3)) for i in range(30)] + [(7, -1.0)]
    got = {r.chunk_id: r.rank_fts for r in search.numbered(spark.createDataFrame(rows, "chunk_id long, rank double")).collect()}
    assert got == {c: k for k, (c, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}


def _little_corpus(spark):
    chunks = spark.createDataFrame(
        [(1, "h1", 0, "The red fox. Red fox!"), (2, "h1", 1, "a blue whale"), (3, "h2", 0, "Fóx, red; fox"), (4, "h3", 0, None), (5, "h4", 0, ""), (3, "h2", 0, "Fóx, red; fox")],
        "id long, document_hash string, chunk_index int, content string",
    )
    files = spark.createDataFrame([("/a", "a.txt", "h1"), ("/b", "b.txt", "h1"), ("/c", "c.txt", "h2"), ("/d", "d.txt", None)], "path string, file_name string, file_hash string")
    vectors = embed.embed(chunks.distinct(), "id", "content").select(F.col("id").alias("chunk_id"), "embedding")
    return vectors, chunks, files


def test_search_call(spark):
    v, c, f = _little_corpus(spark)
    got = [tuple(r) for r in search.search(v, c, f, '  "Red" fox ').collect()]
    assert got[0] in {("/a", "a.txt"), ("/c", "c.txt")} and set(got) == {("/a", "a.txt"), ("/b", "b.txt"), ("/c", "c.txt")}
    assert [r.file_path for r in search.search(v, c, f, "a blue whale", hybrid=False).collect()] == ["/a", "/b"]
    for blank in (None, "", " \u3000\n"):
        assert search.search(v, c, f, blank).count() == 0
    assert search.search(v, c, f, "?!").count() == 3  # no word: the nearest chunks only
    assert search.search(v.limit(0), c.limit(0), f, "fox").count() == 0


def test_batch_search_is_search_for_each(spark):
    v, c, f = _little_corpus(spark)
    texts = {1: "red fox", 2: '"fox red"', 3: "", 4: None, 5: "...", 6: "whale", 7: "a blue whale"}
    vec = embed.hashing([t or "x" for t in texts.values()]).tolist()
    q = spark.createDataFrame([(i, t, e, False if i == 7 else None if i == 6 else True) for (i, t), e in zip(texts.items(), vec)], "query_id long, query_text string, embedding array<float>, hybrid boolean")
    got = search.search_batch(v, c, f, q, 384).collect()
    assert {r.query_id for r in got} == {1, 2, 5, 6, 7}
    for i in (1, 2, 5, 6):
        phrase = search.phrases_of(q.where(F.col("query_id") == i)).first()
        one = search.hybrid_search(v, c, f, vec[i - 1], 384, phrase["phrase"] if phrase else []).collect()
        assert {tuple(r) for r in one} == {tuple(r)[1:] for r in got if r.query_id == i}
        assert [tuple(r) for r in one] == sorted(map(tuple, one), key=lambda r: (-r[4], r[0], r[2]))
    assert {(r.chunk_id, r.file_path, r.combined_score) for r in got if r.query_id == 7} == {(2, "/a", 1.0), (2, "/b", 1.0)}


def test_nearest_in_blocks_and_with_repeated_ids(spark, monkeypatch):
    rng = __import__("numpy").random.default_rng(2)
    x = rng.normal(size=(500, 8)).astype("float32")
    x[100:120] = x[0]
    rows = [(i // 2, v.tolist()) for i, v in enumerate(x)] + [(999, None), (None, x[0].tolist()), (998, [0.0] * 8), (997, [float("nan")] * 8), (996, [1.0])]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)] + [(77, None)], "query_id long, embedding array<float>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    got = {}
    for r in search.knn_batch(v, q, 8, k=5).orderBy("query_id", "distance", "chunk_id").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i in range(40):
        best = {}
        for j, d in enumerate(((x.astype("float64") - x[i].astype("float64")) ** 2).sum(1).tolist()):
            best[j // 2] = min(d, best.get(j // 2, d))
        assert got[i] == sorted(best, key=lambda j: (best[j], j))[:5]


def test_paths_and_formats(spark):
    clean = {"": ".", "/": "/", "//a//b/": "/a/b", "a/./b/..": "a", "../x/../..": "../..", "/../a": "/a", "C:\\x\\..\\y\\": "C:\\y", "a/../..": "..", "./": "."}
    rows = spark.createDataFrame([(k,) for k in clean], "p string")
    assert {r[0]: r[1] for r in rows.select("p", T.clean_path(F.col("p"))).collect()} == clean
    sizes = spark.createDataFrame([(0,), (1,), (1023,), (1024,), (1536,), (1048576,), (3 * 1024**4,), (None,)], "n long")
    assert [r[0] for r in sizes.select(T.format_bytes(F.col("n"))).collect()] == ["0 B", "1.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "3072.0 GB", None]
    times = spark.createDataFrame([(1704467096,), (0,), (None,)], "n long")
    assert [r[0] for r in times.select(T.format_date(F.col("n"))).collect()] == ["Jan 5, 2024, 03:04 PM", "—", "—"]
    back = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(V.from_json(V.to_json(F.col("v")))).collect()
    assert back[0][0] == [1.5, -2.0] and back[1][0] is None


def test_pdf_reader():
    body = b"BT /F1 12 Tf 72 700 Td (Hello \\(World\\)) Tj 0 -14 Td [(Sec)-10(ond)-300(line)] TJ T* (\\344) Tj ET"
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 6 0 R]/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>",
             b"<</Length %d>>stream\n%b\nendstream" % (len(body), body), b"<</Type/Font/Subtype/Type1>>", b"<</Type/Page/Parent 2 0 R/Contents 7 0 R>>", b"<</Filter/LZWDecode/Length 1>>stream\nx\nendstream"]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj%b endobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"trailer<</Root 1 0 R>>"
    assert pdf.pages(data) == ["Hello (World)\nSecond line\n\u00e4", None]
    assert office.extract("a.pdf", data) == ("Hello (World) Second line \u00e4", None)
    assert "encrypted" in office.extract("a.pdf", data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R"))[1]
    assert office.extract("a.pdf", text_queries._as_pdf("wor-\nd \U0001f600\n\nzwei\x0cthree"))[0] == "word \U0001f600 zwei three"
    assert office.extract("a.pdf", b"text")[1].startswith("unreadable") and office.extract("a.txt", b"x" * (office.LONGEST_LINE + 1))[1]
