"""The engine from the disk to search results, with failures, other writers and maintenance."""

from __future__ import annotations

import os

import pytest
from docloom import engine as E
from docloom.operators import state as M
from docloom.operators.incremental import Conflict
from docloom.runtime import shared_dir, work_path



@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


TEXT = "The quick brown fox jumps over the lazy dog near the river bank. "


def _write(root, name, text, mtime=1_700_000_000):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(p, (mtime, mtime))
    return str(p)


def _files(engine):
    return {r.file_name: r for r in engine.tables()[1]["files"].collect()}


def test_life_of_an_index(spark, tmp_path):
    root = tmp_path / "docs"
    a = _write(root, "a.txt", TEXT * 30)
    _write(root, "sub/copy.txt", TEXT * 30)
    b = _write(root, "b.md", "Zebras graze in the savanna, and the zebra herd is large. " * 3)
    _write(root, "spoof.txt", b"GIF89a" + b"x" * 100)
    _write(root, "bad.docx", b"PK\x03\x04" + b"y" * 100)
    _write(root, "node_modules/no.txt", TEXT * 3)
    _write(root, "tiny.txt", "x")
    e = E.Engine(spark, work_path(spark, "test-engine"))
    r = e.watch([str(root)], 1000)
    assert r.version == 1 and r.counts == {"seen": 5, "same": 0, "back": 0, "claimed": 0, "indexed": 3, "failed": 1, "chunks": r.counts["chunks"]}
    f = _files(e)
    assert {n: (x.status, x.retry_count) for n, x in f.items()} == {"a.txt": ("active", 0), "copy.txt": ("active", 0), "b.md": ("active", 0), "bad.docx": ("pending", 1)}
    assert f["a.txt"].file_hash == f["copy.txt"].file_hash and len({x.id for x in f.values()}) == 4
    _, t = e.tables()
    assert t["documents"].count() == 2 and t["chunks"].count() == t["vec_chunks"].count() == t["words"].count() == r.counts["chunks"] == t["chunks"].select("id").distinct().count()
    assert {x.path.rsplit("/", 1)[1] for x in t["folders"].collect()} == {"docs", "sub"}
    assert {(x.kind, x.path.rsplit("/", 1)[1]) for x in e.alerts().collect()} == {("file-rejected", "spoof.txt"), ("file-error", "bad.docx"), ("folder-tree-updated", "docs")}
    assert e.search(" zebra herd ").first().file_name == "b.md" and e.search("").count() == 0
    # Another try of the bad file; then one is moved, one changed and one lost while no one looks.
    assert e.retry(1200).counts["failed"] == 1 and _files(e)["bad.docx"].retry_count == 2
    os.rename(a, root / "sub" / "moved.txt")
    os.remove(root / "bad.docx")
    _write(root, "b.md", "Penguins walk on the ice all winter long, far from zebras. " * 3, 1_700_000_500)
    r = e.boot([str(root)], 2000)
    assert (r.counts["claimed"], r.counts["indexed"], r.counts["seen"]) == (1, 1, 3)
    f = _files(e)
    assert "a.txt" not in f and f["moved.txt"].status == "active" and f["moved.txt"].file_hash == f["copy.txt"].file_hash and f["bad.docx"].status == "missing"
    assert e.search("penguins walk").first().file_name == "b.md" and e.tables()[1]["documents"].count() == 2
    # A missing file that comes back with its content, and retention.
    e.remove(b, 3000)
    assert e.boot([str(root)], 4000).counts["back"] == 1 and _files(e)["b.md"].status == "active"
    done = e.clean(2000 + M.RETENTION)
    assert done.counts == {"files": 1, "folders": 0} and "bad.docx" not in _files(e)
    e.rename(str(root / "sub"), str(root / "new"), True, 5000)
    assert _files(e)["moved.txt"].path.endswith("/new/moved.txt")
    e.unwatch(str(root / "new"), 6000)
    f, (_, t) = _files(e), e.tables()
    assert set(f) == {"b.md"} and t["documents"].count() == 1 and t["chunks"].select("document_hash").distinct().count() == 1
    e.remove(str(root), 7000)
    assert {x.status for x in _files(e).values()} == {"missing"}


def test_a_dying_step_changes_nothing_and_a_rerun_repeats_nothing(spark, tmp_path):
    root = tmp_path / "docs"
    _write(root, "a.txt", TEXT * 3)
    e = E.Engine(spark, work_path(spark, "test-death"))
    publish, e.store.manifests.publish = e.store.manifests.publish, lambda m: 1 / 0
    with pytest.raises(ZeroDivisionError):
        e.watch([str(root)], 10)
    assert e.tables()[0] == 0 and os.listdir(e.store.path.removeprefix("file:")) == []
    calls = []

    def late(manifest):
        calls.append(1)
        if len(calls) == 1:
            raise Conflict("someone else was first")
        publish(manifest)

    e.store.manifests.publish = late
    assert e.watch([str(root)], 10).version == 1 and len(calls) == 2
    assert e.tables()[1]["chunks"].count() == 1 and e.tables()[1]["files"].count() == 1
    base = shared_dir(spark).removeprefix("file:") + "/docloom"
    left = {n.split("-")[0] for n in os.listdir(base)}
    assert not left & {"listing", "seen", "claims", "fresh", "texts", "pieces", "embedded", "errors", "failed", "files", "chunks"}


def test_jobs_run_at_once_and_then_by_the_clock():
    ran, slept = [], []
    assert E.every([ran.append, lambda now: ran.append(-now)], 5, rounds=3, clock=lambda: 7.9, sleep=slept.append) == 3
    assert ran == [7, -7] * 3 and slept == [5, 5]
