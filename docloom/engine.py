"""The whole index as one engine: trees are watched, files taken in, maintained and searched; each step is one commit.

Taking in: filter, sniff, hash, compare with the state, claim ghosts, extract, cut, embed, guarded upsert. Metadata tables
(folders, files, documents) are replaced by a commit; chunks, vectors and the words of the keyword index are only added
to, and rows whose document is gone are left out on reading, until clean() writes them anew. A step that dies leaves the
version before it; a step that meets another writer's commit is made anew from it.

Defined results: a file of content already indexed shares the document; one that fails counts a try and stays pending,
its tries beginning anew when its content changes; a missing file that is back with its content is active again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import chunker, embed
from docloom.functions import text as T
from docloom.operators import filters, search
from docloom.operators import state as M
from docloom.operators.incremental import Conflict
from docloom.runtime import materialize, scratch, ship_package
from docloom.sources import listing, office
from docloom.sources.snapshots import Snapshots

SCHEMAS = {
    "folders": "path string, status string, updated_at long, is_public boolean",
    "files": "id long, folder_path string, path string, file_name string, file_hash string, size long, last_modified long, status string, retry_count int, updated_at long",
    "documents": "hash string, created_at long",
    "chunks": "id long, document_hash string, chunk_index int, content string",
    "vec_chunks": "chunk_id long, embedding array<float>",
    "words": "chunk_id long, dl int, words array<string>",
    "alerts": "at long, kind string, path string, detail string",
}
DAY = 24 * 3600


@dataclass
class Report:
    """What a step did: the version that it made and its counts."""

    version: int
    counts: dict[str, int] = field(default_factory=dict)


def hashed(contents: DataFrame) -> DataFrame:
    """(path, ok, hash) of (path, content): whether the type is one that is indexed, and the 64-bit hash of the bytes."""
    ship_package(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            h = [None if c is None or not c.is_valid else f"{xxhash.xxh64_intdigest(c.as_buffer()):016x}" for c in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(h, pa.string())], names=["path", "ok", "hash"])

    return contents.select("path", filters.sniffed_ok(F.col("content")).alias("ok"), "content").mapInArrow(run, "path string, ok boolean, hash string")


def numbered(rows: DataFrame, block: str, order: list[str], start: int) -> DataFrame:
    """With an id: numbers from start on, block after block. The blocks must be few; only their counts meet in one task."""
    counts = rows.groupBy(block).agg(F.count("*").alias("__n"))
    before = counts.select(block, (F.sum("__n").over(Window.orderBy(block)) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(block).orderBy(*order))
    return rows.join(F.broadcast(before), block).withColumn("id", F.lit(start) + F.col("__before") + place - 1).drop("__before")


def _counts(kinds: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each, counted together."""
    every_kind = None
    for name, rows in kinds.items():
        part = rows.select(F.lit(name).alias("name"))
        every_kind = part if every_kind is None else every_kind.unionByName(part)
    return dict.fromkeys(kinds, 0) | {r.name: r.n for r in every_kind.groupBy("name").agg(F.count("*").alias("n")).collect()}


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: embed.Embedder = embed.hashing, pdf: office.PdfReader | None = None, size: int = 800, overlap: int = 100):
        self.spark, self.store = spark, Snapshots(spark, path)
        self.embedder, self.pdf, self.size, self.overlap = embedder, pdf, size, overlap

    # Reading

    def tables(self) -> tuple[int, dict[str, DataFrame]]:
        """A version and all its tables; chunks, vectors and words are those of documents that are there."""
        version, there = self.store.read_all()
        t = {name: there[name] if name in there else self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        t["chunks"] = t["chunks"].join(t["documents"].select(F.col("hash").alias("document_hash")), "document_hash", "left_semi")
        ids = t["chunks"].select(F.col("id").alias("chunk_id"))
        return version, t | {name: t[name].join(ids, "chunk_id", "left_semi") for name in ("vec_chunks", "words")}

    def search(self, text: str | None, hybrid: bool = True) -> DataFrame:
        """(file_path, file_name) of the files found, the best first."""
        _, t = self.tables()
        return search.search(t["vec_chunks"], t["chunks"], t["files"], text, hybrid, self.embedder, words=t["words"])

    def file_info(self, path: str) -> DataFrame:
        return M.file_info(self.tables()[1]["files"], path)

    def alerts(self) -> DataFrame:
        return self.tables()[1]["alerts"]

    # Steps

    def _step(self, change: Callable[[dict[str, DataFrame]], tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, int]]], tries: int = 3) -> Report:
        """Commit change(tables), which gives tables to replace, rows to add, and counts."""
        for left in reversed(range(tries)):
            version, t = self.tables()
            try:
                with scratch():
                    new, more, counts = change(t)
                    return Report(self.store.commit(after=version, append=more, **new), counts)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def _alert(self, rows: Iterable[tuple[str, str, str | None]], now: int) -> DataFrame:
        return self.spark.createDataFrame([(now, *r) for r in rows], SCHEMAS["alerts"])

    def watch(self, roots: list[str], now: int) -> Report:
        """List trees, make their folders active and take their files in."""
        return self._step(lambda t: self._take_in(t, *self._listed(roots), now, [("folder-tree-updated", r, None) for r in roots]))

    def boot(self, roots: list[str], now: int) -> Report:
        """Bring the state in line with the disk: files and folders that are gone become missing, ignored folders that are
        gone are forgotten, new and changed files outside ignored trees are taken in."""

        def change(t):
            dirs, seen = self._listed(roots)
            known = materialize(dirs.select("path").unionByName(seen.select("path")), "disk")
            t = dict(t)
            t["files"] = M.sweep(t["files"], known, now)
            gone = M.vanished_ignored(t["folders"], known)
            away = gone.join(known.withColumn("there", F.lit(1)), "path", "left")
            lost = F.col("there").isNull() & F.coalesce(F.col("status") != "missing", F.lit(True))
            t["folders"] = away.withColumns({"status": F.when(lost, "missing").otherwise(F.col("status")), "updated_at": F.when(lost, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).drop("there")
            changed = M.reconcile(seen.select("path", "size", "mtime"), t["files"].where("status <> 'missing' or status is null"), t["folders"])
            dirs = dirs.join(M.reconcile(dirs.select("path", "size", "mtime"), t["files"].limit(0), t["folders"]).select("path"), "path", "left_semi")
            return self._take_in(t, dirs, seen.join(changed.select("path"), "path", "left_semi"), now, [("boot-sync-complete", ", ".join(roots), None)])

        return self._step(change)

    def retry(self, now: int) -> Report:
        """Take the files in again that failed before and may be tried again."""

        def change(t):
            again = M.to_retry(t["files"]).select("path", "size", F.col("last_modified").alias("mtime"))
            return self._take_in(t, self.spark.createDataFrame([], "path string"), again, now, [])

        return self._step(change)

    def clean(self, now: int) -> Report:
        """Delete what has been missing for the retention time, and write the chunks that are left anew."""

        def change(t):
            folders, files = M.expire(t["folders"], now), M.expire(t["files"], now)
            files, documents, chunks, vectors = M.cascade(folders, files, t["documents"], t["chunks"], t["vec_chunks"], t["files"])
            words = t["words"].join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
            n = _counts({"files": files, "folders": folders, "old_files": t["files"], "old_folders": t["folders"]})
            counts = {name: n[f"old_{name}"] - n[name] for name in ("files", "folders")}
            return {"folders": folders, "files": files, "documents": documents, "chunks": chunks, "vec_chunks": vectors, "words": words}, {}, counts

        return self._step(change)

    def unwatch(self, root: str, now: int) -> Report:
        """A tree is ignored from now on; its files and what only they held go."""

        def change(t):
            folders, files = M.unwatch(t["folders"], t["files"], root, now)
            documents = M.cascade(folders, files, t["documents"], t["chunks"], t["vec_chunks"], t["files"])[1]
            return {"folders": folders, "files": files, "documents": documents}, {"alerts": self._alert([("folder-tree-updated", root, None)], now)}, {}

        return self._step(change)

    def remove(self, path: str, now: int) -> Report:
        """A path is gone from the disk: it and all below are missing."""

        def change(t):
            return {n: M.mark_missing(t[n], path, now) for n in ("folders", "files")}, {"alerts": self._alert([("folder-tree-updated", path, None)], now)}, {}

        return self._step(change)

    def rename(self, old: str, new: str, is_dir: bool, now: int) -> Report:
        def change(t):
            if not is_dir:
                files = M.rename_file(t["files"], old, new, now)
                return {"files": files, "folders": self._registered(t["folders"], files, now)}, {}, {}
            folders, files = M.rename_tree(t["folders"], t["files"], old, new, now)
            return {"folders": folders, "files": files}, {"alerts": self._alert([("folder-tree-updated", new, None)], now)}, {}

        return self._step(change)

    def set_visibility(self, root: str, public: bool, subfolders: bool, now: int) -> Report:
        return self._step(lambda t: ({"folders": M.set_visibility(t["folders"], root, public, subfolders, now)}, {}, {}))

    # Taking files in

    def _listed(self, roots: list[str]) -> tuple[DataFrame, DataFrame]:
        """Folders, and files that pass the filter, of trees on the disk."""
        found = materialize(listing.list_tree(self.spark, roots), "listing")
        name, folder = T.basename(F.col("path")), T.dirname(F.col("path"))
        # Folders of denied names were not entered, and what lies above a root isn't asked.
        return found.where("is_dir"), found.where(~F.col("is_dir") & filters.wanted_size(F.col("size")) & filters.wanted_name(name) & (folder != ""))

    @staticmethod
    def _registered(folders: DataFrame, files: DataFrame, now: int) -> DataFrame:
        """Folders with those that files lie in."""
        missing = files.select(F.col("folder_path").alias("path")).distinct().join(folders.select("path"), "path", "left_anti")
        return folders.unionByName(missing.select("path", F.lit("active").alias("status"), F.lit(now).cast("long").alias("updated_at"), F.lit(False).alias("is_public")))

    def _indexed(self, todo: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks (document_hash, chunk_index, content, embedding) of one file (path, hash) of each content, and the
        hashes that failed with their errors."""
        texts = office.extract_all(listing.read_contents(todo.select("path", F.lit(False).alias("is_dir"))), reader=self.pdf)
        texts = materialize(texts.join(todo, "path"), "texts")
        pieces = materialize(chunker.chunk(texts.where("text is not null"), "hash", "text", self.size, self.overlap).withColumn("key", F.struct("hash", "chunk_index")), "pieces")
        keyed = pieces.select(F.to_json("key").alias("key"), "hash", "chunk_index", "content")
        vectors = embed.embed(keyed, "key", "content", self.embedder)
        out = materialize(keyed.join(vectors, "key").select(F.col("hash").alias("document_hash"), "chunk_index", "content", "embedding", "error"), "embedded")
        errors = texts.where("error is not null").select("hash", "error").unionByName(out.where("error is not null").select(F.col("document_hash").alias("hash"), "error"))
        return out, errors.groupBy("hash").agg(F.min("error").alias("error"))

    def _take_in(self, t: dict[str, DataFrame], dirs: DataFrame, seen: DataFrame, now: int, notices: list[tuple[str, str, str | None]]):
        old = t["files"]
        looked = hashed(listing.read_contents(seen.select("path", F.lit(False).alias("is_dir"))))
        seen = seen.select("path", "size", "mtime", T.dirname(F.col("path")).alias("folder_path"), T.basename(F.col("path")).alias("file_name"))
        was = old.select("path", F.col("status").alias("was"), F.col("file_hash").alias("had"), F.col("size").alias("o_size"), F.col("last_modified").alias("o_time"))
        both = materialize(seen.join(looked, "path").join(was, "path", "left"), "seen")
        good = both.where("ok and hash is not null")
        same = good.where("had = hash and was <> 'missing'")
        back = good.where("had = hash and was = 'missing'")
        rest = good.join(same.select("path"), "path", "left_anti").join(back.select("path"), "path", "left_anti")
        claims = materialize(M.ghosts(old, rest.select("path", "size", "mtime", "hash")).withColumn("k", F.row_number().over(Window.partitionBy("ghost_id").orderBy("path"))).where("k = 1").select("path"), "claims")
        fresh = materialize(rest.join(claims, "path", "left_anti"), "fresh")
        # One file of each content that isn't indexed yet.
        heads = fresh.groupBy("hash").agg(F.min("path").alias("path")).join(t["documents"].select("hash"), "hash", "left_anti")
        chunks, errors = self._indexed(heads)
        errors = materialize(errors, "errors")
        failed = materialize(fresh.join(errors, "hash").select("path", "error"), "failed")
        fine = chunks.join(errors.select(F.col("hash").alias("document_hash")), "document_hash", "left_anti")

        files = M.refresh_metadata(old.drop("id"), same.select("path", "size", "mtime", "hash"), now)
        files = files.join(back.select("path", F.lit(True).alias("b")), "path", "left").withColumns({"status": F.when(F.col("b"), "active").otherwise(F.col("status")), "updated_at": F.when(F.col("b"), F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).drop("b")
        ids = old.select("path", "id")
        claimed = rest.join(claims, "path", "left_semi").select("path", "size", "mtime", "hash")
        files = M.claim_ghosts(files.join(ids, "path", "left"), claimed, now)
        # Tries are kept while a pending file is the same on the disk.
        tried = fresh.where("was = 'pending' and size = o_size and mtime = o_time")
        anew = fresh.join(tried.select("path"), "path", "left_anti")
        files = M.upsert_pending(files, anew.select("folder_path", "path", "file_name", "size", F.col("mtime").alias("last_modified")), now)
        done = fresh.join(failed, "path", "left_anti").select("path", "folder_path", "file_name", "size", F.col("mtime").alias("last_modified"), F.col("hash").alias("file_hash"))
        files, _ = M.upsert_active(files, done, now)
        files = M.record_failures(files, failed, now)
        files = materialize(files.join(ids, "path", "left"), "files")
        start = (old.agg(F.max("id")).first()[0] or 0) + 1
        spread = F.pmod(F.xxhash64("path"), F.lit(1024))
        files = files.where("id is not null").unionByName(numbered(files.where("id is null").drop("id").withColumn("blk", spread), "blk", ["path"], start).drop("blk"))
        files = materialize(files.select(*[f.split()[0] for f in SCHEMAS["files"].split(", ")]), "files")

        folders = M.upsert_folders(t["folders"], dirs.select("path"), now)
        folders = self._registered(folders, files, now)
        documents = t["documents"].unionByName(fine.select(F.col("document_hash").alias("hash")).distinct().withColumn("created_at", F.lit(now).cast("long")))
        left = old.select(F.col("file_hash").alias("hash")).where("hash is not null").distinct().join(files.select(F.col("file_hash").alias("hash")), "hash", "left_anti")
        documents = documents.join(left, "hash", "left_anti")
        top = (t["chunks"].agg(F.max("id")).first()[0] or 0) + 1
        chunks = materialize(numbered(fine.withColumn("blk", F.substring("document_hash", 1, 3)), "blk", ["document_hash", "chunk_index"], top), "chunks")
        rows = chunks.select("id", "document_hash", "chunk_index", "content")
        bad = both.where("not ok or hash is null").select(F.lit("file-rejected").alias("kind"), "path", F.lit(None).cast("string").alias("detail"))
        bad = bad.unionByName(failed.select(F.lit("file-error").alias("kind"), "path", F.col("error").alias("detail")))
        alerts = bad.select(F.lit(now).cast("long").alias("at"), "kind", "path", "detail").unionByName(self._alert(notices, now))
        kinds = {"seen": both, "same": same, "back": back, "claimed": claims, "indexed": done, "failed": failed, "chunks": chunks}
        counts = _counts(kinds)
        more = {"chunks": rows, "vec_chunks": chunks.select(F.col("id").alias("chunk_id"), "embedding"), "words": search.corpus_words(rows), "alerts": alerts}
        return {"folders": folders, "files": files, "documents": documents}, more, counts


def every(jobs: list[Callable[[int], object]], seconds: float = DAY, rounds: int | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run jobs(now) at once and then after each interval; the number of rounds made."""
    made = 0
    while rounds is None or made < rounds:
        if made:
            sleep(seconds)
        for job in jobs:
            job(int(clock()))
        made += 1
    return made
