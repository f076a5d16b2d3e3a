"""File and folder state as transforms of snapshots: each takes DataFrames and the time, and gives new DataFrames.

Paths are unique keys; rows of null path are left alone. A null status is neither pending nor missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

RETENTION = 7 * 24 * 3600
RETRIES = 3
FILE = ["folder_path", "path", "file_name", "file_hash", "size", "last_modified", "status", "retry_count", "updated_at"]


def _missing() -> Column:
    return F.coalesce(F.col("status") == "missing", F.lit(False))


def upsert_pending(files: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Files seen new or changed (folder_path, path, file_name, size, last_modified) become pending, without hash and retries."""
    new = seen.select("path", *[F.col(c).alias(f"n_{c}") for c in ("folder_path", "file_name", "size", "last_modified")], F.lit(True).alias("hit"))
    both = files.select(*FILE).join(new, "path", "full")
    hit = F.coalesce("hit", F.lit(False))
    take = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c)
    return both.select(
        F.coalesce("folder_path", "n_folder_path").alias("folder_path"), "path", F.coalesce("file_name", "n_file_name").alias("file_name"),
        F.when(hit, F.lit(None).cast("string")).otherwise(F.col("file_hash")).alias("file_hash"), take("size"), take("last_modified"),
        F.when(hit, "pending").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_active(files: DataFrame, done: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Vectorised files (path, folder_path, file_name, size, last_modified, file_hash) become active if they are still
    pending or new; a pending row keeps its folder, name and retries. Also the refused paths, whose chunks must be dropped."""
    new = done.select("path", *[F.col(c).alias(f"n_{c}") for c in ("folder_path", "file_name", "file_hash", "size", "last_modified")], F.lit(True).alias("hit"))
    both = files.select(*FILE, F.lit(True).alias("known")).join(new, "path", "full")
    fresh = F.col("known").isNull()
    ok = F.coalesce("hit", F.lit(False)) & (fresh | F.coalesce(F.col("status") == "pending", F.lit(False)))
    pick = lambda c: F.when(ok, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    first = lambda c, v: F.when(fresh, v).otherwise(F.col(c)).alias(c)
    out = both.select(
        first("folder_path", F.col("n_folder_path")), "path", first("file_name", F.col("n_file_name")), pick("file_hash"), pick("size"), pick("last_modified"), F.when(ok, "active").otherwise(F.col("status")).alias("status"),
        first("retry_count", F.lit(0)), F.when(ok, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return out, both.where(F.col("hit") & ~ok).select("path")


def changes(files: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, change) of the listing: new, changed (size or time), or same."""
    old = files.select("path", F.col("size").alias("o_size"), F.col("last_modified").alias("o_time"), F.lit(True).alias("known"))
    same = F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime").eqNullSafe(F.col("o_time"))
    return listing.join(old, "path", "left").select("path", F.when(F.col("known").isNull(), "new").when(same, "same").otherwise("changed").alias("change"))


def refresh_metadata(files: DataFrame, listing: DataFrame, now: int) -> DataFrame:
    """Size and time of files whose content is the same and that aren't missing."""
    new = listing.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_time"), F.col("hash").alias("n_hash"))
    both = files.select(*FILE).join(new, "path", "left")
    hit = F.coalesce(F.col("n_hash") == F.col("file_hash"), F.lit(False)) & ~_missing()
    pick = lambda c, n: F.when(hit, F.col(n)).otherwise(F.col(c)).alias(c)
    return both.select("folder_path", "path", "file_name", "file_hash", pick("size", "n_size"), pick("last_modified", "n_time"), "status", "retry_count", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"))


def mark_missing(rows: DataFrame, root: str, now: int) -> DataFrame:
    """Files, or folders, at or below a path that is gone."""
    hit = F.coalesce(T.under(F.col("path"), root), F.lit(False))
    return rows.withColumns({"status": F.when(hit, "missing").otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})


def rename_file(files: DataFrame, old: str, new: str, now: int) -> DataFrame:
    """One file under a new path: path, name and folder follow, the content and status stay."""
    hit = F.coalesce(F.col("path") == old, F.lit(False))
    to = F.lit(new)
    change = {"path": to, "file_name": T.basename(to), "folder_path": T.dirname(to), "updated_at": F.lit(now).cast("long")}
    return files.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in change.items()})


def rename_tree(folders: DataFrame, files: DataFrame, old: str, new: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Folders and files of a moved tree: paths (of files, folder paths too) are rewritten, the folders are active again."""
    moved = F.coalesce(T.under(F.col("path"), old), F.lit(False))
    stamp = F.when(moved, F.lit(now).cast("long")).otherwise(F.col("updated_at"))
    path = F.when(moved, T.moved(F.col("path"), old, new)).otherwise(F.col("path"))
    home = F.when(T.under(F.col("folder_path"), old), T.moved(F.col("folder_path"), old, new)).otherwise(F.col("folder_path"))
    dirs = folders.withColumns({"path": path, "status": F.when(moved, "active").otherwise(F.col("status")), "updated_at": stamp})
    return dirs, files.withColumns({"path": path, "folder_path": home, "updated_at": stamp})


def ghosts(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, ghost_id): for each found file (path, size, mtime, hash), the first missing one of that size, time and content."""
    lost = files.where(_missing()).select(F.col("id").alias("ghost_id"), "size", F.col("last_modified").alias("mtime"), F.col("file_hash").alias("hash"))
    return found.join(lost, ["size", "mtime", "hash"]).groupBy("path").agg(F.min("ghost_id").alias("ghost_id"))


def claim_ghosts(files: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Found files take the place of their ghosts: the ghost rows go, active rows with the content's hash come."""
    match = ghosts(files, found)
    match = match.withColumn("k", F.row_number().over(Window.partitionBy("ghost_id").orderBy("path"))).where("k = 1").drop("k")
    kept = files.join(match.select(F.col("ghost_id").alias("id")), "id", "left_anti").join(match.select("path"), "path", "left_anti")
    new = found.join(match, "path").select(
        T.dirname(F.col("path")).alias("folder_path"), "path", T.basename(F.col("path")).alias("file_name"), F.col("hash").alias("file_hash"), "size", F.col("mtime").alias("last_modified"),
        F.lit("active").alias("status"), F.lit(0).alias("retry_count"), F.lit(now).cast("long").alias("updated_at"),
    )
    return kept.select(*FILE).unionByName(new)


def record_failures(files: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """One more try of the failed paths: given up when two were counted before, else pending, whatever they were."""
    hit = F.col("hit").isNotNull()
    out = files.join(failed.select("path", F.lit(1).alias("hit")).distinct(), "path", "left")
    status = F.when(hit & (F.coalesce("retry_count", F.lit(0)) >= RETRIES - 1), "failed").when(hit, "pending").otherwise(F.col("status"))
    return out.withColumns({"status": status, "retry_count": F.coalesce("retry_count", F.lit(0)) + hit.cast("int"), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).drop("hit")


def to_retry(files: DataFrame) -> DataFrame:
    return files.where((F.col("status") == "pending") & (F.col("retry_count") > 0) & (F.col("retry_count") < RETRIES))


def expire(rows: DataFrame, now: int, keep: int = RETENTION) -> DataFrame:
    """Without what has been missing for the whole retention time."""
    return rows.where(~(_missing() & F.coalesce(F.col("updated_at") <= now - keep, F.lit(False))))


def orphan_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    return documents.join(files.select(F.col("file_hash").alias("hash")), "hash", "left_anti")


def cascade(folders: DataFrame, files: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, before: DataFrame | None = None):
    """What remains of files, documents, chunks and vectors, top down. before: the files before the change; only
    documents that they had and no file has any more go, others stay."""
    files = files.join(folders.select(F.col("path").alias("folder_path")), "folder_path", "left_semi")
    gone = documents.select("hash")
    if before is not None:
        gone = before.where("file_hash is not null").select(F.col("file_hash").alias("hash")).distinct()
    gone = gone.join(files.select(F.col("file_hash").alias("hash")), "hash", "left_anti")
    documents = documents.join(gone, "hash", "left_anti")
    chunks = chunks.join(documents.select(F.col("hash").alias("document_hash")), "document_hash", "left_semi")
    vectors = vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return files, documents, chunks, vectors


def upsert_folders(folders: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Seen folders (path) are active."""
    both = folders.join(seen.select("path", F.lit(1).alias("hit")).distinct(), "path", "full")
    hit = F.col("hit").isNotNull()
    return both.select("path", F.when(hit, "active").otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"), F.coalesce("is_public", F.lit(False)).alias("is_public"))


def set_visibility(folders: DataFrame, root: str, public: bool, subfolders: bool, now: int) -> DataFrame:
    hit = T.under(F.col("path"), root) if subfolders else F.col("path") == root
    return folders.withColumns({"is_public": F.when(hit, F.lit(public)).otherwise(F.col("is_public")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})


def unwatch(folders: DataFrame, files: DataFrame, root: str, now: int) -> tuple[DataFrame, DataFrame]:
    """A tree is ignored from now on: its folders are marked, the files of its folders go."""
    hit = F.coalesce(T.under(F.col("path"), root), F.lit(False))
    marked = folders.withColumns({"status": F.when(hit, "ignored").otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})
    return marked, files.where(~F.coalesce(T.under(F.col("folder_path"), root), F.lit(False)))


def directory_states(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, is_valid, is_watched, is_public, is_ignored) of paths with is_dir."""
    both = paths.join(folders.select("path", "status", F.col("is_public").alias("pub")), "path", "left")
    yes = lambda c: F.coalesce(F.col("is_dir") & c, F.lit(False))
    active = F.col("status") == "active"
    return both.select("path", yes(F.lit(True)).alias("is_valid"), yes(active).alias("is_watched"), yes(active & F.col("pub")).alias("is_public"), yes(F.col("status") == "ignored").alias("is_ignored"))


def file_info(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("file_name", "path", "size", "status", "updated_at")


def sweep(files: DataFrame, listing: DataFrame, now: int) -> DataFrame:
    """Files that the disk no longer has become missing."""
    gone = files.join(listing.select("path").distinct().withColumn("there", F.lit(1)), "path", "left")
    hit = F.col("there").isNull() & ~_missing()
    return gone.withColumns({"status": F.when(hit, "missing").otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).drop("there")


def reconcile(listing: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """What a boot scan hands on: new and changed files outside ignored trees. A file's ancestors meet the ignored
    folders as equal keys, so no pair of path and folder is compared by prefix."""
    parts = F.split(F.col("path"), r"(?=[/\\])")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ""))
    above = listing.select("path", F.explode(up).alias("folder"))
    ignored = folders.where("status = 'ignored'").select(F.col("path").alias("folder"))
    hidden = above.join(ignored, "folder", "left_semi").select("path").distinct()
    return changes(files, listing.join(hidden, "path", "left_anti")).where("change <> 'same'")


def vanished_ignored(folders: DataFrame, listing: DataFrame) -> DataFrame:
    """Folders without the ignored ones that the disk no longer has."""
    there = listing.select("path").distinct().withColumn("there", F.lit(1))
    both = folders.join(there, "path", "left")
    return both.where(~(F.coalesce(F.col("status") == "ignored", F.lit(False)) & F.col("there").isNull())).drop("there")
