"""Queries of file and folder state and of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import state as M
from docloom.plans.search_queries import CURRENT, files_now
from docloom.runtime import table
from docloom.streaming import events as E

NOW = 1_752_000_000
ROOT = "/home/desk12/papers/Recipes"


def _files(spark, sf):
    return files_now(spark, sf)


def _listing(files):
    """The disk after some changes: files lost, grown and moved."""
    moved = F.when(F.col("id") % 13 == 0, F.concat(F.lit("/moved"), F.col("path"))).otherwise(F.col("path"))
    kept = files.where((F.col("id") % 7 != 0) & F.col("path").isNotNull())
    grown = F.col("size") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)
    return kept.groupBy(moved.alias("path")).agg(F.max(grown).alias("size"), F.max("last_modified").alias("mtime"), F.max("file_hash").alias("hash"))


def _seen(files):
    some = files.where(F.col("id") % 5 == 0)
    return some.select("folder_path", F.when(F.col("id") % 2 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), "file_name", (F.col("size") + 1).alias("size"), (F.col("last_modified") + 1).alias("last_modified"))


def change_detect(spark, sf):
    f = _files(spark, sf)
    return M.changes(f, _listing(f))


def upsert_pending(spark, sf):
    f = _files(spark, sf)
    return M.upsert_pending(f, _seen(f), NOW)


def upsert_active_guarded(spark, sf):
    f = _files(spark, sf)
    return M.upsert_active(f, _seen(f).withColumn("file_hash", F.sha2("path", 256)), NOW)[0]


def refused_paths(spark, sf):
    """Paths whose chunks must be dropped, as someone else changed the file meanwhile."""
    f = _files(spark, sf)
    return M.upsert_active(f, _seen(f).withColumn("file_hash", F.sha2("path", 256)), NOW)[1]


def metadata_refresh(spark, sf):
    f = _files(spark, sf)
    return M.refresh_metadata(f, _listing(f), NOW)


def mark_missing(spark, sf):
    return M.mark_missing(_files(spark, sf), ROOT, NOW).select("id", "status", "updated_at")


def mark_missing_folders(spark, sf):
    return M.mark_missing(table(spark, sf, "folders"), ROOT, NOW).select("id", "status", "updated_at")


def rename_prefix(spark, sf):
    return M.rename_tree(table(spark, sf, "folders"), _files(spark, sf), ROOT, "/archive/r", NOW)[1].select("id", "path", "folder_path", "updated_at")


def rename_folders(spark, sf):
    return M.rename_tree(table(spark, sf, "folders"), _files(spark, sf), ROOT, "/archive/r", NOW)[0].select("id", "path", "status", "updated_at")


def rename_one_file(spark, sf):
    f = _files(spark, sf)
    return M.rename_file(f, f.agg(F.min("path")).first()[0] or "", "/archive/r/new name.txt", NOW).select("id", "path", "folder_path", "file_name", "status", "updated_at")


def _found(files):
    return files.where(F.col("status") == "missing").select(F.concat(F.lit("/back"), F.col("path")).alias("path"), "size", F.col("last_modified").alias("mtime"), F.col("file_hash").alias("hash"))


def ghost_match(spark, sf):
    f = _files(spark, sf)
    return M.ghosts(f, _found(f))


def claim_ghost(spark, sf):
    f = _files(spark, sf)
    return M.claim_ghosts(f, _found(f), NOW).select("path", "file_hash", "status")


def retry_select(spark, sf):
    return M.to_retry(_files(spark, sf)).select("id", "path")


def retry_transition(spark, sf):
    f = _files(spark, sf)
    return M.record_failures(f, f.where("status in ('pending', 'active')"), NOW).select("id", "status", "retry_count", "updated_at")


def gc_expired(spark, sf):
    return M.expire(_files(spark, sf), NOW).select("id")


def gc_folders(spark, sf):
    return M.expire(table(spark, sf, "folders"), NOW).select("id")


def orphan_documents(spark, sf):
    return M.orphan_documents(table(spark, sf, "documents"), _files(spark, sf)).select("hash")


def _cascaded(spark, sf):
    folders = table(spark, sf, "folders").where("status is null or status <> 'ignored'")
    return M.cascade(folders, _files(spark, sf), table(spark, sf, "documents"), table(spark, sf, "chunks"), table(spark, sf, "vec_chunks"))


def cascade_files(spark, sf):
    return _cascaded(spark, sf)[0].select("id")


def cascade_chunks(spark, sf):
    return _cascaded(spark, sf)[2].select("id").distinct()


def cascade_vectors(spark, sf):
    return _cascaded(spark, sf)[3].select("chunk_id").distinct()


def cascade_leaving(spark, sf):
    """Documents left when the files of ignored folders go: of those that had files before, the ones that still have some;
    documents that never had a file stay."""
    folders, before = table(spark, sf, "folders").where("status is null or status <> 'ignored'"), _files(spark, sf)
    return M.cascade(folders, before, table(spark, sf, "documents"), table(spark, sf, "chunks"), table(spark, sf, "vec_chunks"), before)[1].select("hash")


def folder_upsert(spark, sf):
    f = table(spark, sf, "folders")
    seen = f.where("id % 3 = 0").select("path").unionByName(f.where("id % 4 = 0").select(F.concat("path", F.lit("/sub")).alias("path")))
    return M.upsert_folders(f, seen, NOW)


def folder_visibility(spark, sf):
    return M.set_visibility(table(spark, sf, "folders"), ROOT, True, True, NOW).select("id", "is_public", "updated_at")


def folder_unwatch(spark, sf):
    return M.unwatch(table(spark, sf, "folders"), _files(spark, sf), ROOT, NOW)[0].select("id", "status", "updated_at")


def unwatched_files(spark, sf):
    return M.unwatch(table(spark, sf, "folders"), _files(spark, sf), ROOT, NOW)[1].select("id")


def directory_state(spark, sf):
    f = table(spark, sf, "folders")
    return M.directory_states(f.select("path", (F.col("id") % 9 != 0).alias("is_dir")), f)


def file_info(spark, sf):
    f = _files(spark, sf)
    path = f.agg(F.min("path")).first()[0] or ""
    return M.file_info(f, path)


def existence_sweep(spark, sf):
    f = _files(spark, sf)
    return M.sweep(f, _listing(f), NOW).select("id", "status")


def boot_sync_reconcile(spark, sf):
    f = _files(spark, sf)
    return M.reconcile(_listing(f), f, table(spark, sf, "folders"))


def vanished_folders(spark, sf):
    f = table(spark, sf, "folders")
    return M.vanished_ignored(f, f.where("id % 2 = 0").select("path")).select("id")


def debounce_sessions(spark, sf):
    return E.debounce(E.file_events(table(spark, sf, "events")), "1 hour")


def debounce_two_seconds(spark, sf):
    return E.debounce(E.file_events(table(spark, sf, "events")), "2 seconds")


def event_route(spark, sf):
    return E.route(E.moving_events(table(spark, sf, "events"))).select("event_id", "path", "action")


QUERIES = {
    f.__name__: f
    for f in (
        change_detect, upsert_pending, upsert_active_guarded, refused_paths, metadata_refresh, mark_missing, mark_missing_folders, rename_prefix, rename_folders, rename_one_file, ghost_match, claim_ghost, retry_select, retry_transition, gc_expired, gc_folders,
        orphan_documents, cascade_files, cascade_chunks, cascade_vectors, cascade_leaving, folder_upsert, folder_visibility, folder_unwatch, unwatched_files, directory_state, file_info, existence_sweep,
        boot_sync_reconcile, vanished_folders, debounce_sessions, debounce_two_seconds, event_route,
    )
}

_LIST = f"{CURRENT}, disk AS (SELECT CASE WHEN id % 13 = 0 THEN '/moved' || path ELSE path END AS path, max(size + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END) AS size, max(last_modified) AS mtime, max(file_hash) AS hash FROM cur WHERE id % 7 <> 0 AND path IS NOT NULL GROUP BY 1)"
_SEEN = f"{CURRENT}, seen AS (SELECT folder_path, CASE WHEN id % 2 = 0 THEN path || '.new' ELSE path END AS path, file_name, size + 1 AS size, last_modified + 1 AS last_modified FROM cur WHERE id % 5 = 0)"
_UNDER = f"({{c}} = '{ROOT}' OR starts_with({{c}}, '{ROOT}/'))"
_BACK = f"{CURRENT}, found AS (SELECT '/back' || path AS path, size, last_modified AS mtime, file_hash AS hash FROM cur WHERE status = 'missing'), ghost AS (SELECT f.path, min(c.id) AS ghost_id FROM found f JOIN cur c ON c.status = 'missing' AND c.size = f.size AND c.last_modified = f.mtime AND c.file_hash = f.hash GROUP BY f.path)"
_CASC = f"{CURRENT}, fo AS (SELECT path FROM folders WHERE status IS NULL OR status <> 'ignored'), fi AS (SELECT * FROM cur WHERE folder_path IN (SELECT path FROM fo)), dk AS (SELECT hash FROM documents WHERE hash IN (SELECT file_hash FROM fi WHERE file_hash IS NOT NULL)), ck AS (SELECT DISTINCT id FROM chunks WHERE document_hash IN (SELECT hash FROM dk))"
_EV = "ev AS (SELECT event_id, ts, '/u' || user_id || '/f' AS path, CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'write' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'rename' END AS op, event_id % 10 = 0 AS is_dir FROM events)"
_DEB = "WITH {ev}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {gap} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts) AS k FROM m) SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY path, k"
ORACLE = {
    "change_detect": f"WITH {_LIST} SELECT d.path, CASE WHEN c.id IS NULL THEN 'new' WHEN d.size IS NOT DISTINCT FROM c.size AND d.mtime IS NOT DISTINCT FROM c.last_modified THEN 'same' ELSE 'changed' END AS change FROM disk d LEFT JOIN cur c ON c.path = d.path",
    "upsert_pending": f"WITH {_SEEN} SELECT coalesce(c.folder_path, s.folder_path) AS folder_path, coalesce(c.path, s.path) AS path, coalesce(c.file_name, s.file_name) AS file_name, CASE WHEN s.path IS NULL THEN c.file_hash END AS file_hash, coalesce(s.size, c.size) AS size, coalesce(s.last_modified, c.last_modified) AS last_modified, CASE WHEN s.path IS NULL THEN c.status ELSE 'pending' END AS status, CASE WHEN s.path IS NULL THEN c.retry_count ELSE 0 END AS retry_count, CASE WHEN s.path IS NULL THEN c.updated_at ELSE {NOW} END AS updated_at FROM cur c FULL JOIN seen s ON s.path = c.path",
    "upsert_active_guarded": f"WITH {_SEEN}, b AS (SELECT c.*, s.path AS sp, s.folder_path AS sf, s.file_name AS sn, s.size AS ss, s.last_modified AS sl, s.path IS NOT NULL AND (c.id IS NULL OR coalesce(c.status = 'pending', false)) AS ok FROM cur c FULL JOIN seen s ON s.path = c.path) SELECT CASE WHEN id IS NULL THEN sf ELSE folder_path END AS folder_path, coalesce(path, sp) AS path, CASE WHEN id IS NULL THEN sn ELSE file_name END AS file_name, CASE WHEN ok THEN sha256(sp) ELSE file_hash END AS file_hash, CASE WHEN ok THEN ss ELSE size END AS size, CASE WHEN ok THEN sl ELSE last_modified END AS last_modified, CASE WHEN ok THEN 'active' ELSE status END AS status, CASE WHEN id IS NULL THEN 0 ELSE retry_count END AS retry_count, CASE WHEN ok THEN {NOW} ELSE updated_at END AS updated_at FROM b",
    "refused_paths": f"WITH {_SEEN} SELECT s.path FROM seen s JOIN cur c ON c.path = s.path WHERE c.status IS DISTINCT FROM 'pending'",
    "metadata_refresh": f"WITH {_LIST}, b AS (SELECT c.*, d.size AS ns, d.mtime AS nt, coalesce(d.hash = c.file_hash AND c.status IS DISTINCT FROM 'missing', false) AS hit FROM cur c LEFT JOIN disk d ON d.path = c.path) SELECT folder_path, path, file_name, file_hash, CASE WHEN hit THEN ns ELSE size END AS size, CASE WHEN hit THEN nt ELSE last_modified END AS last_modified, status, retry_count, CASE WHEN hit THEN {NOW} ELSE updated_at END AS updated_at FROM b",
    "mark_missing": f"WITH {CURRENT} SELECT id, CASE WHEN {_UNDER.format(c='path')} THEN 'missing' ELSE status END AS status, CASE WHEN {_UNDER.format(c='path')} THEN {NOW} ELSE updated_at END AS updated_at FROM cur",
    "rename_prefix": f"WITH {CURRENT} SELECT id, CASE WHEN {_UNDER.format(c='path')} THEN '/archive/r' || substring(path, {len(ROOT) + 1}) ELSE path END AS path, CASE WHEN {_UNDER.format(c='folder_path')} THEN '/archive/r' || substring(folder_path, {len(ROOT) + 1}) ELSE folder_path END AS folder_path, CASE WHEN {_UNDER.format(c='path')} THEN {NOW} ELSE updated_at END AS updated_at FROM cur",
    "rename_folders": f"SELECT id, CASE WHEN {_UNDER.format(c='path')} THEN '/archive/r' || substring(path, {len(ROOT) + 1}) ELSE path END AS path, CASE WHEN {_UNDER.format(c='path')} THEN 'active' ELSE status END AS status, CASE WHEN {_UNDER.format(c='path')} THEN {NOW} ELSE updated_at END AS updated_at FROM folders",
    "rename_one_file": f"WITH {CURRENT}, h AS (SELECT *, coalesce(path = (SELECT min(path) FROM cur), false) AS hit FROM cur) SELECT id, CASE WHEN hit THEN '/archive/r/new name.txt' ELSE path END AS path, CASE WHEN hit THEN '/archive/r' ELSE folder_path END AS folder_path, CASE WHEN hit THEN 'new name.txt' ELSE file_name END AS file_name, status, CASE WHEN hit THEN {NOW} ELSE updated_at END AS updated_at FROM h",
    "mark_missing_folders": f"SELECT id, CASE WHEN {_UNDER.format(c='path')} THEN 'missing' ELSE status END AS status, CASE WHEN {_UNDER.format(c='path')} THEN {NOW} ELSE updated_at END AS updated_at FROM folders",
    "ghost_match": f"WITH {_BACK} SELECT path, ghost_id FROM ghost",
    "claim_ghost": f"WITH {_BACK}, one AS (SELECT ghost_id, min(path) AS path FROM ghost GROUP BY ghost_id) SELECT path, file_hash, status FROM cur WHERE id NOT IN (SELECT ghost_id FROM one) AND path NOT IN (SELECT path FROM one) UNION ALL SELECT f.path, f.hash, 'active' FROM found f JOIN one o ON o.path = f.path",
    "retry_select": f"WITH {CURRENT} SELECT id, path FROM cur WHERE status = 'pending' AND retry_count > 0 AND retry_count < 3",
    "retry_transition": f"WITH {CURRENT} SELECT id, CASE WHEN status NOT IN ('pending', 'active') OR status IS NULL THEN status WHEN retry_count >= 2 THEN 'failed' ELSE 'pending' END AS status, coalesce(retry_count, 0) + CASE WHEN status IN ('pending', 'active') THEN 1 ELSE 0 END AS retry_count, CASE WHEN status IN ('pending', 'active') THEN {NOW} ELSE updated_at END AS updated_at FROM cur",
    "gc_expired": f"WITH {CURRENT} SELECT id FROM cur WHERE NOT coalesce(status = 'missing' AND updated_at <= {NOW} - 604800, false)",
    "gc_folders": f"SELECT id FROM folders WHERE NOT coalesce(status = 'missing' AND updated_at <= {NOW} - 604800, false)",
    "orphan_documents": f"WITH {CURRENT} SELECT hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM cur WHERE file_hash = d.hash)",
    "cascade_files": f"WITH {_CASC} SELECT id FROM fi",
    "cascade_chunks": f"WITH {_CASC} SELECT id FROM ck",
    "cascade_vectors": f"WITH {_CASC} SELECT DISTINCT chunk_id FROM vec_chunks WHERE chunk_id IN (SELECT id FROM ck)",
    "cascade_leaving": f"WITH {_CASC} SELECT hash FROM documents WHERE hash NOT IN (SELECT file_hash FROM cur WHERE file_hash IS NOT NULL) OR hash IN (SELECT file_hash FROM fi WHERE file_hash IS NOT NULL)",
    "folder_upsert": f"WITH seen AS (SELECT path FROM folders WHERE id % 3 = 0 UNION SELECT path || '/sub' FROM folders WHERE id % 4 = 0) SELECT coalesce(f.path, s.path) AS path, CASE WHEN s.path IS NULL THEN status ELSE 'active' END AS status, CASE WHEN s.path IS NULL THEN updated_at ELSE {NOW} END AS updated_at, coalesce(is_public, false) AS is_public FROM folders f FULL JOIN seen s ON s.path = f.path",
    "folder_visibility": f"SELECT id, CASE WHEN {_UNDER.format(c='path')} THEN true ELSE is_public END AS is_public, CASE WHEN {_UNDER.format(c='path')} THEN {NOW} ELSE updated_at END AS updated_at FROM folders",
    "folder_unwatch": f"SELECT id, CASE WHEN {_UNDER.format(c='path')} THEN 'ignored' ELSE status END AS status, CASE WHEN {_UNDER.format(c='path')} THEN {NOW} ELSE updated_at END AS updated_at FROM folders",
    "unwatched_files": f"WITH {CURRENT} SELECT id FROM cur WHERE NOT coalesce({_UNDER.format(c='folder_path')}, false)",
    "directory_state": "SELECT path, id % 9 <> 0 AS is_valid, coalesce(id % 9 <> 0 AND status = 'active', false) AS is_watched, coalesce(id % 9 <> 0 AND status = 'active' AND is_public, false) AS is_public, coalesce(id % 9 <> 0 AND status = 'ignored', false) AS is_ignored FROM folders",
    "file_info": f"WITH {CURRENT} SELECT file_name, path, size, status, updated_at FROM cur WHERE path = (SELECT min(path) FROM cur)",
    "existence_sweep": f"WITH {_LIST} SELECT id, CASE WHEN path NOT IN (SELECT path FROM disk) THEN 'missing' ELSE status END AS status FROM cur",
    "boot_sync_reconcile": f"WITH {_LIST}, ok AS (SELECT * FROM disk d WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE f.status = 'ignored' AND (d.path = f.path OR starts_with(d.path, f.path || '/') OR starts_with(d.path, f.path || chr(92))))) SELECT d.path, CASE WHEN c.id IS NULL THEN 'new' ELSE 'changed' END AS change FROM ok d LEFT JOIN cur c ON c.path = d.path WHERE c.id IS NULL OR d.size IS DISTINCT FROM c.size OR d.mtime IS DISTINCT FROM c.last_modified",
    "vanished_folders": "SELECT id FROM folders WHERE NOT coalesce(status = 'ignored' AND id % 2 <> 0, false)",
    "debounce_sessions": _DEB.format(ev=_EV, gap="1 HOUR"),
    "debounce_two_seconds": _DEB.format(ev=_EV, gap="2 SECONDS"),
    "event_route": f"WITH {_EV}, mv AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN path || '/Node_Modules' ELSE path END AS path, op, is_dir AND event_id % 7 <> 0 AS enter, event_id % 3 = 0 AS moved FROM ev) SELECT event_id, path, CASE WHEN enter AND op = 'create' THEN 'scan' WHEN enter AND op = 'write' THEN 'drop' WHEN op = 'create' AND moved THEN 'rename' WHEN op IN ('create', 'write') THEN 'debounce' ELSE 'soft_delete' END AS action FROM mv",
}
