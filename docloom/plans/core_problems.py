"""Queries of the general problems: changed records (p1) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.incremental import ChangeState, current_rows
from docloom.operators.orphans import Reference, orphans
from docloom.runtime import materialize, table, work_path

TAKEN = ["last_modified", "updated_at", "status"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that the next run must take up. The state is what the successful runs have recorded."""
    state = ChangeState(spark, work_path(spark, "sync-state"))
    ok = table(spark, sf, "sync_runs").where("outcome = 'ok'").select("run_id").distinct()
    done = table(spark, sf, "sync_items").where("result = 'done'").select("run_id", "file_id", *TAKEN).join(ok, "run_id", "left_semi")
    state.commit(done.withColumnRenamed("file_id", "id"), "id", TAKEN)
    files = current_rows(table(spark, sf, "files").select("id", "loaded_at", *TAKEN), "id", "updated_at", "loaded_at")
    return state.changed(files, "id", TAKEN).select(F.col("id").alias("file_id"))


def _first_rows(df: DataFrame, row_id: str, field: str) -> DataFrame:
    """The earliest row of each id."""
    picked = df.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("row_id")).agg(F.min(F.struct(F.col("loaded_at").isNull().alias("n"), "loaded_at", F.col(field).alias("v"))).alias("m"))
    return picked.select("row_id", F.col("m.v").alias(field), F.col("m.loaded_at").alias("loaded_at"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references of files, chunks and vectors."""
    files = current_rows(table(spark, sf, "files").select("id", "updated_at", "loaded_at", "file_hash", "folder_path"), "id", "updated_at", "loaded_at")
    files = materialize(files.select("id", "loaded_at", "file_hash", "folder_path"), "current")
    documents, chunks = table(spark, sf, "documents").select("hash"), table(spark, sf, "chunks")
    vectors = table(spark, sf, "vec_chunks").select("chunk_id", "loaded_at").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("loaded_at").alias("loaded_at"))
    references = [
        Reference("files", "file_hash", files, documents, "hash"),
        Reference("files", "folder_path", files, table(spark, sf, "folders").select("path"), "path"),
        Reference("chunks", "document_hash", materialize(_first_rows(chunks, "id", "document_hash"), "first"), documents, "hash"),
        Reference("vec_chunks", "chunk_id", materialize(vectors, "vectors"), chunks.select("id"), "id"),
    ]
    return orphans(references, ["id", "id", "row_id", "chunk_id"], ["loaded_at"] * 4)


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans counted per table, field and month."""
    return p6_found(spark, sf).groupBy("tbl", "field", "period").agg(F.count("*").alias("orphans"))


QUERIES = {"p1_found": p1_found, "p6_found": p6_found, "p6_report": p6_report}

_CURRENT = """current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at) AS k FROM files WHERE id IS NOT NULL) WHERE k = 1)"""
_FOUND6 = f"""WITH {_CURRENT},
c AS (SELECT id, arg_min(document_hash, loaded_at) AS document_hash, min(loaded_at) AS loaded_at FROM chunks GROUP BY id),
v AS (SELECT chunk_id, min(loaded_at) AS loaded_at FROM vec_chunks GROUP BY chunk_id),
found AS (
SELECT 'files' AS tbl, 'file_hash' AS field, id AS row_id, strftime(loaded_at, '%Y-%m') AS period FROM current WHERE file_hash IS NOT NULL AND file_hash NOT IN (SELECT hash FROM documents WHERE hash IS NOT NULL)
UNION ALL SELECT 'files', 'folder_path', id, strftime(loaded_at, '%Y-%m') FROM current WHERE folder_path IS NOT NULL AND folder_path NOT IN (SELECT path FROM folders WHERE path IS NOT NULL)
UNION ALL SELECT 'chunks', 'document_hash', id, strftime(loaded_at, '%Y-%m') FROM c WHERE document_hash IS NOT NULL AND document_hash NOT IN (SELECT hash FROM documents WHERE hash IS NOT NULL)
UNION ALL SELECT 'vec_chunks', 'chunk_id', chunk_id, strftime(loaded_at, '%Y-%m') FROM v WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL))"""
ORACLE = {
    "p1_found": f"""WITH {_CURRENT}
SELECT id AS file_id FROM current c WHERE NOT EXISTS (SELECT 1 FROM sync_items s JOIN sync_runs r ON r.run_id = s.run_id AND r.outcome = 'ok'
WHERE s.result = 'done' AND s.file_id = c.id AND s.last_modified IS NOT DISTINCT FROM c.last_modified AND s.updated_at IS NOT DISTINCT FROM c.updated_at AND s.status IS NOT DISTINCT FROM c.status)""",
    "p6_found": _FOUND6 + " SELECT * FROM found",
    "p6_report": _FOUND6 + " SELECT tbl, field, period, count(*) AS orphans FROM found GROUP BY ALL",
}
