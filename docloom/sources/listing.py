"""Listing of folder trees on a disk that all executors see, with names that Spark's own file sources hide."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.operators.filters import DENIED_FOLDERS
from docloom.runtime import materialize, ship_package

LISTING = "path string, size long, mtime long, is_dir boolean"


def _allowed(name: str) -> bool:
    low = name.lower()
    return low not in DENIED_FOLDERS and not low.startswith((".", "~$"))


def _scan(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return
    for e in entries:
        try:
            is_dir, info = e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False)
        except OSError:
            continue
        if not is_dir or _allowed(e.name):
            yield e.path, 0 if is_dir else info.st_size, int(info.st_mtime), is_dir


def _walk(deep: bool):
    """Folders to the entries in them, or with deep to all that are below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, todo = [], list(batch.column(0).to_pylist())
            while todo:
                for row in _scan(todo.pop()):
                    rows.append(row)
                    if deep and row[3]:
                        todo.append(row[0])
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    p, s, m, d = zip(*rows)
    return pa.record_batch([pa.array(p, pa.string()), pa.array(s, pa.int64()), pa.array(m, pa.int64()), pa.array(d, pa.bool_())], names=["path", "size", "mtime", "is_dir"])


def list_tree(spark: SparkSession, roots: list[str], spread: int = 64) -> DataFrame:
    """(path, size, mtime, is_dir) below the roots. Denied folders are not entered, unreadable ones are skipped; a denied
    root gives nothing. The first levels are listed one by one by tasks, until there are subtrees for `spread` of them;
    the driver sees only the roots and the number of folders of a level."""
    ship_package(spark)
    todo = [r.rstrip("/\\") or r for r in roots if os.path.isdir(r) and _allowed(os.path.basename(r.rstrip("/\\")) or r)]
    top = spark.createDataFrame([(r, 0, int(os.stat(r).st_mtime), True) for r in todo], LISTING)
    folders, n = top.select("path"), len(todo)
    for _ in range(3):
        if not n or n >= spread:
            break
        level = materialize(folders.repartition(min(spread, n)).mapInArrow(_walk(False), LISTING), "level")
        top, folders = top.unionByName(level), level.where("is_dir").select("path")
        n = folders.count()
    return top.unionByName(folders.repartition(min(spread, n)).mapInArrow(_walk(True), LISTING)) if n else top


def read_contents(listing: DataFrame, most: int = 104_857_600) -> DataFrame:
    """(path, content) of listed files; unreadable files, and those of more than `most` bytes, have null content."""
    ship_package(listing.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        data = f.read(most + 1)
                    data = data if len(data) <= most else None
                except OSError:
                    data = None
                yield pa.record_batch([pa.array([path], pa.string()), pa.array([data], pa.binary())], names=["path", "content"])

    return listing.where("not is_dir").select("path").mapInArrow(run, "path string, content binary")
