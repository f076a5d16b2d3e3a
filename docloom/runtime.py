"""Session helpers: tables, the shared work folder, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCOPES: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or on a single machine one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages start from files, not from lineage."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    place = _place(spark, path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    back = spark.read.schema(df.schema).parquet(path)
    back._docloom_path = path
    if _SCOPES:
        _SCOPES[-1].append(back)
    return back


def _place(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    place = _place(spark, path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df. Call it when everything made from df has itself been written."""
    if path := getattr(df, "_docloom_path", None):
        remove(df.sparkSession, path)
        df._docloom_path = None


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end, what materialize() wrote inside; for jobs that write their results themselves. Without it,
    intermediate folders go when the session's JVM ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            release(df)


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors of a cluster, whose Python may not have it on its path."""
    app = spark.sparkContext.applicationId
    if is_local(spark) or app in _SHIPPED:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    target = work_path(spark, "code") + "/docloom_code.zip"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
