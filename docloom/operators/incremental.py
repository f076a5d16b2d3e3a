"""Processing only new or changed records.

The state is the set of (key, content hash) that successful runs have taken up, kept as segments in the shared folder
and named by numbered manifests. A run hashes the current rows, takes those whose (key, hash) the state doesn't hold,
and on success adds them as a segment. Version n is the file manifest-n, which appears whole and only once: of several
writers that saw version n-1, the first to put it there wins, and the others fail and change nothing. Segments are
merged by levels, so a record is rewritten as often as there are levels.

run() makes this exactly once for work that can be repeated by number: what a run takes is written down before the work
starts, and that the work is done before the commit. A run that died is resumed with the same rows and number.

Defined results
* Null equals null in the hashed fields; rows without key are left out.
* Rows of one key count as one, the current row: the greatest version (null is least), then the earliest arrival
  (null is last), then the least values.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import remove

STATE = "k string, h string"
#: Segments of one level that a commit merges into one of the next.
FAN = 8
#: Versions for which readers of an old manifest still find its files.
KEPT = 4


def content_hash(*fields: str | Column) -> Column:
    """Digest of the fields, nulls told apart from every value and field borders from every content."""
    cols = [F.col(f) if isinstance(f, str) else f for f in fields]
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols])), 256)


def current_rows(rows: DataFrame, key: str, version: str, arrived: str) -> DataFrame:
    """The current row of each key: the greatest struct, aggregated before and after the shuffle."""
    rest = [c for c in rows.columns if c not in (key, version, arrived)]
    late = -F.unix_micros(F.col(arrived).cast("timestamp"))
    order = F.struct(F.col(version).isNotNull().alias("a"), F.col(version).alias("b"), late.isNotNull().alias("c"), late.alias("d"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order.alias("o"), F.col(arrived).alias("at"))).alias("m"))
    return best.select(key, F.col("m.o.b").alias(version), F.col("m.at").alias(arrived), *[F.col(f"m.o.r{i}").alias(c) for i, c in enumerate(rest)])


class Conflict(RuntimeError):
    """Another writer was first; nothing of this one's is in force."""


class Manifests:
    """Numbered versions in one folder of the shared store, each published whole and once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._at(".")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at("."))]
        return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)", n) for n in names) if m)

    def current(self) -> dict:
        """The version in force; number 0 is the empty one."""
        there = self.versions()
        return json.loads(self.read_text(f"manifest-{there[-1]}")) if there else {"version": 0}

    def read_text(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._at(name))

    def create(self, name: str, text: str) -> bool:
        """Put a whole file in place, unless one of that name is there: False then."""
        temporary, fs = self._at(f".new-{uuid.uuid4().hex}"), self._fs()
        fs.mkdirs(self._at("."))
        stream = fs.create(temporary, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:
            if fs.getScheme() == "file":
                # A link fails if the name is taken; renaming on a local disk would replace it.
                os.link(temporary.toUri().getPath(), self._at(name).toUri().getPath())
                return True
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
            context.rename(temporary, self._at(name), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception:
            if fs.exists(self._at(name)):
                return False
            raise
        finally:
            fs.delete(temporary, False)

    def publish(self, manifest: dict) -> None:
        """Make a version the one in force; Conflict if its number is taken. Old versions and what they alone used go."""
        version = manifest["version"]
        waste = dict(manifest.get("waste", {}))
        late = [name for name, dropped in waste.items() if dropped <= version - KEPT]
        manifest = manifest | {"waste": {k: v for k, v in waste.items() if k not in late}}
        if version in self.versions() or not self.create(f"manifest-{version}", json.dumps(manifest)):
            raise Conflict("another writer committed meanwhile; take the changes anew")
        for name in [*late, *(f"manifest-{v}" for v in self.versions() if v <= version - KEPT)]:
            remove(self.spark, f"{self.path}/{name}")


class ChangeState:
    """(key, hash) of all records that successful runs took up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def manifest(self) -> dict:
        """The version in force: its number and segments."""
        return {"segments": []} | self.manifests.current()

    def seen(self, segments: list[str] | None = None) -> DataFrame:
        segments = self.manifest()["segments"] if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.path}/{s}" for s in segments])

    @staticmethod
    def marked(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
        return rows.withColumns({"__k": F.col(key).cast("string"), "__h": content_hash(*fields)}).where("__k is not null")

    def changed(self, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
        """The rows whose content no successful run has taken up."""
        marked, seen = self.marked(rows, key, fields), self.seen()
        return marked.join(seen, (F.col("__k") == seen.k) & (F.col("__h") == seen.h), "left_anti").drop("__k", "__h")

    def commit(self, taken: DataFrame, key: str, fields: list[str], after: int | None = None) -> int:
        """Make the rows of a successful run part of the state; the new version's number. after: the version that the
        rows were taken from, if another may have come since (Conflict then)."""
        old = self.manifest()
        if after is not None and old["version"] != after:
            raise Conflict(f"version {after} is no longer in force")
        number, segments, waste = old["version"] + 1, list(old["segments"]), dict(old.get("waste", {}))
        add = self.marked(taken, key, fields).select(F.col("__k").alias("k"), F.col("__h").alias("h")).distinct()
        level = 0
        while len(full := [s for s in segments if s.startswith(f"segment-{level}-")]) >= FAN - 1:
            add = add.unionByName(self.seen(full)).distinct()
            segments, waste, level = [s for s in segments if s not in full], waste | dict.fromkeys(full, number), level + 1
        name = f"segment-{level}-{number}-{uuid.uuid4().hex[:12]}"
        add.write.parquet(f"{self.path}/{name}")
        try:
            self.manifests.publish({"version": number, "segments": [*segments, name], "waste": waste})
        except Conflict:
            remove(self.spark, f"{self.path}/{name}")
            raise
        return number

    def run(self, rows: DataFrame, key: str, fields: list[str], work: Callable[[DataFrame, int], None], resume: bool = False) -> int:
        """Hand the changed rows to work(rows, number) and commit them; the number of the run.

        The rows are written down first. If a run dies, resume=True hands the same rows out under the same number, or,
        if the work was done, only commits; work that writes to a place named by the number (overwriting it) therefore
        takes effect once. Without resume, a run that is under way or died is a Conflict.
        """
        old = self.manifest()["version"]
        number, place = old + 1, f"run-{old + 1}"
        if not self.manifests.create(f"{place}.claim", "") and not resume:
            raise Conflict(f"run {number} is under way, or died: resume it")
        if not self.manifests.exists(f"{place}/_SUCCESS"):
            self.changed(rows, key, fields).write.mode("overwrite").parquet(f"{self.path}/{place}")
        taken = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{place}")
        if not self.manifests.exists(f"{place}.done"):
            work(taken, number)
            self.manifests.create(f"{place}.done", "")
        self.commit(taken, key, fields, after=old)
        for name in (place, f"{place}.claim", f"{place}.done"):
            remove(self.spark, f"{self.path}/{name}")
        return number
