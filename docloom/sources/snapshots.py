"""All tables of the engine as one versioned snapshot: a commit writes new folders, then publishes one manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from docloom.operators.incremental import Conflict, Manifests
from docloom.runtime import remove


class Snapshots:
    """Any readers, and writers of which the first to commit a version wins; a reader sees the tables of one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def version(self) -> int:
        return self.manifests.current()["version"]

    def tables(self) -> dict[str, list[str]]:
        """Of each table, the folders of its parts."""
        return dict(self.manifests.current().get("tables", {}))

    def read(self, name: str) -> DataFrame:
        return self.read_all()[1][name]

    def read_all(self) -> tuple[int, dict[str, DataFrame]]:
        """A version and its tables, which belong together."""
        now = self.manifests.current()
        kinds = {name: StructType.fromJson(kind) for name, kind in now.get("kinds", {}).items()}
        return now["version"], {name: self.spark.read.schema(kinds[name]).parquet(*[f"{self.path}/{p}" for p in parts]) for name, parts in now.get("tables", {}).items()}

    def commit(self, after: int | None = None, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> int:
        """Replace the given tables, add parts to those of append, keep the others; the new version's number. Nothing is
        visible before the manifest is there. after: the version that the tables were made from (Conflict if it is no
        longer in force)."""
        old = self.manifests.current()
        if after is not None and old["version"] != after:
            raise Conflict(f"version {after} is no longer in force")
        number, parts, waste = old["version"] + 1, dict(old.get("tables", {})), dict(old.get("waste", {}))
        kinds, new = dict(old.get("kinds", {})), []
        try:
            for name, df in [*tables.items(), *(append or {}).items()]:
                new.append(f"{name}-{number}-{uuid.uuid4().hex[:12]}")
                df.write.parquet(f"{self.path}/{new[-1]}")
                if name in tables:
                    waste |= dict.fromkeys(parts.get(name, []), number)
                    parts[name], kinds[name] = [new[-1]], df.schema.jsonValue()
                else:
                    parts[name], kinds[name] = [*parts.get(name, []), new[-1]], kinds.get(name, df.schema.jsonValue())
            self.manifests.publish({"version": number, "tables": parts, "kinds": kinds, "waste": waste})
        except BaseException:
            for place in new:
                remove(self.spark, f"{self.path}/{place}")
            raise
        return number

    def transform(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 3) -> int:
        """Commit change(tables); if another writer was first, make the change anew from what that one left."""
        for left in reversed(range(tries)):
            version, tables = self.read_all()
            try:
                return self.commit(after=version, **change(tables))
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")
