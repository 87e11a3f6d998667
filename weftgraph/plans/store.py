"""A graph's tables in a folder: whole snapshots, and small additions between them.

Writers never touch what others read.  A snapshot is a new folder, claimed by a
file that only one writer can create, and it counts once its ``_DONE`` file is
there; ``folded.json`` names the additions that it holds.  An addition is a folder of
its own, so additions of several writers never overwrite each other, and one that
arrives while a snapshot is being written simply stays in force after it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Tables by name; ``keys`` says by which columns an added row replaces an older one."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, list[str]]):
        self.spark, self.folder, self.schemas, self.keys = spark, folder.rstrip("/"), schemas, keys
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        return sorted(x.getPath().getParent().getName() for x in self._system.globStatus(self._path(f"{self.folder}/{pattern}")) or [])

    def versions(self) -> list[int]:
        return [int(name[1:]) for name in self._found("v*/_DONE")]

    def _create(self, path: str, content: str = "") -> bool:
        """Create a file, unless there is one; whether it was created."""
        try:
            out = self._system.create(self._path(path), False)
        except Exception as error:  # noqa: BLE001
            if "exist" in str(error).lower():
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _folded(self, version: int) -> list[str]:
        """The additions that a snapshot holds."""
        read = self._system.open(self._path(f"{self.folder}/v{version:06d}/folded.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8"))
        finally:
            read.close()

    def _additions(self, table: str) -> list[str]:
        versions = self.versions()
        folded = set(self._folded(versions[-1])) if versions else set()
        return [name for name in self._found(f"added/{table}/*/_SUCCESS") if name not in folded]

    def save(self, seen: dict[str, list[str]] | None = None, **tables: DataFrame) -> int:
        """Write the tables as the next snapshot, others as they are; ``seen`` are the additions that the given tables hold (:meth:`seen`)."""
        seen = self.seen() if seen is None else seen
        others = {name: self.load(name, seen[name]) for name in self.schemas if name not in tables}
        version = (self.versions() or [0])[-1] + 1
        while not self._create(f"{self.folder}/claims/{version:06d}"):
            version += 1
        root = f"{self.folder}/v{version:06d}"
        for name, frame in {**tables, **others}.items():
            frame.write.parquet(f"{root}/{name}")
        self._create(f"{root}/folded.json", json.dumps([x for own in seen.values() for x in own] + (self._folded(self.versions()[-1]) if self.versions() else [])))
        self._create(f"{root}/_DONE")
        return version

    def seen(self) -> dict[str, list[str]]:
        """The additions in force now, by table."""
        return {name: self._additions(name) for name in self.schemas}

    def add(self, table: str, rows: DataFrame) -> None:
        """Add rows; a row with the same keys as an older one replaces it."""
        kind = T.StructType.fromDDL(self.schemas[table])
        given = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind))
        given.withColumn("_written", F.lit(time.time_ns())).write.parquet(f"{self.folder}/added/{table}/{time.time_ns()}-{uuid.uuid4().hex}")

    def load(self, table: str, additions: list[str] | None = None) -> DataFrame:
        """A table as it is now; empty where nothing is."""
        kind, versions = T.StructType.fromDDL(self.schemas[table]), self.versions()
        additions = self._additions(table) if additions is None else additions
        base = self.spark.read.schema(kind).parquet(f"{self.folder}/v{versions[-1]:06d}/{table}") if versions else self.spark.createDataFrame([], kind)
        if not additions:
            return base
        written = T.StructType([*kind, T.StructField("_written", T.LongType())])
        added = self.spark.read.schema(written).parquet(*(f"{self.folder}/added/{table}/{name}" for name in additions))
        keys = self.keys[table]
        last = Window.partitionBy(*keys).orderBy(F.desc("_written"))
        added = added.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*base.columns)
        new = added.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same: Column = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return base.join(new, same, "left_anti").unionByName(added)

    def delete(self) -> None:
        self._system.delete(self._path(self.folder), True)
