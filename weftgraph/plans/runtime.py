"""What the operators need from a session: shipped code and cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "weftgraph_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is set, one of our own, on a single machine only.

    On a cluster each executor would write to its own disk, so a session without the setting is refused there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def _delete(where, system) -> None:
    try:
        system.delete(where, True)
    except Exception:  # the JVM has already ended  # noqa: BLE001
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors and is read again in the
    columns needed.  ``drop`` removes the tables of earlier rounds of a loop;
    what returned DataFrames still read stays until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        atexit.register(_delete, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))

    def write(self, frame: DataFrame) -> DataFrame:
        """Run the plan once and return a DataFrame that reads its result."""
        path = f"{self.root}/{self._count}"
        self._count += 1
        frame.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept.weft_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            if (path := getattr(frame, "weft_path", None)) is not None:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(configuration).delete(where, True)
