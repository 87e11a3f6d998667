"""Files of a project tree, manifests and transcripts as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the project format: folders that hold sources, folders that hold none, kinds of files.
SOURCE_FOLDERS = ("Assets", "Packages")
IGNORED_FOLDERS = ("Library", "Temp", "Logs", "obj", "Build", "Builds", ".git", ".nuget-packages", ".nuget-http")
REFERRING = ("prefab", "unity", "asset", "mat", "controller", "anim", "overrideController", "playable", "mask", "preset", "spriteatlas")
TRACKED = ("cs", "meta", *REFERRING)

MANIFEST = "schema int, unityVersion string, generatedAt string, assets array<struct<guid string, path string, scriptType string, dependencies array<string>>>"
GOLDEN = "corpus string, k int, queries array<struct<id string, query string, type string, lang string, should_hit boolean, targets string, expected array<string>>>"
CURATION = "concepts array<struct<name string, summary string>>, edges array<struct<from string, to string, rel string, confidence double, why string>>"
TRANSCRIPT = (
    "timestamp timestamp, message struct<role string, content string, usage struct<input_tokens bigint, cache_creation_input_tokens bigint, "
    "cache_read_input_tokens bigint, output_tokens bigint>>"
)


def _folders(spark: SparkSession, root: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f"{root}/{x}" for x in SOURCE_FOLDERS if system.exists(path(f"{root}/{x}"))] or [root]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _in_any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def project_files(spark: SparkSession, root: str, kinds: tuple[str, ...] = TRACKED) -> DataFrame:
    """``(path, modified, content, sha1)`` of the files of the given kinds, paths relative to the project.

    Only files with these endings, in any case, are opened.  ``sha1`` is of the
    file's bytes; the content of a file that isn't UTF-8 text (a binary asset)
    is null.  Folders named in ``IGNORED_FOLDERS`` are left out at any depth,
    whatever their case; unreadable files are skipped.  A project without source
    folders is taken whole.
    """
    root = root.rstrip("/")
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", "*.{" + ",".join(_in_any_case(k) for k in kinds) + "}").load(_folders(spark, root))
    )
    bare = re.sub("/+", "/", root.split(":", 1)[-1])
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^{re.escape(bare)}/", "")
    ignored = F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda x: F.lower(x).isin(*(i.lower() for i in IGNORED_FOLDERS)))
    rows = rows.select(plain.alias("path"), F.col("modificationTime").alias("modified"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.sha1("content").alias("sha1"))
    return rows.where(~ignored)


def index_state(files: DataFrame, manifest_hash: str | None = None) -> DataFrame:
    """``(path, sha1)`` of tracked files; a manifest counts as one more file."""
    rows = files.select("path", "sha1")
    if manifest_hash is None:
        return rows
    return rows.unionByName(files.sparkSession.createDataFrame([("::manifest", manifest_hash)], "path string, sha1 string"))


def state_diff(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """``(path, change)`` of files that were added, changed or removed; without an old state all are added."""
    if old is None:
        return new.select("path", F.lit("added").alias("change"))
    both = new.select("path", "sha1").join(old.select("path", F.col("sha1").alias("old")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("sha1").isNull(), "removed").when(F.col("sha1") != F.col("old"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(guid, path, script_type, dependencies)`` of a JSON manifest; names in any case, records without guid left out."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    assets = rows.select(F.explode("assets").alias("a")).select("a.guid", "a.path", F.col("a.scriptType").alias("script_type"), F.coalesce("a.dependencies", F.array().cast("array<string>")).alias("dependencies"))
    return assets.where("guid <> ''")


#: The name under which a manifest is looked for in a project's folder.
MANIFEST_NAME = "asset-manifest.json"


def file_hash(spark: SparkSession, path: str) -> str:
    """The SHA-1 of one file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha1("content")).first()[0]


def discovered_manifest(spark: SparkSession, root: str, files: DataFrame) -> str | None:
    """The manifest in a project's folder, if there is one that isn't older than the files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{MANIFEST_NAME}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    modified = F.timestamp_millis(F.lit(system.getFileStatus(path).getModificationTime()))
    return None if manifest_is_stale(files, modified) else path.toString()


def manifest_is_stale(files: DataFrame, manifest_modified: Column) -> bool:
    """Whether any file is newer than the manifest."""
    return not files.where(F.col("modified") > manifest_modified).isEmpty()


def curation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The ``concepts`` (name, summary) and ``edges`` (from, to, rel, confidence, why) that a JSON file states."""
    rows = spark.read.schema(CURATION).option("multiLine", True).json(path)
    return {name: rows.select(F.explode(name).alias("x")).select("x.*") for name in ("concepts", "edges")}


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path).select("corpus", "k", F.explode("queries").alias("q")).select("corpus", "k", "q.*")


def transcripts(spark: SparkSession, path: str, newer_than: str | None = None) -> DataFrame:
    """``(file, timestamp, message)`` of JSON lines; lines that aren't JSON, and older files, are left out."""
    rows = spark.read.schema(TRANSCRIPT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = rows.where("_bad is null") if newer_than is None else rows.where(F.col("_bad").isNull() & (F.col("modified") >= F.lit(newer_than).cast("timestamp")))
    return rows.select("file", "modified", "timestamp", "message")


def token_tally(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task and approach: tokens, weighted cost and seconds; a pivot is ``groupBy("task").pivot("approach")``.

    A transcript belongs to the first task whose ``match`` its first user text
    contains; of several transcripts for a task and approach the newest counts.
    The approach is the file's folder.
    """
    from pyspark.sql import Window

    usage = lambda c: F.coalesce(F.sum(f"message.usage.{c}"), F.lit(0))
    text = F.min(F.when(F.col("message.role") == "user", F.struct("timestamp", "message.content")))
    files = lines.groupBy("file").agg(
        F.max("modified").alias("modified"), text.alias("first"), usage("input_tokens").alias("i"), usage("cache_creation_input_tokens").alias("w"),
        usage("cache_read_input_tokens").alias("r"), usage("output_tokens").alias("o"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"),
    )
    weighted = (F.col("i") + 1.25 * F.col("w") + 0.1 * F.col("r") + 5 * F.col("o")).cast("long")
    matched = files.join(tasks.select("task", "match"), F.contains(F.col("first.content"), F.col("match")))
    one = matched.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("task"))).where("n = 1").withColumn("approach", F.element_at(F.split("file", "/"), -2))
    last = one.withColumn("n", F.row_number().over(Window.partitionBy("task", "approach").orderBy(F.desc("modified"), "file"))).where("n = 1")
    seconds = (F.unix_micros("t1") - F.unix_micros("t0")) / 1e6
    return last.select("task", "approach", (F.col("i") + F.col("w")).alias("new_input"), F.col("o").alias("output"), weighted.alias("cost"), F.coalesce(seconds, F.lit(0.0)).alias("seconds"))
