"""Queries for extraction from texts, and for streams, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_summary
from ..operators import extraction
from ..sources.project_files import MANIFEST
from ..streaming import watch
from .project_graph import table
from .runtime import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _texts(spark, sf, kind: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("doc_type") == kind).select("doc_id", "text")


@_query(r"""
WITH found AS (SELECT doc_id, regexp_extract(text, '(?s)<summary>(.*?)</summary>', 1) AS inside FROM documents WHERE doc_type = 'source_file')
SELECT doc_id, trim(left(trim(regexp_replace(regexp_replace(regexp_replace(inside, '<[^>]*>', ' ', 'g'), '(?m)^[\t\n\f\r\v ]*///?', ' ', 'g'), '[\t\n\f\r\v ]+', ' ', 'g')), 400)) AS summary
FROM found WHERE inside <> ''""")
def doc_summaries(spark, sf):
    """The first summary comment of every source text, tags off and white space folded."""
    return _texts(spark, sf, "source_file").select("doc_id", F.trim(doc_summary(F.col("text"))).alias("summary")).where(F.regexp_extract("summary", ".", 0) != "")


@_query(r"""
WITH found AS (SELECT doc_id, lower(unnest(list_distinct(regexp_extract_all(text, 'guid:[\t\n\f\r\v ]*([0-9a-fA-F]{32})', 1)))) AS guid FROM documents WHERE doc_type = 'asset_dump')
SELECT DISTINCT doc_id, guid FROM found""")
def guid_references(spark, sf):
    """The distinct guids that every asset dump refers to."""
    return _texts(spark, sf, "asset_dump").select("doc_id", F.explode(extraction.guid_references(F.col("text"))).alias("guid"))


@_query(r"""
WITH parsed AS (SELECT doc_id, CASE WHEN json_valid(text) THEN json_extract(text, '$.assets[*]') END AS assets FROM documents WHERE doc_type = 'manifest_text'),
each AS (SELECT doc_id, unnest(assets) AS a FROM parsed)
SELECT doc_id, count(*) AS n_assets, sum(coalesce(json_array_length(a, '$.dependencies'), 0))::BIGINT AS n_dependencies FROM each WHERE a->>'guid' <> '' GROUP BY 1""")
def manifest_texts(spark, sf):
    """Assets and dependencies stated in every manifest text that is JSON."""
    assets = _texts(spark, sf, "manifest_text").select("doc_id", F.explode(F.from_json("text", MANIFEST)["assets"]).alias("a")).where("a.guid <> ''")
    return assets.groupBy("doc_id").agg(F.count("*").alias("n_assets"), F.sum(F.coalesce(F.size("a.dependencies"), F.lit(0))).alias("n_dependencies"))


@_query()
def source_types(spark, sf):
    """The types that every source text declares, with bases and signature."""
    files = _texts(spark, sf, "source_file").select(F.concat("doc_id", F.lit(".cs")).alias("path"), F.col("text").alias("content"))
    types = extraction.declared_types(files)
    return types.select("path", "label", "key", F.array_join("bases", ", ").alias("bases"))


_DECLARED_SQL = r"""
WITH files AS (SELECT doc_id, text FROM documents WHERE doc_type = 'source_file' AND text IS NOT NULL),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:(?:MODIFIERS)\s+)*(?:record\s+struct|record\s+class|class|interface|struct|enum|record)\s+[A-Za-z_]\w*')) AS decl FROM files),
each AS (SELECT doc_id, regexp_extract(decl, '(record\s+struct|record\s+class|class|interface|struct|enum|record)\s+[A-Za-z_]\w*$', 1) AS kind, regexp_extract(decl, '[A-Za-z_]\w*$') AS name FROM found)
SELECT doc_id, CASE WHEN contains(kind, 'struct') THEN 'Struct' WHEN kind = 'interface' THEN 'Interface' WHEN kind = 'enum' THEN 'Enum' ELSE 'Class' END AS label, name, count(*) AS n FROM each GROUP BY ALL""".replace("MODIFIERS", extraction._MODIFIERS)


@_query(_DECLARED_SQL)
def source_declarations(spark, sf):
    """How often every source text declares a type of each name."""
    files = _texts(spark, sf, "source_file").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    types = extraction.declared_types(files).select(F.col("path").cast("bigint").alias("doc_id"), "label", "name")
    return types.groupBy("doc_id", "label", "name").agg(F.count("*").alias("n"))


@_query()
def source_methods(spark, sf):
    """The methods that every source text declares, by their keys."""
    files = _texts(spark, sf, "source_file").select(F.concat("doc_id", F.lit(".cs")).alias("path"), F.col("text").alias("content"))
    return extraction.methods(extraction.declared_types(files)).select("path", "owner", "key", "arity")


#: Rows in a file of a stream that runs batch by batch, and files in a batch, at most.
FILE_ROWS, BATCH_FILES = 65536, 4


def _stream(spark, sf, name: str, columns: str, batches: bool = False) -> DataFrame:
    """A table as a stream of files: its only file is linked into a folder by writing it there, with ``batches`` as files of bounded size."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table(spark, sf, name).selectExpr(*columns.split(", ")).write.option("maxRecordsPerFile", FILE_ROWS if batches else 0).parquet(folder)
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (reader.option("maxFilesPerTrigger", BATCH_FILES) if batches else reader).parquet(folder)


@_query("""
WITH logged AS (SELECT event_type || ' ' || props AS query, CASE WHEN value < 50 THEN 'none' ELSE 'low' END AS tier, ts FROM events WHERE event_type = 'error')
SELECT lower(trim(query)) AS key, arg_max(query, (ts, tier, query)) AS query, count(*) AS n, arg_max(tier, (ts, tier, query)) AS tier, max(ts) AS last_seen, min(ts) AS first_seen FROM logged GROUP BY 1""")
def miss_log_stream(spark, sf):
    """Error events as a stream of unanswered searches, counted."""
    events = _stream(spark, sf, "events", "event_type, props, value, ts")
    misses = events.where("event_type = 'error'").select(F.concat_ws(" ", "event_type", "props").alias("query"), F.when(F.col("value") < 50, "none").otherwise("low").alias("tier"), F.col("ts").alias("seen_at"))
    return watch.run_to_table(watch.count_misses(misses), f"misses_{uuid.uuid4().hex}")


@_query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows_stream(spark, sf):
    """Events by day and type from a stream with a watermark."""
    events = _stream(spark, sf, "events", "event_type, value, ts")
    found = watch.run_to_table(watch.event_windows(events), f"windows_{uuid.uuid4().hex}")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _watched(spark, sf) -> DataFrame:
    """``(path, sha1, seen_at)`` of all watched files after a stream of all index records, batch by batch."""
    files = _stream(spark, sf, "index_files", "project || '/' || file_path AS path, content_sha1 AS sha1, loaded_at, snapshot_no", batches=True)
    seen = files.where("sha1 is not null and path is not null").select("path", "sha1", F.struct("loaded_at", "snapshot_no", "sha1").alias("seen_at"))
    return watch.run_to_table(seen, f"watched_{uuid.uuid4().hex}", fold=watch.latest_state)


@_query("""
WITH files AS (SELECT project || '/' || file_path AS path, max((loaded_at, snapshot_no, content_sha1)) AS seen FROM index_files WHERE content_sha1 IS NOT NULL AND project IS NOT NULL AND file_path IS NOT NULL GROUP BY 1)
SELECT struct_extract(seen, 2) AS snapshot_no, count(*) AS files, max(struct_extract(seen, 1)) AS last_loaded FROM files GROUP BY 1""")
def watch_microbatch(spark, sf):
    """In which snapshot the watched files were seen last, after a stream of all index records, batch by batch."""
    return _watched(spark, sf).groupBy(F.col("seen_at.snapshot_no").alias("snapshot_no")).agg(F.count("*").alias("files"), F.max("seen_at.loaded_at").alias("last_loaded"))


@_query("""
SELECT project || '/' || file_path AS path, arg_max(content_sha1, (loaded_at, snapshot_no, content_sha1)) AS sha1 FROM index_files WHERE content_sha1 IS NOT NULL AND project IS NOT NULL AND file_path IS NOT NULL GROUP BY 1""")
def watch_latest(spark, sf):
    """The latest state of all watched files after a stream of all index records, batch by batch."""
    return _watched(spark, sf).select("path", "sha1")
