"""Keeping state fresh from streams: file events, and searches without an answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import miss_counts
from ..plans.runtime import shared_folder


def watch_files(spark: SparkSession, folder: str, schema: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "800 milliseconds") -> StreamingQuery:
    """Run ``on_batch`` with the rows of Parquet files that arrive in ``folder``.

    Micro-batches follow each other, so runs never overlap; the trigger's
    interval gathers bursts of changes.  ``once`` handles what is there and ends.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest_state(files: DataFrame) -> DataFrame:
    """The streaming state of watched files: ``(path, sha1, seen_at)`` as seen last."""
    return files.groupBy("path").agg(F.max_by("sha1", "seen_at").alias("sha1"), F.max("seen_at").alias("seen_at"))


#: Streaming ``(key, query, n, tier, last_seen, first_seen)`` of searches without an answer.
count_misses = miss_counts


def event_windows(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Events counted in tumbling windows by type; rows later than ``late`` behind the newest are left out of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result, a table in the shared folder.

    The tasks write each batch's rows there; nothing goes through the driver.
    An aggregated stream gives its whole state with each batch, of which the
    last counts.  With ``fold`` the stream isn't aggregated: each batch is
    folded by itself, and what all batches left is folded again, so the state
    needs no store in memory (``fold`` must bear that, as :func:`latest_state` does).
    """
    spark = stream.sparkSession
    root, written = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def write(rows: DataFrame, batch: int) -> None:
        kept = fold(rows) if fold else rows
        kept.write.mode("overwrite").parquet(path := f"{root}/table/{batch}")
        written[batch] = path, kept.schema

    query = stream.writeStream.outputMode("append" if fold else mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        empty = spark.createDataFrame([], stream.schema)
        return fold(empty) if fold else empty
    last = max(written)
    paths = [written[last][0]] if mode == "complete" and not fold else [path for path, _ in written.values()]
    table = spark.read.schema(written[last][1]).parquet(*paths)
    return fold(table) if fold else table
