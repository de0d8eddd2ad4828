"""Streams: continuous incremental backup, catalog upsert, alerts, and run-rate windows.

Every sink write goes to a folder named by its batch and replaces it, so a batch that is tried again after a failure
leaves one copy. Positions are the query's checkpoint, kept under the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelson.operators import alerts as N
from keelson.plans.backup import Catalog, commit_step, stream_parent
from keelson.sources.snapshots import TrackedTable
from keelson.streaming.runs import RunTable


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, batch_bytes: int | None = None, batch_files: int | None = None
) -> DataFrame:
    """Parquet files below a path (a glob may also name one file) as a stream, oldest first.

    A batch holds at most ``batch_bytes`` or ``batch_files``; without either, everything that is there.
    """
    reader = spark.readStream.schema(schema)
    if batch_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    if batch_files is not None:
        reader = reader.option("maxFilesPerTrigger", batch_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in batches and stop; a later call goes on where this one ended."""
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def backup_stream(stream: DataFrame, table: TrackedTable, catalog: Catalog, root: str, database: str, name: str, checkpoint: str) -> str | None:
    """Each batch is one step of the chain ``<name>-*`` in the catalog, whose parent is the step before; returns the newest step's id.

    Steps are ordinary records: lineage, retention and restore treat them like those of runs. A batch is committed once, however
    often the stream tries it.
    """
    run_available(stream, lambda batch, number: commit_step(catalog, name, number, table, root, database, batch), checkpoint)
    newest = stream_parent(catalog, name)
    return newest["id"] if newest else None


def upsert_stream(log_stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "seq") -> DataFrame:
    """Newest row per id of a log stream, kept as runs of falling size: the sink grows with the ids, not with the batches.

    Late rows lose to newer ones by ``order``, not by arrival, and a repeated batch changes nothing.
    """
    table = RunTable(log_stream.sparkSession, path, log_stream.schema, [key], [order])
    run_available(log_stream, lambda batch, number: table.merge(batch), checkpoint)
    return table.current()


def alert_stream(records: DataFrame, path: str, checkpoint: str, channels: list[str], chat_id: str = "", details: bool = False) -> DataFrame:
    """Finished runs of a record stream as rendered alerts, one row per channel."""

    def emit(batch: DataFrame, number: int) -> None:
        alerts = N.run_alerts(batch, details).withColumn("channels", F.array(*[F.lit(c) for c in channels]))
        N.render(N.route(alerts), chat_id).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(records, emit, checkpoint)
    return records.sparkSession.read.schema("id string, channel string, body string").parquet(f"{path}/batch=*")


def _on_time(records: DataFrame, delay: str, unique: str | None) -> DataFrame:
    """Records with their instant ``at`` and its watermark; of those with one ``unique`` value within the delay, the first to come.

    Watermarks need an instant, so the zone-less start time is read in the session's zone.
    """
    timed = records.withColumn("at", F.col("start_time").cast("timestamp")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark([unique]) if unique else timed


def run_rates(records: DataFrame, delay: str = "2 hours", width: str = "1 hour", unique: str | None = None) -> DataFrame:
    """Runs and failures per window; a window closes when the watermark passes its end, later rows are dropped."""
    grouped = _on_time(records, delay, unique).groupBy(F.window("at", width)).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "FAILED").alias("failures")
    )
    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        "runs",
        "failures",
    )


def run_sessions(records: DataFrame, key: str, delay: str = "2 hours", gap: str = "30 minutes", unique: str | None = None) -> DataFrame:
    """Stretches of runs of one ``key`` with no pause of ``gap``; a session closes when the watermark passes its last run plus the gap."""
    grouped = _on_time(records, delay, unique).groupBy(key, F.session_window("at", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "FAILED").alias("failures")
    )
    return grouped.select(
        key,
        F.col("session.start").cast("timestamp_ntz").alias("session_start"),
        F.col("session.end").cast("timestamp_ntz").alias("session_end"),
        "runs",
        "failures",
    )


def closed_windows(rates: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a window query over what is available and read the windows that closed."""
    query = (
        rates.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rates.sparkSession.read.schema(rates.schema).parquet(path)
