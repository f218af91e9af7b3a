"""Jobs that run in steps and go on where they stopped: file streams, append logs, and the state of a run from its events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_at_once: int = 100) -> StreamingQuery:
    """Hand all files that have not been handled yet to `handle`, batch by batch; a batch is done when it returns.

    After a failure the batch that was under way is handed over again with the same number, so `handle` should write by that number or by key.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Requests appended to a log as they come."""
    stamped = stream.withColumn("logged_at", F.date_format(F.from_unixtime("epoch"), "yyyy-MM-dd HH:mm:ss"))
    return stamped.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_events(lines: DataFrame) -> DataFrame:
    """Lines of JSON as events (job, at, event, done, total, message); other lines are left out."""
    e = F.from_json("value", "job string, event string, done long, total long, message string")
    return lines.select("at", e.alias("e")).where("e.event IS NOT NULL").select("at", "e.*")


def job_states(events: DataFrame) -> DataFrame:
    """Each job's state after its events: failed, finished or running, how far it came and its last message."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "done")))
    state = F.when(F.max((F.col("event") == "error").cast("int")) == 1, "failed").when(F.max((F.col("event") == "finished").cast("int")) == 1, "finished").otherwise("running")
    return events.groupBy("job").agg(state.alias("state"), F.max("done").alias("done"), F.max("total").alias("total"), last("message").alias("message"))


def run_listing(files: DataFrame) -> DataFrame:
    """Runs by their file names (run-<id>.json), newest first; other files are left out."""
    run = F.regexp_extract("path", r"run-([A-Za-z0-9_-]+)\.json$", 1)
    return files.select(run.alias("run"), "path", "modificationTime").where("run <> ''").orderBy(F.desc("modificationTime"), "run")
