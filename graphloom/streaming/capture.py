"""Event capture with Structured Streaming, and its batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import mask_args, redact_private, summarised
from graphloom.session import Scratch

EVENT = "type string, ts long, sessionId string, projectId string, content string, toolName string, argsSafe string, resultSummary string, durationMs long"


def cleaned(events: DataFrame) -> DataFrame:
    """Contents without private parts, arguments masked, results shortened; batch or stream."""
    return events.withColumns({"content": redact_private("content"), "argsSafe": mask_args("argsSafe"), "resultSummary": summarised("resultSummary")})


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON-lines files; blank and malformed lines are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("type is not null")


def stream_queue(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """T4: the same as a stream, so many files a micro-batch."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(path)
    return rows.where("type is not null").withColumn("at", F.timestamp_millis("ts"))


def drain(events: DataFrame, out: str, checkpoint: str):
    """Clean events and append them to one ledger table a type (partitions of ``out``); ends when the queue is empty.

    The checkpoint and the file sink's log make retries exactly-once.
    """
    known = cleaned(events).where(F.col("type").isin("prompt", "response", "tool_call"))
    return known.writeStream.format("parquet").partitionBy("type").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partition_quiet(changes: DataFrame, now: str, quiet_s: int = 300, key: str = "key", time: str = "ts") -> DataFrame:
    """Last change of each key, and whether it is quiet: the limit counts."""
    last = changes.groupBy(key).agg(F.max(time).alias("last"))
    return last.withColumn("quiet", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) >= quiet_s)


def stream_quiet(changes: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", key: str = "key", time: str = "at") -> DataFrame:
    """T1 as a stream: a row when a key has been quiet for ``gap`` of event time: key, first and last change, number."""
    window = F.session_window(time, gap)
    return changes.withWatermark(time, late).groupBy(key, window).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("changes")).drop("session_window")


def remaining(pending: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Pending rows (key, last) but those that were handled at exactly that time: later changes are not lost."""
    return pending.join(done.select(key, "last"), [key, "last"], "left_anti")


def heartbeat(rows: DataFrame, now: str, stale_s: int = 300) -> DataFrame:
    """State of each run by its last beat: finished, failed, idle, running or stalled."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("beat").cast("timestamp"))
    state = F.when(F.col("finished"), "finished").when(F.col("failed"), "failed").when(F.col("beat").isNull(), "idle").when(age <= stale_s, "running").otherwise("stalled")
    return rows.withColumn("state", state)


def sessions_by_gap(events: DataFrame, gap_s: int, key: str, time: str, order: str) -> DataFrame:
    """Key, session number, start, end and events of runs without a gap over ``gap_s``.

    A scan in two steps: rows lie in ranges of (key, time, order), each range finds the sessions that begin inside it, and one row for each key and range
    carries the last time and the number of sessions on to the next. So a key with very many rows is the work of as many tasks as it has ranges.
    """
    ranged = events.repartitionByRange(key, time, order).withColumn("_range", F.spark_partition_id())
    held = Scratch(events.sparkSession, "sessions").write(ranged.select(key, time, order, "_range"), "ranged")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = Window.partitionBy(key, "_range").orderBy(time, order)
    new = micros(time) - F.lag(micros(time)).over(own) > gap_s * 1_000_000
    rows = held.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("_in", F.sum("_new").over(own))
    carry = rows.groupBy(F.col(key).alias("_key"), "_range").agg(F.min(time).alias("_low"), F.max(time).alias("_high"), F.sum("_new").alias("_inside"))
    along = Window.partitionBy("_key").orderBy("_range")
    apart = micros("_low") - micros("_before") > gap_s * 1_000_000
    carry = carry.withColumn("_before", F.lag("_high").over(along)).withColumn("_first", F.coalesce(apart, F.lit(True)).cast("int"))
    upto = F.sum(F.col("_first") + F.col("_inside")).over(along) - F.col("_inside")
    carry = carry.select("_key", F.col("_range").alias("_r"), upto.alias("_upto"))
    whole = rows.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r"))).withColumn("session", F.col("_in") + F.col("_upto"))
    return whole.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events"))
