"""Keyed running state from append-only JSON logs.

The aggregation runs in update mode: a micro-batch hands on the keys it changed,
and ``foreachBatch`` stores them under its own batch number. Writing a batch
again replaces the same folder, so a retry leaves nothing twice. The table is the
newest row of each key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findery.operators.votes import latest_votes


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def store_updates(updates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run what has arrived so far, one folder of changed keys per micro-batch."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(save).start()
    )


def _snapshot(spark: SparkSession, out: str) -> tuple[int, DataFrame | None]:
    """The newest compacted state and the last batch it holds."""
    try:
        stored = spark.read.parquet(f"{out}_compacted")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, None
    last = stored.agg(F.max("upto")).first()[0]
    return last, stored.where(F.col("upto") == last).withColumn("batch", F.col("upto").cast("int")).drop("upto")


def _batches(spark: SparkSession, out: str, base: DataFrame | None) -> DataFrame | None:
    """The batch folders as they are now; read with the schema of the snapshot, where there is one, so that none need be left."""
    reader = spark.read.option("basePath", out)
    try:
        return (reader if base is None else reader.schema(base.schema)).parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return base.limit(0) if base is not None else None


def current_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest stored row per key: the last compacted state and the batches after it."""
    upto, base = _snapshot(spark, out)
    stored = _batches(spark, out, base)
    if stored is None:
        raise ValueError(f"nothing is stored below {out}")
    stored = stored.where(F.col("batch") > upto)
    stored = stored if base is None else stored.unionByName(base)
    rest = [c for c in stored.columns if c not in (*keys, "batch")]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
    return last.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def compact_state(spark: SparkSession, out: str, keys: list[str]) -> int:
    """Store the state as it is; later reads start there and never open the batches it holds.

    Returns the last batch held; folders up to it may be removed once no read is under way.
    """
    upto, base = _snapshot(spark, out)
    stored = _batches(spark, out, base)
    newest = None if stored is None else stored.agg(F.max("batch")).first()[0]
    last = upto if newest is None else max(upto, newest)
    if last == upto:  # nothing has come since the last compaction
        return last
    current_state(spark, out, keys).write.mode("overwrite").parquet(f"{out}_compacted/upto={last}")
    return last


def running_latest_votes(events: DataFrame) -> DataFrame:
    """Newest vote per (query, context, passage), streaming."""
    return latest_votes(events)


def running_latency(events: DataFrame, by: list[Column]) -> DataFrame:
    """Count, mean and population deviation of the latency per group, streaming."""
    return events.groupBy(*by).agg(
        F.count("*").alias("n_requests"), F.avg("latency").alias("mean_latency"),
        F.stddev_pop("latency").alias("std_latency"),
    )


def timed(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Events with their time ``at`` and a watermark: those later than ``delay`` behind the newest seen may be left out."""
    return events.withColumn("at", F.timestamp_seconds(ts)).withWatermark("at", delay)


def windowed_latency(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests and latency per window of event time, each window once, when the watermark has passed its end.

    State is one row per open window. An event whose window is closed is left out.
    """
    counted = timed(events, delay).groupBy(F.window("at", width).alias("w")).agg(
        F.count("*").alias("n_requests"), F.avg("latency").alias("mean_latency"), F.stddev_pop("latency").alias("std_latency"))
    return counted.select(F.unix_timestamp("w.start").alias("window_start"), "n_requests", "mean_latency", "std_latency")


def store_appended(rows: DataFrame, out: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append what has arrived so far to files; the sink's own log keeps a batch that is written again from counting twice."""
    return (
        rows.writeStream.outputMode("append").format(kind).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )


def log_stream(events: DataFrame, out: str, checkpoint: str, event_id: str, delay: str = "1 day", ts: str = "ts") -> StreamingQuery:
    """Append events as JSON lines, each once: repeats of an id within ``delay`` are dropped, across restarts too.

    Only ids of the last ``delay`` are remembered; events more than that behind the newest are left out.
    """
    once = timed(events, delay, ts).dropDuplicatesWithinWatermark([event_id]).drop("at")
    return store_appended(once, out, checkpoint, "json")
