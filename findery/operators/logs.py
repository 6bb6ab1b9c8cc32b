"""Query-log statistics: throughput, latency, stages and weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.functions.text import normalize_query


def query_events(requests: DataFrame) -> DataFrame:
    """Log rows of answered requests (``ts, query, config, n_docs, latency, ...``)."""
    norm = normalize_query(F.col("query"))
    return requests.select(
        F.col("ts").cast("long").alias("ts"), F.sha1(F.encode(norm, "UTF-8")).alias("query_hash"),
        norm.alias("query_norm"), "config", F.col("n_docs").cast("int").alias("n_docs"),
        F.col("latency").cast("double").alias("latency"), "expand_index_id", "expand_offset", "K",
    )


def write_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def latency_stats(log: DataFrame, by: list[str], latency: str = "latency", ok: str = "ok",
                  start: str | None = None) -> DataFrame:
    """Sequential throughput and latency per group.

    Throughput is successes over the whole time spent; the mean and the
    population deviation leave failures out. With ``start`` (seconds) the
    throughput against the wall clock is added.
    """
    good = F.when(F.col(ok), F.col(latency))
    aggs = [
        F.count("*").alias("n_requests"),
        F.count(good).alias("n_success"),
        (F.count(good) / F.sum(latency)).alias("qps"),
        F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_latency"),
        F.coalesce(F.stddev_pop(good), F.lit(0.0)).alias("std_latency"),
    ]
    if start is not None:
        wall = F.max(F.col(start) + F.col(latency)) - F.min(start)
        aggs.append((F.count("*") / wall).alias("wall_qps"))
    return log.groupBy(*by).agg(*aggs)


def batch_latency_stats(batches: DataFrame, by: list[str]) -> DataFrame:
    """Batched throughput: all queries over the time of the batches that succeeded.

    Takes one row per batch: ``n_queries, batch_time, ok``.
    """
    good = F.when(F.col("ok"), F.col("batch_time"))
    return batches.groupBy(*by).agg(
        F.sum("n_queries").alias("n_queries"),
        F.when(F.sum(good) > 0, F.sum("n_queries") / F.sum(good)).otherwise(0.0).alias("qps"),
        F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_batch"),
        F.coalesce(F.stddev_pop(good), F.lit(0.0)).alias("std_batch"),
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, half up to two decimals on whole microseconds."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor((micros + 5) / 10) / 100.0


def stage_latency(requests: DataFrame, times: list[str], keep: list[str]) -> DataFrame:
    """Duration of every stage between consecutive time columns, and the total."""
    stages = [
        elapsed_ms(F.col(a), F.col(b)).alias(f"stage_{n}_ms")
        for n, (a, b) in enumerate(zip(times, times[1:]), start=1)
    ]
    return requests.select(*keep, *stages, elapsed_ms(F.col(times[0]), F.col(times[-1])).alias("total_ms"))


def weighted_stats(rows: DataFrame, name: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per statistic; 0 where nothing has weight."""
    total = F.sum(weight)
    return rows.groupBy(name).agg(
        F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0).alias("mean"),
        total.alias("weight"),
    )


def macro_average(rows: DataFrame, part: str, metric: str, value: str, expected_parts: int) -> DataFrame:
    """Mean over parts of the per-part mean, in percent, and whether all parts are there."""
    per_part = rows.groupBy(metric, part).agg(F.avg(value).alias("_m"))
    return per_part.groupBy(metric).agg(
        (100 * F.avg("_m")).alias("macro_average"), F.count("*").alias("n_parts"),
        (F.count("*") == expected_parts).alias("complete"),
    )
