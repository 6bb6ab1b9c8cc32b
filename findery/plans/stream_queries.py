"""Checked queries over streams; each must equal its batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from findery.functions.context import context_hash
from findery.operators.logs import query_events
from findery.operators.votes import KEYS
from findery.plans.event_queries import REQUESTS_SQL, VOTES_SQL, requests, vote_events
from findery.plans.registry import query
from findery.schemas import QUERY_EVENT, VOTE_EVENT
from findery.session import scratch_path
from findery.streaming import keyed

LOG_FILES = 6


def _spread_log(events, path: str) -> None:
    """The log as several files, so that a stream sees several micro-batches."""
    events.repartition(LOG_FILES).write.json(path)


def _store_votes(spark, log: str, out: str, offsets: str) -> None:
    events = keyed.read_log(spark, log, VOTE_EVENT, files_per_batch=3)
    events = events.withColumn("config", F.struct(
        "config.diverse_search", "config.exact_search", "config.lambda", "config.nprobe"))
    events = events.withColumn("ctx_hash", context_hash(F.col("config")))
    keyed.store_updates(keyed.running_latest_votes(events), out, offsets).awaitTermination()


@query("stream_latest_votes", f"WITH {VOTES_SQL} SELECT * FROM latest")
def stream_latest_votes(spark, sf):
    log, out = scratch_path(spark, "vote-log"), scratch_path(spark, "vote-state")
    _spread_log(vote_events(spark, sf).drop("ctx_hash"), log)
    _store_votes(spark, log, out, scratch_path(spark, "vote-offsets"))
    return keyed.current_state(spark, out, KEYS)


@query("stream_compacted_votes", f"WITH {VOTES_SQL} SELECT * FROM latest")
def stream_compacted_votes(spark, sf):
    """Half of the log, a compaction, the other half: the state goes on from what was compacted."""
    log, out, offsets = (scratch_path(spark, x) for x in ("vote-log", "vote-state", "vote-offsets"))
    events = vote_events(spark, sf).drop("ctx_hash")
    for half in (0, 1):
        events.where(F.pmod("seq", F.lit(2)) == half).repartition(LOG_FILES // 2).write.mode("append").json(log)
        _store_votes(spark, log, out, offsets)
        if half == 0:
            keyed.compact_state(spark, out, KEYS)
    return keyed.current_state(spark, out, KEYS)


def stored(spark, events):
    path = scratch_path(spark, "events")
    events.write.parquet(path)
    return spark.read.parquet(path)


def _in_order(events, path: str, parts: int = 4) -> None:
    """The log as files that follow each other in time, one write for each.

    A file has one writer; its lines are made by as many tasks as read the events.
    """
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    width = (high - low) // parts + 1
    for n in range(parts):
        part = events.where((F.col("ts") >= low + n * width) & (F.col("ts") < low + (n + 1) * width))
        part.select(F.to_json(F.struct("*")).alias("value")).repartition(1).write.mode("append").text(path)


@query("stream_hourly_latency", f"""WITH {REQUESTS_SQL}
SELECT ts // 3600 * 3600 AS window_start, count(*) AS n_requests, round(avg(latency), 9) AS mean_latency,
  round(stddev_pop(latency), 9) AS std_latency FROM requests
GROUP BY 1 HAVING window_start + 3600 <= (SELECT max(ts) - 600 FROM requests)""")
def stream_hourly_latency(spark, sf):
    """Hours that the watermark, ten minutes behind the newest request, has closed."""
    log, out = scratch_path(spark, "query-log"), scratch_path(spark, "hours")
    _in_order(query_events(requests(spark, sf)), log)
    events = keyed.read_log(spark, log, QUERY_EVENT, files_per_batch=1)
    keyed.store_appended(keyed.windowed_latency(events), out, scratch_path(spark, "hour-offsets")).awaitTermination()
    return spark.read.parquet(out).withColumn("mean_latency", F.round("mean_latency", 9)).withColumn(
        "std_latency", F.round("std_latency", 9))


@query("stream_vote_log", f"""WITH {VOTES_SQL}
SELECT seq, ts, query_hash, query_norm, passage_id, relevant, nprobe, exact_search, diverse_search, "lambda"
FROM vote_events""")
def stream_vote_log(spark, sf):
    """Votes of a stream that sends everything twice, logged once; the second half after a restart."""
    sent, out, offsets = (scratch_path(spark, x) for x in ("votes-sent", "votes-log", "votes-offsets"))
    # every file and every bound reads the events, which are made once
    events = stored(spark, vote_events(spark, sf).drop("ctx_hash"))
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for half in (events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle - 3600)):
        _in_order(half.union(half), sent)
        keyed.log_stream(keyed.read_log(spark, sent, VOTE_EVENT, files_per_batch=1), out, offsets, "seq").awaitTermination()
    return spark.read.schema(VOTE_EVENT).json(out).select(
        "seq", "ts", "query_hash", "query_norm", "passage_id", "relevant", "config.nprobe", "config.exact_search",
        "config.diverse_search", "config.lambda")


@query("stream_latency_stats", f"""WITH {REQUESTS_SQL}
SELECT coalesce(nprobe, 0) AS nprobe, diverse_search, count(*) AS n_requests, round(avg(latency), 6) AS mean_latency,
  round(stddev_pop(latency), 6) AS std_latency FROM requests GROUP BY 1, 2""")
def stream_latency_stats(spark, sf):
    log, out = scratch_path(spark, "query-log"), scratch_path(spark, "query-state")
    _spread_log(query_events(requests(spark, sf)), log)
    events = keyed.read_log(spark, log, QUERY_EVENT, files_per_batch=3)
    by = [F.coalesce(F.col("config.nprobe"), F.lit(0)).alias("nprobe"), F.col("config.diverse_search")]
    keyed.store_updates(keyed.running_latency(events, by), out, scratch_path(spark, "query-offsets")).awaitTermination()
    state = keyed.current_state(spark, out, ["nprobe", "diverse_search"])
    return state.withColumn("mean_latency", F.round("mean_latency", 6)).withColumn(
        "std_latency", F.round("std_latency", 6))
