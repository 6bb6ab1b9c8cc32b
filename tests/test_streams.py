"""Streams: late rows, repeats across restarts, compaction and its clean-up."""

import shutil

import pytest
from pyspark.sql import functions as F

from findery.plans import stream_queries
from findery.schemas import QUERY_EVENT
from findery.streaming import keyed

SHORT = "ts long, latency double"


def append(spark, path, rows, schema=SHORT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_late_rows_are_left_out_by_rule(spark, tmp_path):
    log, out, offsets = (str(tmp_path / x) for x in ("log", "out", "offsets"))

    def run():
        events = keyed.read_log(spark, log, QUERY_EVENT, files_per_batch=1)
        keyed.store_appended(keyed.windowed_latency(events), out, offsets).awaitTermination()
        return {r["window_start"]: (r["n_requests"], r["mean_latency"]) for r in spark.read.parquet(out).collect()}

    append(spark, log, [(10, 1.0), (3000, 3.0), (3700, 5.0)])
    append(spark, log, [(4000, 7.0)])  # the watermark is at 3400: the first hour is still open
    assert run() == {}
    append(spark, log, [(3500, 2.0), (8200, 1.0)])  # late, but its hour is open
    assert run() == {0: (3, 2.0), 3600: (2, 6.0)}
    append(spark, log, [(20, 100.0), (9000, 1.0)])  # the first hour is closed: left out
    append(spark, log, [(20_000, 1.0)])
    append(spark, log, [(20_001, 1.0)])
    assert run() == {0: (3, 2.0), 3600: (2, 6.0), 7200: (2, 1.0)}
    assert spark.read.parquet(out).groupBy("window_start").count().where("count > 1").count() == 0


def test_repeats_are_logged_once_across_restarts(spark, tmp_path):
    sent, out, offsets = (str(tmp_path / x) for x in ("sent", "out", "offsets"))
    schema = "seq long, ts long, text string"

    def run():
        events = keyed.read_log(spark, sent, schema, files_per_batch=1)
        keyed.log_stream(events, out, offsets, "seq", "1 hour").awaitTermination()
        return sorted(r["seq"] for r in spark.read.schema(schema).json(out).collect())

    append(spark, sent, [(1, 100, "a"), (1, 100, "a"), (2, 200, "b")], schema)
    assert run() == [1, 2]
    assert run() == [1, 2]  # nothing new
    append(spark, sent, [(2, 200, "b"), (3, 300, "c"), (1, 100, "a")], schema)
    assert run() == [1, 2, 3]


@pytest.fixture()
def stored(spark, tmp_path):
    out = str(tmp_path / "state")
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.parquet(f"{out}/batch={n}")
    return out


def state(spark, out):
    return {r["k"]: r["v"] for r in keyed.current_state(spark, out, ["k"]).collect()}


def test_merged_batches_may_be_removed(spark, stored):
    assert state(spark, stored) == {"a": 2, "b": 1}
    assert keyed.compact_state(spark, stored, ["k"]) == 1
    for n in (0, 1):
        shutil.rmtree(f"{stored}/batch={n}")
    assert state(spark, stored) == {"a": 2, "b": 1}
    assert keyed.compact_state(spark, stored, ["k"]) == 1
    spark.createDataFrame([("c", 9)], "k string, v long").coalesce(1).write.parquet(f"{stored}/batch=2")
    assert state(spark, stored) == {"a": 2, "b": 1, "c": 9}
    assert keyed.compact_state(spark, stored, ["k"]) == 2
    shutil.rmtree(stored)
    assert state(spark, stored) == {"a": 2, "b": 1, "c": 9}


def test_no_state_is_said(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing is stored"):
        keyed.current_state(spark, str(tmp_path / "none"), ["k"])


def test_plain_counts_equal_the_windows(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    append(spark, log, [(i * 60, float(i % 5)) for i in range(600)])
    append(spark, log, [(10**6, 0.0)])
    append(spark, log, [(10**6 + 1, 0.0)])
    events = keyed.read_log(spark, log, QUERY_EVENT, files_per_batch=1)
    keyed.store_appended(keyed.windowed_latency(events), out, str(tmp_path / "offsets")).awaitTermination()
    got = {r["window_start"]: r["n_requests"] for r in spark.read.parquet(out).collect()}
    assert got == {h * 3600: 60 for h in range(10)}
    assert spark.read.json(log).agg(F.count("*")).first()[0] == 602


def test_events_of_a_log_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(seq):
        made.add(1)
        return seq

    real = stream_queries.vote_events
    monkeypatch.setattr(stream_queries, "vote_events", lambda s, sf: real(s, sf).withColumn("seq", seen("seq")))
    sf = "/root/testdata/sf0.001"
    assert stream_queries.stream_vote_log(spark, sf).count() == real(spark, sf).count() == made.value
