"""Checked queries over events: votes, query logs, latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.text import query_hash
from findery.operators import logs, votes
from findery.plans import sqltext as Q
from findery.plans.registry import query
from findery.plans.text_queries import CONTEXT_HASH_SQL, EVENT_CONTEXT_SQL, event_context
from findery.schemas import QUERY_EVENT, VOTE_EVENT
from findery.session import scratch_path, table


def raw_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as votes; users divisible by 20 sent no query, sign-ups carry no flag."""
    kind = F.col("event_type")
    slot = F.pmod("user_id", F.lit(20))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("ts"),
        F.when(slot == 0, F.lit("")).otherwise(F.concat(F.lit("  Query "), slot, F.lit(" TEXT"))).alias("query"),
        F.get_json_object("props", "$.k").alias("passage_id"),
        F.when(kind != "signup", kind.isin("click", "purchase")).alias("relevant"),
        event_context().alias("config"),
    )


RAW_VOTES_SQL = f"""
raw_votes AS (
  SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS ts,
    CASE WHEN user_id % 20 = 0 THEN '' ELSE '  Query ' || (user_id % 20) || ' TEXT' END AS query,
    props->>'$.k' AS passage_id,
    CASE WHEN event_type <> 'signup' THEN event_type IN ('click', 'purchase') END AS relevant,
    {EVENT_CONTEXT_SQL} FROM events)"""

VOTES_SQL = RAW_VOTES_SQL + f""",
vote_events AS (
  SELECT seq, ts, sha1({Q.query_norm('query')}) AS query_hash, {Q.query_norm('query')} AS query_norm, passage_id,
    relevant, diverse_search, exact_search, "lambda", nprobe, {CONTEXT_HASH_SQL} AS ctx_hash
  FROM raw_votes WHERE query <> '' AND passage_id IS NOT NULL AND relevant IS NOT NULL),
latest AS (
  SELECT query_hash, ctx_hash, passage_id, relevant, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY query_hash, ctx_hash, passage_id ORDER BY ts DESC, seq DESC) AS n
    FROM vote_events) WHERE n = 1)"""


def vote_events(spark: SparkSession, sf: str) -> DataFrame:
    return votes.record_votes(raw_votes(spark, sf))


@query("validate_votes", f"""WITH {RAW_VOTES_SQL}
SELECT seq, CASE WHEN query = '' OR passage_id IS NULL OR relevant IS NULL THEN '{votes.REJECTED}' END AS error
FROM raw_votes""")
def validate_votes(spark, sf):
    return raw_votes(spark, sf).select("seq", votes.vote_error().alias("error"))


@query("latest_votes", f"WITH {VOTES_SQL} SELECT * FROM latest")
def latest_votes(spark, sf):
    return votes.latest_votes(vote_events(spark, sf))


@query("peek_votes", f"""WITH {VOTES_SQL},
asked AS (SELECT DISTINCT sha1({Q.query_norm('query')}) AS query_hash, passage_id FROM raw_votes),
newest AS (SELECT query_hash, passage_id, relevant, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY query_hash, passage_id ORDER BY ts DESC, seq DESC) AS n FROM vote_events)
  WHERE n = 1)
SELECT query_hash, passage_id, relevant, ts FROM asked LEFT JOIN newest USING (query_hash, passage_id)""")
def peek_votes(spark, sf):
    raw = raw_votes(spark, sf)
    asked = raw.select(query_hash(F.col("query")).alias("query_hash"), "passage_id").distinct()
    return votes.peek_votes(asked, votes.record_votes(raw))


@query("vote_queries", f"""WITH {VOTES_SQL}
SELECT query_hash, arg_min(query_norm, seq) AS query_norm FROM vote_events GROUP BY query_hash""")
def vote_queries(spark, sf):
    return votes.vote_queries(vote_events(spark, sf))


CONTEXTS_SQL = """SELECT ctx_hash, nprobe, exact_search, diverse_search, "lambda" FROM (
  SELECT *, row_number() OVER (PARTITION BY ctx_hash ORDER BY seq) AS n FROM vote_events) WHERE n = 1"""


@query("vote_contexts", f"WITH {VOTES_SQL} {CONTEXTS_SQL}")
def vote_contexts(spark, sf):
    return votes.vote_contexts(vote_events(spark, sf))


@query("vote_lookup", f"""WITH {VOTES_SQL}, contexts AS ({CONTEXTS_SQL}),
queries AS (SELECT query_hash, arg_min(query_norm, seq) AS query_norm FROM vote_events GROUP BY query_hash)
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY ts DESC, passage_id, ctx_hash) AS n FROM latest)
JOIN queries USING (query_hash) JOIN contexts USING (ctx_hash) WHERE n <= {votes.LOOKUP_LIMIT}""")
def vote_lookup(spark, sf):
    events = vote_events(spark, sf)
    return votes.vote_lookup(votes.latest_votes(events), votes.vote_queries(events), votes.vote_contexts(events))


@query("votes_of_pair", f"""WITH {VOTES_SQL}
SELECT passage_id, relevant, ts, query_hash, ctx_hash FROM latest
WHERE (query_hash, ctx_hash) IN (SELECT query_hash, min(ctx_hash) FROM vote_events GROUP BY query_hash)""")
def votes_of_pair(spark, sf):
    """The votes of one context of every query."""
    events = vote_events(spark, sf)
    asked = events.groupBy("query_hash").agg(F.min("ctx_hash").alias("ctx_hash"))
    return votes.votes_of(votes.latest_votes(events), asked)


@query("vote_log", f"""WITH {VOTES_SQL}
SELECT seq, ts, query_hash, query_norm, passage_id, relevant, nprobe, exact_search, diverse_search, "lambda"
FROM vote_events""")
def vote_log(spark, sf):
    """Votes appended to a JSON log in two writes and read back."""
    path, events = scratch_path(spark, "votes"), vote_events(spark, sf).drop("ctx_hash")
    logs.write_log(events.where("relevant"), path)
    logs.write_log(events.where("NOT relevant"), path)
    return spark.read.schema(VOTE_EVENT).json(path).select(
        "seq", "ts", "query_hash", "query_norm", "passage_id", "relevant", "config.nprobe", "config.exact_search",
        "config.diverse_search", "config.lambda")


# ---- query log ---------------------------------------------------------------------

def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.unix_timestamp("ts").alias("ts"), F.concat(F.lit(" Query  "), "user_id").alias("query"),
        event_context().alias("config"), (F.pmod("user_id", F.lit(50)) + 1).alias("n_docs"),
        (F.col("value") / 1000).alias("latency"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("long")).alias("expand_index_id"),
        F.lit(1).alias("expand_offset"), F.lit(1000).alias("K"),
    )


REQUESTS_SQL = f"""
requests AS (
  SELECT event_id, floor(epoch(ts))::BIGINT AS ts, 'query ' || user_id AS query_norm, {EVENT_CONTEXT_SQL},
    (user_id % 50 + 1)::INTEGER AS n_docs, value / 1000 AS latency, event_type <> 'error' AS ok,
    CASE WHEN event_type = 'view' THEN (props->>'$.k')::BIGINT END AS expand_index_id FROM events)"""


@query("query_log", f"""WITH {REQUESTS_SQL}
SELECT ts, sha1(query_norm) AS query_hash, query_norm, nprobe, exact_search, diverse_search, "lambda", n_docs,
  latency, expand_index_id, 1 AS expand_offset, 1000 AS K FROM requests""")
def query_log(spark, sf):
    path = scratch_path(spark, "queries")
    logs.write_log(logs.query_events(requests(spark, sf)), path)
    back = spark.read.schema(QUERY_EVENT).json(path)
    return back.select("ts", "query_hash", "query_norm", "config.nprobe", "config.exact_search",
                       "config.diverse_search", "config.lambda", "n_docs", "latency", "expand_index_id",
                       "expand_offset", "K")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("latency_stats", f"""WITH {REQUESTS_SQL}
SELECT nprobe, exact_search, diverse_search, count(*) AS n_requests, count(*) FILTER (ok) AS n_success,
  round(count(*) FILTER (ok) / sum(latency), 6) AS qps,
  round(coalesce(avg(latency) FILTER (ok), 0.0), 6) AS mean_latency,
  round(coalesce(stddev_pop(latency) FILTER (ok), 0.0), 6) AS std_latency,
  round(count(*) / (max(ts + latency) - min(ts)), 6) AS wall_qps
FROM requests GROUP BY nprobe, exact_search, diverse_search""")
def latency_stats(spark, sf):
    log = requests(spark, sf).select("config.*", "latency", "ok", "ts")
    out = logs.latency_stats(log, ["nprobe", "exact_search", "diverse_search"], start="ts")
    return _rounded(out, "qps", "mean_latency", "std_latency", "wall_qps")


@query("batch_latency_stats", """
WITH b AS (SELECT event_id // 32 AS batch_id, count(*) AS n, sum(value / 1000) AS t,
  arg_min(event_type, event_id) <> 'error' AS ok FROM events GROUP BY 1)
SELECT batch_id % 8 AS endpoint, sum(n)::BIGINT AS n_queries, round(sum(n) / sum(t) FILTER (ok), 6) AS qps,
  round(coalesce(avg(t) FILTER (ok), 0.0), 6) AS mean_batch,
  round(coalesce(stddev_pop(t) FILTER (ok), 0.0), 6) AS std_batch FROM b GROUP BY 1""")
def batch_latency_stats(spark, sf):
    """Batches of 32 requests on eight endpoints; a batch fails when its first request does."""
    batches = requests(spark, sf).groupBy(F.floor(F.col("event_id") / 32).alias("batch_id")).agg(
        F.count("*").alias("n_queries"), F.sum("latency").alias("batch_time"), F.min_by("ok", "event_id").alias("ok"))
    out = logs.batch_latency_stats(batches.withColumn("endpoint", F.pmod("batch_id", F.lit(8))), ["endpoint"])
    return _rounded(out, "qps", "mean_batch", "std_batch")


def _ms_sql(a: str, b: str) -> str:
    return f"floor((epoch_us({b}) - epoch_us({a}) + 5) / 10.0) / 100.0::DOUBLE"


@query("stage_latency", f"""
WITH r AS (SELECT event_id // 5 AS request_id,
  {', '.join(f'max(ts) FILTER (event_id % 5 = {i}) AS t{i}' for i in range(5))} FROM events GROUP BY 1)
SELECT request_id, {', '.join(f'{_ms_sql(f"t{i}", f"t{i + 1}")} AS stage_{i + 1}_ms' for i in range(4))},
  {_ms_sql('t0', 't4')} AS total_ms FROM r""")
def stage_latency(spark, sf):
    """Every five consecutive events as the five clock readings of one request."""
    step = F.pmod("event_id", F.lit(5))
    readings = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 5).alias("request_id")).agg(
        *[F.max(F.when(step == i, F.col("ts"))).alias(f"t{i}") for i in range(5)])
    return logs.stage_latency(readings, [f"t{i}" for i in range(5)], ["request_id"])


@query("weighted_stats", """
SELECT event_type, round(CASE WHEN sum(w) > 0 THEN sum(value * w) / sum(w) ELSE 0 END, 6) AS mean,
  sum(w)::BIGINT AS weight
FROM (SELECT event_type, value, CASE WHEN event_type = 'signup' THEN 0 ELSE user_id END AS w FROM events)
GROUP BY event_type""")
def weighted_stats(spark, sf):
    rows = table(spark, sf, "events").withColumn("w", F.when(F.col("event_type") == "signup", 0).otherwise(F.col("user_id")))
    return _rounded(logs.weighted_stats(rows, "event_type", "value", "w"), "mean")


@query("macro_average", """
WITH m AS (SELECT source, unnest(['quality', 'toxic']) AS metric, unnest([quality, toxic]) AS value
  FROM labels JOIN documents USING (doc_id)),
p AS (SELECT metric, source, avg(value) AS a FROM m GROUP BY metric, source)
SELECT metric, round(100 * avg(a), 6) AS macro_average, count(*) AS n_parts,
  count(*) = (SELECT count(DISTINCT source) FROM documents) AS complete FROM p GROUP BY metric""")
def macro_average(spark, sf):
    """Quality and toxicity averaged over sources, each source one part."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        "source", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (metric, value)"))
    parts = docs.select("source").distinct().count()
    return _rounded(logs.macro_average(rows, "source", "metric", "value", parts), "macro_average")
