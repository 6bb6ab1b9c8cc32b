"""Relevance votes: validation, keyed latest state, dimension tables and lookups.

Votes arrive append-only. ``seq`` is the arrival number and settles votes of the
same second. Every "latest" and "first" is a partial aggregation, so a query or
passage with a third of all votes costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.context import context_hash
from findery.functions.text import normalize_query

REJECTED = "Missing query, passage_id, or relevant"
LOOKUP_LIMIT = 50
SEQ_SPAN = 10**18
KEYS = ["query_hash", "ctx_hash", "passage_id"]


def vote_error() -> Column:
    """Message for a vote without query, passage or flag; null when it is fine."""
    empty = F.coalesce(F.col("query"), F.lit("")) == ""
    return F.when(empty | F.col("passage_id").isNull() | F.col("relevant").isNull(), F.lit(REJECTED))


def record_votes(raw: DataFrame) -> DataFrame:
    """Log events of the valid votes.

    Takes ``seq, ts, query, passage_id, relevant, config``; ``config`` is a
    canonical context.
    """
    norm = normalize_query(F.col("query"))
    return raw.where(vote_error().isNull()).select(
        "seq", F.col("ts").cast("long").alias("ts"),
        F.sha1(F.encode(norm, "UTF-8")).alias("query_hash"), norm.alias("query_norm"),
        F.col("passage_id").cast("string").alias("passage_id"), "relevant", "config",
        context_hash(F.col("config")).alias("ctx_hash"),
    )


def arrival() -> Column:
    """(ts, seq) as one number, so that the newest vote is kept in a hash aggregation."""
    wide = "decimal(19,0)"
    return F.col("ts").cast(wide) * F.lit(SEQ_SPAN).cast(wide) + F.col("seq").cast(wide)


def _latest(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by("relevant", arrival()).alias("relevant"), F.max("ts").alias("ts"))


def latest_votes(events: DataFrame) -> DataFrame:
    """Newest vote per (query, context, passage)."""
    return _latest(events, KEYS)


def latest_votes_any_context(events: DataFrame) -> DataFrame:
    """Newest vote per (query, passage) whatever the context was."""
    return _latest(events, ["query_hash", "passage_id"])


def peek_votes(asked: DataFrame, events: DataFrame) -> DataFrame:
    """The newest vote for each asked (query_hash, passage_id); null when there is none."""
    return asked.join(latest_votes_any_context(events), ["query_hash", "passage_id"], "left")


def vote_queries(events: DataFrame) -> DataFrame:
    """One row per query hash; the first arrival wins."""
    spellings = events.groupBy("query_hash", "query_norm").agg(F.min("seq").alias("seq"))
    return spellings.groupBy("query_hash").agg(F.min_by("query_norm", "seq").alias("query_norm"))


def vote_contexts(events: DataFrame) -> DataFrame:
    """One row per context hash; the first arrival wins."""
    fields = ["nprobe", "exact_search", "diverse_search", "lambda"]
    seen = events.select("ctx_hash", "seq", *[f"config.{c}" for c in fields])
    spellings = seen.groupBy("ctx_hash", *fields).agg(F.min("seq").alias("seq"))
    first = spellings.groupBy("ctx_hash").agg(F.min_by(F.struct(*fields), "seq").alias("c"))
    return first.select("ctx_hash", "c.*")


def votes_of(votes: DataFrame, asked: DataFrame) -> DataFrame:
    """Votes of the asked (query_hash, ctx_hash) pairs."""
    return votes.join(asked, ["query_hash", "ctx_hash"], "left_semi").select("passage_id", "relevant", "ts", *KEYS[:2])


def vote_lookup(votes: DataFrame, queries: DataFrame, contexts: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Readable votes, the newest ``limit`` per query.

    The cut is made before the joins, so they see at most ``limit`` rows a query.
    """
    w = Window.partitionBy("query_hash").orderBy(F.col("ts").desc(), "passage_id", "ctx_hash")
    newest = votes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return newest.join(queries, "query_hash").join(contexts, "ctx_hash")
