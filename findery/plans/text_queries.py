"""Checked queries over whole texts: normalisers, tokens, answer matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import text as T
from findery.functions.context import canonical_context, context_hash
from findery.functions.qa import exact_match, token_f1
from findery.plans import sqltext as Q
from findery.plans.registry import query
from findery.session import spread, table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# Letters swapped for typographic characters, so that the punctuation rule has work to do.
PLAIN, FANCY = "bwpkdhg", "–“’…⁗⁄­"
FANCY_SQL = f"translate(text, '{PLAIN}', {Q.lit(FANCY)})"


@query("normalize_query", f"SELECT conv_id, turn, {Q.query_norm('text')} AS query_norm FROM conversations")
def normalize_query(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.normalize_query(F.col("text")).alias("query_norm"))


@query("query_hash", f"SELECT conv_id, turn, sha1({Q.query_norm('text')}) AS query_hash FROM conversations")
def query_hash(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.query_hash(F.col("text")).alias("query_hash"))


def event_context():
    """Search context of an event: some fields missing, lambdas on exact sixteenths."""
    return canonical_context(
        F.when(F.pmod("user_id", F.lit(3)) > 0, F.pmod("user_id", F.lit(3)) * 32),
        F.when(F.col("event_type") != "error", F.col("event_type") == "click"),
        F.col("event_type").isin("view", "purchase"),
        F.pmod("event_id", F.lit(17)) / 16,
    )


EVENT_CONTEXT_SQL = """
  event_type IN ('view', 'purchase') AS diverse_search,
  CASE WHEN event_type <> 'error' THEN event_type = 'click' END AS exact_search,
  CASE WHEN event_type IN ('view', 'purchase') THEN round((event_id % 17) / 16.0::DOUBLE, 2) END AS "lambda",
  CASE WHEN user_id % 3 > 0 THEN (user_id % 3 * 32)::INTEGER END AS nprobe"""

CONTEXT_HASH_SQL = """sha1('{' || concat_ws(',', '"diverse_search":' || diverse_search,
  '"exact_search":' || exact_search, '"lambda":' || "lambda", '"nprobe":' || nprobe) || '}')"""


@query("canonical_context", f"SELECT event_id, {EVENT_CONTEXT_SQL} FROM events")
def canonical_context_events(spark, sf):
    return table(spark, sf, "events").select("event_id", event_context().alias("c")).select("event_id", "c.*")


@query("context_hash", f"""SELECT event_id, {CONTEXT_HASH_SQL} AS ctx_hash
FROM (SELECT event_id, {EVENT_CONTEXT_SQL} FROM events)""")
def context_hash_events(spark, sf):
    return table(spark, sf, "events").select("event_id", context_hash(event_context()).alias("ctx_hash"))


@query("normalize_text", f"SELECT doc_id, {Q.normalize_punctuation(FANCY_SQL)} AS text FROM documents")
def normalize_text(spark, sf):
    fancy = F.translate("text", PLAIN, FANCY)
    return documents(spark, sf).select("doc_id", T.normalize_punctuation(fancy).alias("text"))


@query("normalize_answer", f"SELECT doc_id, {Q.normalize_answer('text')} AS text FROM documents")
def normalize_answer(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize_answer(F.col("text")).alias("text"))


@query("normalize_articles", f"SELECT doc_id, {Q.drop_articles('text')} AS text FROM documents")
def normalize_articles(spark, sf):
    return documents(spark, sf).select("doc_id", T.drop_articles(F.col("text")).alias("text"))


@query("extract_keywords", f"""SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS keywords
FROM (SELECT doc_id, {Q.keywords('text')} AS k FROM documents)""")
def extract_keywords(spark, sf):
    k = documents(spark, sf).select("doc_id", T.extract_keywords(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("keywords"))


@query("simple_tokenize", f"""SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, list_transform({Q.tokens('text')}, lambda x: lower(x)) AS t FROM documents)""")
def simple_tokenize(spark, sf):
    t = documents(spark, sf).select("doc_id", T.tokens(F.col("text"), uncased=True).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("nfd", f"SELECT doc_id, {Q.nfd('text')} AS text FROM documents")
def nfd(spark, sf):
    return documents(spark, sf).select("doc_id", T.nfd("text").alias("text"))


@query("title_text", """SELECT doc_id, CASE WHEN lang = 'en' THEN source || ' ' || text ELSE text END AS passage
FROM documents""")
def title_text(spark, sf):
    title = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    return documents(spark, sf).select("doc_id", T.title_text(title, F.col("text")).alias("passage"))


@query("source_label", """SELECT doc_id, source AS label,
  CASE WHEN lang = 'en' THEN source ELSE 'unknown' END AS strict_label FROM documents""")
def source_label(spark, sf):
    name = F.when(F.col("lang") == "en", F.concat("source", F.lit("--raw_passages_0-0-of-1.jsonl")))
    name = name.otherwise(F.col("source"))
    return documents(spark, sf).select("doc_id", T.source_label(name).alias("label"),
                                       T.source_label(name, strict=True).alias("strict_label"))


@query("filter_min_words", f"""SELECT doc_id, len({Q.words('text')}) AS n_words FROM documents
WHERE len({Q.words('text')}) >= 100""")
def filter_min_words(spark, sf):
    d = documents(spark, sf).where(T.has_min_words(F.col("text"), F.lit(100)))
    return d.select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("norm_ids", "SELECT doc_id AS number_id, source || '/' || doc_id AS text_id FROM documents")
def norm_ids(spark, sf):
    d = documents(spark, sf).withColumn("name", F.concat_ws("/", "source", "doc_id"))
    return d.select(T.normalize_id(d, "doc_id").alias("number_id"), T.normalize_id(d, "name").alias("text_id"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns against the two turns that follow; every third conversation repeats itself."""
    c = table(spark, sf, "conversations")
    at = lambda n: c.select("conv_id", (F.col("turn") - n).alias("turn"), F.col("text").alias(f"t{n}"))
    near = c.where("role = 'assistant'").join(at(1), ["conv_id", "turn"], "left").join(at(2), ["conv_id", "turn"], "left")
    echo = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("The "), "text", F.lit(" !")))
    truths = F.filter(F.array("t1", "t2", echo), lambda t: t.isNotNull())
    return near.select("conv_id", "turn", "text", truths.alias("truths")).where(F.size("truths") > 0)


PREDICTIONS_SQL = """
preds AS (
  SELECT * FROM (
    SELECT c.conv_id, c.turn, c.text, list_filter([a.text, b.text,
      CASE WHEN c.conv_id % 3 = 0 THEN 'The ' || c.text || ' !' END], lambda t: t IS NOT NULL) AS truths
    FROM conversations c
    LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
    LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn + 2
    WHERE c.role = 'assistant') WHERE len(truths) > 0)"""


@query("exact_match", f"""WITH {PREDICTIONS_SQL}, t AS (SELECT conv_id, turn, text, unnest(truths) AS truth FROM preds)
SELECT conv_id, turn, bool_or({Q.normalize_answer('text')} = {Q.normalize_answer('truth')}) AS matched
FROM t GROUP BY conv_id, turn""")
def exact_match_turns(spark, sf):
    p = predictions(spark, sf)
    return p.select("conv_id", "turn", exact_match(F.col("text"), F.col("truths")).alias("matched"))


@query("token_f1", f"""WITH {PREDICTIONS_SQL},
t AS (SELECT conv_id, turn, text, unnest(truths) AS truth, generate_subscripts(truths, 1) AS n FROM preds),
w AS (SELECT conv_id, turn, n, {Q.words(Q.normalize_answer('text'))} AS a,
  {Q.words(Q.normalize_answer('truth'))} AS b FROM t),
ca AS (SELECT conv_id, turn, n, x, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(a) AS x FROM w) GROUP BY ALL),
cb AS (SELECT conv_id, turn, n, x, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(b) AS x FROM w) GROUP BY ALL),
s AS (SELECT conv_id, turn, n, sum(least(ca.c, cb.c)) AS same FROM ca JOIN cb USING (conv_id, turn, n, x) GROUP BY ALL)
SELECT conv_id, turn, round(max(CASE WHEN coalesce(same, 0) = 0 THEN 0.0 ELSE
  2.0 * (same / len(a)::DOUBLE) * (same / len(b)::DOUBLE) / (same / len(a)::DOUBLE + same / len(b)::DOUBLE) END), 6)::DOUBLE AS f1
FROM w LEFT JOIN s USING (conv_id, turn, n) GROUP BY conv_id, turn""")
def token_f1_turns(spark, sf):
    p = predictions(spark, sf)
    return p.select("conv_id", "turn", F.round(token_f1(F.col("text"), F.col("truths")), 6).alias("f1"))
