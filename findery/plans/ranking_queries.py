"""Checked queries of retrieval metrics and ranking agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators import metrics, ranks
from findery.operators.prefix import blocked_row_number, id_block
from findery.operators.topk import SCORE_DIGITS, knn_flat
from findery.plans.registry import query
from findery.plans.vector_queries import K, TOPICS_SQL, embeddings, hits_sql, topics
from findery.session import materialize, table

KS = [1, 3, 5, 10]


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled vector is relevant to its own topic, better quality more so."""
    judged = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    return embeddings(spark, sf).join(judged, "vec_id").select(
        F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), (1 + F.col("quality")).alias("rel"))


def topic_metrics(spark: SparkSession, sf: str) -> DataFrame:
    run = knn_flat(topics(spark, sf), embeddings(spark, sf), K, digits=SCORE_DIGITS).withColumnRenamed("vec_id", "doc_id")
    return metrics.evaluate_run(run, qrels(spark, sf), KS)


METRICS_SQL = f"""{TOPICS_SQL}, {hits_sql(K)},
ks AS (SELECT unnest({KS})::BIGINT AS k),
qrels AS (SELECT e.label::BIGINT AS query_id, e.vec_id AS doc_id, 1 + l.quality AS rel
  FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id),
graded AS (SELECT h.query_id, h.rank, coalesce(q.rel, 0) AS rel, coalesce(q.rel, 0) > 0 AS hit,
    h.vec_id NOT IN (SELECT doc_id FROM qrels) AS hole
  FROM hits h LEFT JOIN qrels q ON q.query_id = h.query_id AND q.doc_id = h.vec_id),
prec AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS p FROM graded),
best AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS pos FROM qrels WHERE rel > 0),
base AS (SELECT query_id, k, count(*) AS n_rel, sum(rel / log2(pos + 1)) FILTER (pos <= k) AS idcg
  FROM best, ks GROUP BY query_id, k),
sums AS (SELECT query_id, k, sum(rel / log2(rank + 1)) AS dcg, sum(p) FILTER (hit) AS ap,
    count(*) FILTER (hit) AS hits, count(*) FILTER (hole) AS holes, min(rank) FILTER (hit) AS first_hit
  FROM prec, ks WHERE rank <= k GROUP BY query_id, k),
per_query AS (
  SELECT query_id, k, coalesce(dcg, 0) / idcg AS ndcg, coalesce(ap, 0) / n_rel AS map,
    coalesce(hits, 0) / n_rel::DOUBLE AS recall, coalesce(hits, 0) / k::DOUBLE AS precision,
    coalesce(1.0::DOUBLE / first_hit, 0) AS mrr, coalesce(hits, 0) / least(n_rel, k)::DOUBLE AS recall_cap,
    coalesce(holes, 0) / k::DOUBLE AS hole
  FROM base LEFT JOIN sums USING (query_id, k))"""


def _register(metric: str) -> None:
    @query(f"{metric}_at_k", f"WITH {METRICS_SQL} SELECT query_id, k, round({metric}, 6)::DOUBLE AS {metric} FROM per_query")
    def one(spark, sf):
        return topic_metrics(spark, sf).select("query_id", "k", F.round(metric, 6).alias(metric))


for _metric in metrics.METRICS:
    _register(_metric)


@query("mean_metrics", f"""WITH {METRICS_SQL}
SELECT k, {', '.join(f'round(100 * avg({m}), 6)::DOUBLE AS {m}' for m in metrics.METRICS)} FROM per_query GROUP BY k""")
def mean_metrics(spark, sf):
    out = metrics.mean_metrics(topic_metrics(spark, sf))
    return out.select("k", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


# ---- agreement of orders -----------------------------------------------------------

def user_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events: gold order by id, predicted order by value."""
    events = table(spark, sf, "events").select("user_id", "event_id", "value").withColumn("_b", id_block("event_id"))
    items = blocked_row_number(events, ["user_id"], "_b", ["event_id"], "_n").select(
        "user_id", (F.col("_n") - 1).alias("item"), "value")
    return ranks.ranking_from_scores(items, "user_id", "item", "value")


RANKING_SQL = """
items AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS val FROM events),
ranking AS (SELECT user_id, val, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, val) - 1 AS pos FROM items),
inv AS (SELECT a.user_id, count(b.val) AS inversions FROM ranking a
  LEFT JOIN ranking b ON a.user_id = b.user_id AND a.pos < b.pos AND a.val > b.val GROUP BY a.user_id),
topk AS (SELECT user_id, k, avg((val < k)::INTEGER) AS overlap FROM ranking, ks WHERE pos < k GROUP BY user_id, k),
depths AS (SELECT user_id, k, coalesce(max(pos) FILTER (val < k) + 1, count(*)) AS depth FROM ranking, ks GROUP BY user_id, k)"""
KS_SQL = f"ks AS (SELECT unnest({KS})::BIGINT AS k)"


@query("rank_inversions", f"WITH {KS_SQL}, {RANKING_SQL} SELECT user_id, inversions FROM inv")
def rank_inversions(spark, sf):
    return ranks.inversions(user_ranking(spark, sf), "user_id")


@query("avg_topk", f"WITH {KS_SQL}, {RANKING_SQL} SELECT user_id, k, round(overlap, 6) AS overlap FROM topk")
def avg_topk(spark, sf):
    out = ranks.overlap_at(user_ranking(spark, sf), "user_id", KS)
    return out.withColumn("overlap", F.round("overlap", 6))


@query("idx_topk", f"WITH {KS_SQL}, {RANKING_SQL} SELECT user_id, k, depth FROM depths")
def idx_topk(spark, sf):
    return ranks.depth_to_cover(user_ranking(spark, sf), "user_id", KS)


@query("eval_batch", f"""WITH {KS_SQL}, {RANKING_SQL}
SELECT user_id, k, round(overlap, 6) AS overlap, depth, inversions
FROM topk JOIN depths USING (user_id, k) JOIN inv USING (user_id)""")
def eval_batch(spark, sf):
    ranking = materialize(user_ranking(spark, sf))
    return ranks.evaluate_ranking(ranking, "user_id", KS).withColumn("overlap", F.round("overlap", 6))
