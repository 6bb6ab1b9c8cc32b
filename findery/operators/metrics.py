"""Retrieval metrics from a run and relevance judgements.

Conventions: ``run(query_id, doc_id, rank)`` with 1-based ranks and no repeated
document; ``qrels(query_id, doc_id, rel)``, where a missing pair counts as grade 0
and a grade above 0 as relevant. Queries without a relevant document are left
out; a query that retrieved nothing scores 0. Gains are linear in the grade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ndcg", "map", "recall", "precision", "mrr", "recall_cap", "hole")


def without_self(run: DataFrame) -> DataFrame:
    """Drop a query's own document and close the gap in the ranks."""
    w = Window.partitionBy("query_id").orderBy("rank")
    others = run.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))
    return others.withColumn("rank", F.row_number().over(w).cast("long"))


def _ideal(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Number of relevant documents and ideal DCG per cut.

    Judgements are first counted per grade, so a query with very many of them
    costs one row per grade, not a sort of all.
    """
    grades = qrels.where("rel > 0").groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.col("rel").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = grades.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    last = F.least(F.col("before") + F.col("n"), F.lit(max(ks)))
    spots = F.when(F.col("before") < max(ks), F.sequence(F.col("before") + 1, last)).otherwise(
        F.array().cast("array<bigint>"))
    # sum of 1/log2(position+1) over the positions a grade fills, for every cut
    def gain(k: int) -> Column:
        weights = F.aggregate(F.filter(spots, lambda p: p <= k), F.lit(0.0),
                              lambda a, p: a + F.lit(1.0) / F.log2(p + 1))
        return weights * F.col("rel")

    per_k = placed.groupBy("query_id").agg(
        F.sum("n").alias("n_rel"), *[F.sum(gain(k)).alias(f"_i{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_i{k}").alias("idcg")) for k in ks]))
    return per_k.select("query_id", "n_rel", pairs.alias("_p")).select("query_id", "n_rel", "_p.k", "_p.idcg")


def evaluate_run(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """All metrics per (query_id, k); unused ones are pruned by the optimiser."""
    head = run.where(F.col("rank") <= max(ks)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    grades = qrels.select("query_id", "doc_id", "rel")
    judged = qrels.select("doc_id").distinct().withColumn("_known", F.lit(True))
    graded = head.join(grades, ["query_id", "doc_id"], "left").join(judged, "doc_id", "left")
    rel = F.coalesce(F.col("rel"), F.lit(0))
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    graded = graded.select(
        "query_id", "rank", rel.alias("rel"), (rel > 0).cast("int").alias("hit"),
        F.col("_known").isNull().cast("int").alias("unknown"),
    ).withColumn("precision_here", F.sum("hit").over(seen) / F.col("rank"))
    cuts = F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))
    sums = graded.withColumn("k", cuts).where("rank <= k").groupBy("query_id", "k").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("precision_here") * F.col("hit")).alias("ap"),
        F.sum("hit").alias("hits"), F.sum("unknown").alias("holes"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
    )
    full = _ideal(qrels, ks).join(sums, ["query_id", "k"], "left")
    hits = F.coalesce("hits", F.lit(0))
    return full.select(
        "query_id", "k",
        (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
        (F.coalesce("ap", F.lit(0.0)) / F.col("n_rel")).alias("map"),
        (hits / F.col("n_rel")).alias("recall"),
        (hits / F.col("k")).alias("precision"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        (hits / F.least("n_rel", "k")).alias("recall_cap"),
        (F.coalesce("holes", F.lit(0)) / F.col("k")).alias("hole"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Mean over the queries, per cut, in percent."""
    return per_query.groupBy("k").agg(*[(100 * F.avg(m)).alias(m) for m in METRICS])


def hit_curve(judged: DataFrame, depth: int) -> DataFrame:
    """(k, n_hits, n_questions) from rows (query_id, rank, hit): questions answered within k passages.

    Questions shrink to their first hit and those to a count per rank; the running
    sum is over at most ``depth`` rows.
    """
    firsts = judged.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("best"))
    per_rank = firsts.groupBy("best").agg(F.count("*").alias("n"))
    ranks = judged.sparkSession.range(1, depth + 1).select(F.col("id").alias("k"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.partitionBy()
    spread = ranks.join(per_rank, F.col("best") == F.col("k"), "full")
    totals = spread.withColumn("n_questions", F.sum("n").over(everyone)).where(F.col("k").isNotNull())
    return totals.select("k", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n_hits"), "n_questions")
