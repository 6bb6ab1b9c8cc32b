"""Batch search: over-fetch, filter, rerank, truncate, fetch text.

All requests of a batch run in one plan. The nearest-neighbour stage sees ids and
vectors only; word counts filter the candidates; text is joined for the rows that
are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.text import has_min_words
from findery.functions.vectors import cosine_batch
from findery.operators import ivf, pq
from findery.operators.passages import BLOCK_COL, bounded, expand_context, fetch_passages, in_blocks
from findery.operators.rerank import rerank_mmr
from findery.operators.topk import BROADCAST_BYTES, SCORE_DIGITS, Packed, knn_flat
from findery.session import materialize

FETCH_K = 1000
#: Largest request: every task holds this many rows per query of the same depth, and a reranked
#: candidate set or a context is one group.
MAX_DOCS, MAX_OFFSET = 100_000, 1_000


@dataclass(frozen=True)
class FlatIndex:
    """Exact search over the vector table; ``digits`` as in :func:`knn_flat`."""

    vectors: DataFrame
    digits: int | None = None

    def search(self, queries: DataFrame, k: int, nprobe: int | str = ivf.DEFAULT_NPROBE) -> DataFrame:
        return knn_flat(queries, self.vectors, k, digits=self.digits)


@dataclass(frozen=True)
class ListIndex:
    """Inverted lists."""

    centroids: Packed
    postings: DataFrame
    digits: int | None = None

    def search(self, queries: DataFrame, k: int, nprobe: int | str = ivf.DEFAULT_NPROBE) -> DataFrame:
        return ivf.knn_ivf(queries, self.postings, self.centroids, k, nprobe, digits=self.digits)


@dataclass(frozen=True)
class CodeIndex:
    """Inverted lists of product-quantised codes."""

    centroids: Packed
    books: pq.Codebooks
    codes: DataFrame
    digits: int | None = None

    def search(self, queries: DataFrame, k: int, nprobe: int | str = ivf.DEFAULT_NPROBE) -> DataFrame:
        return pq.knn_ivfpq(queries, self.codes, self.centroids, self.books, k, nprobe, digits=self.digits)


Index = FlatIndex | ListIndex | CodeIndex


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with every optional field filled in."""
    defaults = {"n_docs": 1, "nprobe": ivf.DEFAULT_NPROBE, "exact_search": False, "diverse_search": False}
    out = requests
    for name, kind in {"expand_index_id": "long", "expand_offset": "int"}.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def request_error() -> Column:
    """Why a request cannot run; null when it can."""
    return (
        F.when(F.col("query").isNull() & F.col("expand_index_id").isNull(), F.lit("missing_query"))
        .when(F.col("diverse_search") & F.col("lambda").isNull(), F.lit("missing_lambda"))
        .when(~F.col("n_docs").between(1, MAX_DOCS), F.lit("bad_n_docs"))
        .when(F.col("nprobe") < 1, F.lit("bad_nprobe"))
        .when(~F.col("expand_offset").between(0, MAX_OFFSET), F.lit("bad_expand_offset"))
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the rejected carry their ``error``."""
    checked = with_defaults(requests).withColumn("error", request_error())
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def expand_requests(requests: DataFrame, passages: DataFrame) -> DataFrame:
    """Answers of the requests that name an ``expand_index_id``: its context, without scores."""
    asked = requests.where(F.col("expand_index_id").isNotNull()).select(
        "query_id", F.col("expand_index_id").alias("index_id"),
        F.coalesce("expand_offset", F.lit(1)).cast("long").alias("expand_offset"))
    return expand_context(asked, passages, "expand_offset")


def long_enough(hits: DataFrame, requests: DataFrame, passages: DataFrame, max_hits: int) -> DataFrame:
    """Hits whose passage has the words its request asks for.

    Word counts come from the table's ``n_words`` when they were stored at ingest;
    otherwise they are taken from the text of the hits, not of the corpus.
    """
    source = "n_words" if "n_words" in passages.columns else "text"
    rows = passages.select("index_id", F.col(source).alias("_s")).join(bounded(hits, max_hits), "index_id")
    rows = rows.join(requests.select("query_id", "min_words"), "query_id")
    least = F.col("min_words")
    enough = has_min_words(F.col("_s"), least) if source == "text" else (
        least.isNull() | (least <= 0) | (F.col("_s") >= least))
    return rows.where(enough).select(*hits.columns)


def with_exact_score(hits: DataFrame, requests: DataFrame, vectors: DataFrame, max_hits: int,
                     small_requests: bool) -> DataFrame:
    """Hits of exact and diverse requests with their vector and, for exact ones, the cosine to the query.

    A hit without a vector, or a NaN, counts as -1; a missing vector is nobody's neighbour in a
    diverse order. Narrow hits meet the vectors first; query vectors join afterwards, so they are
    never copied into a broadcast of hits.
    """
    ids = bounded(hits.select("index_id").distinct(), max_hits)
    near = vectors.select(F.col("vec_id").alias("index_id"), "embedding").join(ids, "index_id")
    asked = requests.select("query_id", "query_emb", "exact_search")
    rows = hits.join(F.broadcast(asked) if small_requests else asked, "query_id").join(near, "index_id", "left")
    sim = cosine_batch("query_emb", "embedding")
    safe = F.when(sim.isNull() | F.isnan(sim), F.lit(-1.0)).otherwise(F.round(sim, SCORE_DIGITS))
    nowhere = F.transform("query_emb", lambda x: F.lit(0.0))
    return rows.select(*hits.columns, F.coalesce(F.col("embedding").cast("array<double>"), nowhere).alias("embedding"),
                       F.when(F.col("exact_search"), safe).alias("exact_score"))


def retrieve(requests: DataFrame, index: Index, fetch_k: int, deepest: int) -> DataFrame:
    """Each request's own ``max(fetch_k, n_docs)`` best hits, whatever else the batch asks for.

    Requests are searched in classes of depth that double from ``fetch_k``, so one deep request
    does not make all others carry as many rows.
    """
    depth = F.greatest(F.lit(fetch_k), F.col("n_docs")).cast("long")
    asked = requests.select("query_id", "query_emb", "nprobe", depth.alias("depth"))
    found, low, high = None, 0, fetch_k
    while low < deepest:
        part = asked.where((F.col("depth") > low) & (F.col("depth") <= high))
        hits = index.search(part.drop("depth"), min(high, deepest), "nprobe").join(part.select("query_id", "depth"), "query_id")
        hits = hits.where(F.col("rank") <= F.col("depth")).drop("depth")
        found = hits if found is None else found.unionByName(hits)
        low, high = high, 2 * high
    return found.withColumnRenamed("vec_id", "index_id")


def plain_order(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """First ``n_docs`` of the requests without MMR: by exact score where there is one, then retrieval rank."""
    w = Window.partitionBy("query_id").orderBy(F.col("exact_score").desc(), F.col("rank"))
    mine = requests.where(~F.col("diverse_search")).select("query_id", "n_docs")
    ranked = scored.join(mine, "query_id").withColumn("_n", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("_n") <= F.col("n_docs")).select(
        "query_id", "index_id", F.col("_n").alias("rank"), F.col("score").alias("retrieval_score"), "exact_score")


def diverse_order(scored: DataFrame, requests: DataFrame, digits: int | None = None) -> DataFrame:
    """First ``n_docs`` of the diverse requests by MMR on the exact score, else on the retrieval score."""
    mine = requests.where("diverse_search").select("query_id", "n_docs", "lambda")
    rows = scored.join(mine, "query_id").withColumn("_rel", F.coalesce("exact_score", "score"))
    picked = rerank_mmr(rows, "embedding", "_rel", lambda_col="lambda", limit_col="n_docs", id_col="index_id",
                        keep=["score", "exact_score"], digits=digits)
    return picked.select("query_id", "index_id", "rank", F.col("score").alias("retrieval_score"), "exact_score")


def search(requests: DataFrame, index: Index, vectors: DataFrame, passages: DataFrame, fetch_k: int = FETCH_K,
           with_text: bool = True) -> DataFrame:
    """Answer a batch of valid requests (``query_emb`` included), one row per returned passage.

    Scores stay on their rows: ``retrieval_score`` from the index and, where exact search was asked
    for, ``exact_score``. What a request gets does not depend on the others of its batch: each has
    its own depth, and only exact and diverse ones meet the vectors. Stages no request needs are
    left out of the plan.
    """
    # the batch is read several times; its encoder must not run again for each
    requests = materialize(requests)
    needs = requests.agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.lit(fetch_k), "n_docs")).alias("most"), F.sum("n_docs").alias("docs"),
        F.max("n_docs").alias("k"), F.max("min_words").alias("words"), F.max(F.size("query_emb")).alias("dim"),
        F.max("exact_search").alias("exact"), F.max("diverse_search").alias("diverse")).first()
    most = needs["most"] or 0
    scored = retrieve(requests, index, fetch_k, max(fetch_k, needs["k"] or 1))
    blocked = BLOCK_COL in vectors.columns or BLOCK_COL in passages.columns
    if blocked:  # the ids found name the folders that the later stages read
        scored = materialize(scored)
        vectors = in_blocks(vectors, scored, "index_id")
        counted = in_blocks(passages, scored, "index_id")
    else:
        counted = passages
    if (needs["words"] or 0) > 0:
        scored = long_enough(scored, requests, counted, most)
    plain = scored.withColumn("exact_score", F.lit(None).cast("double"))
    if needs["exact"] or needs["diverse"]:
        small = needs["n"] * (needs["dim"] or 0) * 8 <= BROADCAST_BYTES
        weighed = F.col("exact_search") | F.col("diverse_search")
        mine = scored.join(requests.where(weighed).select("query_id"), "query_id", "left_semi")
        mine = with_exact_score(mine, requests, vectors, most, small)
        plain = plain.join(requests.where(~weighed).select("query_id"), "query_id", "left_semi")
        ranked = plain_order(plain.unionByName(mine.drop("embedding")), requests)
        if needs["diverse"]:
            ranked = ranked.unionByName(diverse_order(mine, requests, index.digits))
    else:
        ranked = plain_order(plain, requests)
    if not with_text:
        return ranked
    if blocked:
        ranked = materialize(ranked)
        passages = in_blocks(passages, ranked, "index_id")
    return fetch_passages(ranked, passages, max_hits=needs["docs"] or 0)


def fill_check(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: how many passages came back and whether that is what was asked for."""
    found = results.groupBy("query_id").agg(F.count("*").alias("n_found"))
    return requests.select("query_id", "n_docs").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
        (F.coalesce("n_found", F.lit(0)) >= F.col("n_docs")).alias("filled"),
    )


def fill_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.sum("n_found").alias("total_found"), F.bool_and("filled").alias("all_filled"))


def nested_response(results: DataFrame, fields: list[str], score: str = "retrieval_score") -> DataFrame:
    """One row per request: ``scores`` and ``passages`` arrays in rank order, and the JSON text."""
    item = F.struct("rank", F.col(score).alias("score"), F.struct(*fields).alias("passage"))
    grouped = results.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("_i"))
    return grouped.select(
        "query_id", F.transform("_i", lambda i: i["score"]).alias("scores"),
        F.transform("_i", lambda i: i["passage"]).alias("passages"),
    ).withColumn("response", F.to_json(F.struct("scores", "passages")))
