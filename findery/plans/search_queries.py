"""Checked queries of the whole search path, on texts encoded by hashed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.qa import line_has_answer, token_line
from findery.functions.vectors import as_double
from findery.operators import pq
from findery.operators.cache import embed_with_cache, merge_cache
from findery.operators.encode import embed_texts, hashed_words
from findery.operators.kmeans import group_means
from findery.operators.metrics import hit_curve
from findery.operators.passages import bounded
from findery.operators.rerank import drop_redundant, rerank_exact, rerank_mmr
from findery.operators.topk import SCORE_DIGITS, knn_flat
from findery.plans import search as S
from findery.plans import sqltext as Q
from findery.plans.corpus_queries import PASSAGES_SQL, STRIP, passages
from findery.plans.registry import query
from findery.plans.text_queries import documents
from findery.plans.vector_queries import (
    CODES_SQL, COARSE_SQL, K, NPROBE, N_SUB, PROBES_SQL, TOPICS_SQL, _books, embeddings, hits_sql, topics,
)
from findery.schemas import REQUEST
from findery.session import scratch_path, table
from findery.streaming.requests import answer_requests

DIM, FETCH, MMR_FETCH, MMR_PICKS, LAMBDA = 64, S.FETCH_K, 50, 5, 0.5
ENCODE = {"lower": True, "normalize_text": True}


def encoder():
    return hashed_words(DIM)


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded documents, stored as the vector table a search then reads."""
    path = scratch_path(spark, "vectors")
    encoded = embed_texts(documents(spark, sf), "doc_id", "text", encoder, **ENCODE)
    encoded.withColumnRenamed("doc_id", "vec_id").write.parquet(path)
    return spark.read.parquet(path)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per benchmark passage; options vary with its id, some diverse ones lack a lambda."""
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.col("text").alias("query"), F.when(i % 4 > 0, i % 4 + 1).cast("int").alias("n_docs"),
        F.lit(None).cast("int").alias("nprobe"), (i % 2 == 0).alias("exact_search"),
        F.when(i % 5 > 0, i % 3 == 0).alias("diverse_search"),
        F.when(i % 9 > 0, F.lit(LAMBDA)).alias("lambda"), F.when(i % 4 == 1, F.lit(150)).cast("int").alias("min_words"),
    )


def asked(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = S.split_requests(requests(spark, sf))
    return valid.join(embed_texts(valid, "query_id", "query", encoder, out="query_emb", **ENCODE), "query_id")


def answers(spark: SparkSession, sf: str, with_text: bool = True) -> DataFrame:
    vectors = document_vectors(spark, sf)
    return S.search(asked(spark, sf), S.FlatIndex(vectors, SCORE_DIGITS), vectors, passages(spark, sf), FETCH, with_text)


def vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """Hashed-word vectors in SQL: ``name(key, e)``."""
    return f"""
{name}_dims AS (
  SELECT {key}, {Q.hash32('w')} % {DIM} AS d, count(*) AS c FROM (
    SELECT {key}, unnest({Q.words(Q.normalize_punctuation(f'lower({text})'))}) AS w FROM {source}) GROUP BY 1, 2),
{name} AS (
  SELECT s.{key}, list(coalesce(c, 0) / greatest(n, 1e-12) ORDER BY g.d)::DOUBLE[] AS e
  FROM {source} s CROSS JOIN range({DIM}) g(d) LEFT JOIN {name}_dims x ON x.{key} = s.{key} AND x.d = g.d
  LEFT JOIN (SELECT {key}, sqrt(sum(c * c)) AS n FROM {name}_dims GROUP BY {key}) t ON t.{key} = s.{key}
  GROUP BY s.{key})"""


REQUESTS_SQL = f"""
requests AS (
  SELECT *, CASE WHEN diverse_search AND "lambda" IS NULL THEN 'missing_lambda' END AS error FROM (
    SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 4 > 0 THEN item_id % 4 + 1 ELSE 1 END::INTEGER AS n_docs,
      32 AS nprobe, item_id % 2 = 0 AS exact_search, item_id % 5 > 0 AND item_id % 3 = 0 AS diverse_search,
      CASE WHEN item_id % 9 > 0 THEN {LAMBDA}::DOUBLE END AS "lambda",
      CASE WHEN item_id % 4 = 1 THEN 150 END AS min_words FROM benchmark))"""

DOC_VEC_SQL = vectors_sql("dvec", "documents", "doc_id", "text")
ASK_VEC_SQL = vectors_sql("qvec", "benchmark", "item_id", "text")


def _mmr_steps(pool: str, lam: str, rel: str, key: str, vec: str, picks: int) -> str:
    """Greedy picks unrolled: tables pick1..pickN of (query_id, rank, key, mmr)."""
    out = []
    for n in range(1, picks + 1):
        if n == 1:
            score = f"p.{rel}"
            body = f"SELECT p.*, {score} AS mmr FROM {pool} p"
        else:
            chosen = " UNION ALL ".join(f"SELECT query_id, {key}, {vec} FROM pick{i}" for i in range(1, n))
            body = f"""SELECT p.*, p.{lam} * p.{rel} - (1 - p.{lam}) * c.far AS mmr FROM {pool} p JOIN (
        SELECT a.query_id, a.{key}, max(coalesce(CASE WHEN list_inner_product(a.{vec}, a.{vec}) > 0
            AND list_inner_product(s.{vec}, s.{vec}) > 0 THEN list_cosine_similarity(a.{vec}, s.{vec}) END, 0)) AS far,
          bool_or(a.{key} = s.{key}) AS used
        FROM {pool} a JOIN ({chosen}) s USING (query_id) GROUP BY a.query_id, a.{key}) c
      ON c.query_id = p.query_id AND c.{key} = p.{key} WHERE NOT c.used"""
        out.append(f"""
pick{n} AS (SELECT * EXCLUDE (w) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(mmr, 9) DESC, rank) AS w FROM ({body}))
  WHERE w = 1)""")
    return ",".join(out)


FLAT_FOUND_SQL = """
scored AS (SELECT r.query_id, d.doc_id, round(list_inner_product(q.e, d.e), 9) AS score
  FROM requests r JOIN qvec q ON q.item_id = r.query_id, dvec d WHERE r.error IS NULL)"""


def answers_sql(requests_sql: str, found_sql: str, fetch: int, has_vector: str = "true") -> str:
    """Answers of requests from ``scored`` (query_id, doc_id, score): each to its own depth.

    ``has_vector`` tells which documents the second stage has a vector of.
    """
    picks = " UNION ALL ".join(
        f"SELECT query_id, {n}::BIGINT AS w, doc_id, score, exact_score, n_docs FROM pick{n}" for n in range(1, MMR_PICKS + 1))
    return f"""{requests_sql}, {DOC_VEC_SQL}, {ASK_VEC_SQL}, {PASSAGES_SQL}, {found_sql},
found AS (
  SELECT query_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
  JOIN requests USING (query_id) WHERE rank <= greatest({fetch}, n_docs)),
pool AS (
  SELECT f.*, r.n_docs, r.exact_search, r.diverse_search, r."lambda" AS lam,
    coalesce(d.e, list_transform(q.e, lambda x: 0.0)) AS e,
    CASE WHEN r.exact_search THEN CASE WHEN d.e IS NULL THEN -1.0 WHEN list_inner_product(d.e, d.e) = 0 THEN 0.0
      ELSE round(list_cosine_similarity(q.e, d.e), 9) END END AS exact_score
  FROM found f JOIN requests r USING (query_id) JOIN qvec q ON q.item_id = f.query_id
  LEFT JOIN (SELECT * FROM dvec WHERE {has_vector}) d USING (doc_id) JOIN documents t USING (doc_id)
  WHERE r.min_words IS NULL OR len({Q.words('t.text')}) >= r.min_words),
mpool AS (SELECT *, coalesce(exact_score, score) AS rel FROM pool WHERE diverse_search),
{_mmr_steps('mpool', 'lam', 'rel', 'doc_id', 'e', MMR_PICKS)},
answers AS (
  SELECT query_id, n AS rank, doc_id AS index_id, score AS retrieval_score, exact_score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY CASE WHEN exact_search THEN exact_score END DESC, rank) AS n
    FROM pool WHERE NOT diverse_search) WHERE n <= n_docs
  UNION ALL
  SELECT query_id, w, doc_id, score, exact_score FROM ({picks}) WHERE w <= n_docs)"""


ANSWERS_SQL = answers_sql(REQUESTS_SQL, FLAT_FOUND_SQL, FETCH)


@query("embed_passages", f"""WITH {DOC_VEC_SQL}
SELECT doc_id, (d - 1)::BIGINT AS d, round(x, 6) AS x FROM (
  SELECT doc_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM dvec) WHERE x > 0""")
def embed_passages(spark, sf):
    v = document_vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("d", "x"))
    return v.where("x > 0").select("doc_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("embedding_cache", f"""WITH {DOC_VEC_SQL}
SELECT doc_id, l.doc_id IS NOT NULL AS cached, round(list_sum(e), 6) AS total
FROM dvec LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)""")
def embedding_cache(spark, sf):
    """Labelled documents are cached first; the second pass encodes only the others."""
    docs, cache = documents(spark, sf), scratch_path(spark, "cache")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    embed_with_cache(labelled, cache, encoder, "doc_id", **ENCODE)
    full = embed_with_cache(docs, cache, encoder, "doc_id", **ENCODE)
    total = F.aggregate(as_double(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return full.select("doc_id", "cached", F.round(total, 6).alias("total"))


@query("embedding_cache_merged", f"""WITH {DOC_VEC_SQL}
SELECT doc_id, true AS cached, round(list_sum(e), 6) AS total FROM dvec""")
def embedding_cache_merged(spark, sf):
    """Four runs over parts that overlap, a merge of their batches, and a last run that finds everything stored."""
    docs, cache = documents(spark, sf), scratch_path(spark, "cache")
    for part in range(4):
        some = docs.where((F.pmod("doc_id", F.lit(4)) == part) | (F.pmod("doc_id", F.lit(10)) == part))
        embed_with_cache(some, cache, encoder, "doc_id", **ENCODE)
    merge_cache(spark, cache, "doc_id", fanout=4)
    full = embed_with_cache(docs, cache, encoder, "doc_id", **ENCODE)
    total = F.aggregate(as_double(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return full.select("doc_id", "cached", F.round(total, 6).alias("total"))


@query("pool_tokens", """
WITH t AS (SELECT vec_id // 16 AS seq_id, vec_id % 16 AS pos, label <> 3 AS used, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
m AS (SELECT seq_id, d, avg(x) FILTER (used) AS mean, max(x) FILTER (pos = 0) AS first FROM t GROUP BY ALL)
SELECT seq_id, d::BIGINT AS d, round(mean, 6) AS mean, round(first, 6) AS first FROM m""")
def pool_tokens(spark, sf):
    """Sixteen vectors in a row as the token states of one text; label 3 is masked out."""
    states = embeddings(spark, sf).withColumn("seq_id", F.floor(F.col("vec_id") / 16))
    mean = group_means(states.where("label <> 3"), "seq_id", "embedding").select(
        F.col("g").alias("seq_id"), F.posexplode("mean").alias("d", "mean"))
    first = states.where(F.pmod("vec_id", F.lit(16)) == 0).select(
        "seq_id", F.posexplode(as_double(F.col("embedding"))).alias("d", "first"))
    return first.join(mean, ["seq_id", "d"], "left").select(
        "seq_id", F.col("d").cast("long").alias("d"), F.round("mean", 6).alias("mean"), F.round("first", 6).alias("first"))


@query("validate_requests", f"""WITH {REQUESTS_SQL}
SELECT query_id, n_docs, nprobe, exact_search, diverse_search, error FROM requests""")
def validate_requests(spark, sf):
    valid, rejected = S.split_requests(requests(spark, sf))
    both = valid.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("query_id", "n_docs", "nprobe", "exact_search", "diverse_search", "error")


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("retrieval_score", F.round("retrieval_score", 6)).withColumn(
        "exact_score", F.round("exact_score", 6))


@query("search_passages", f"""WITH {ANSWERS_SQL}
SELECT query_id, rank, index_id, round(retrieval_score, 6) AS retrieval_score, round(exact_score, 6) AS exact_score,
  passage_id, {STRIP.format('text')} AS text, source, filename, position
FROM answers JOIN passages USING (index_id)""")
def search_passages(spark, sf):
    return _scores(answers(spark, sf)).select(
        "query_id", "rank", "index_id", "retrieval_score", "exact_score", "passage_id", "text", "source", "filename",
        "position")


@query("fill_check", f"""WITH {ANSWERS_SQL}
SELECT r.query_id, count(a.index_id) AS n_found, count(a.index_id) >= any_value(r.n_docs) AS filled
FROM requests r LEFT JOIN answers a USING (query_id) WHERE r.error IS NULL GROUP BY r.query_id""")
def fill_check(spark, sf):
    valid, _ = S.split_requests(requests(spark, sf))
    return S.fill_check(answers(spark, sf, with_text=False), valid)


@query("search_response", f"""WITH {ANSWERS_SQL}
SELECT query_id, count(*) AS n, string_agg(round(retrieval_score, 4)::VARCHAR, ',' ORDER BY rank) AS scores,
  '[' || string_agg(json_object('index_id', index_id, 'passage_id', passage_id, 'source', source)::VARCHAR, ',' ORDER BY rank)
    || ']' AS passages
FROM answers JOIN passages USING (index_id) GROUP BY query_id""")
def search_response(spark, sf):
    nested = S.nested_response(answers(spark, sf), ["index_id", "passage_id", "source"])
    return nested.select(
        "query_id", F.size("passages").cast("long").alias("n"),
        F.array_join(F.transform("scores", lambda s: F.round(s, 4).cast("string")), ",").alias("scores"),
        F.to_json("passages").alias("passages"))


@query("stream_search", f"""WITH {ANSWERS_SQL}
SELECT query_id, rank, index_id, round(retrieval_score, 6) AS retrieval_score, passage_id
FROM answers JOIN passages USING (index_id)""")
def stream_search(spark, sf):
    """The same requests as a stream of JSON files, several micro-batches."""
    log, out = scratch_path(spark, "requests"), scratch_path(spark, "answers")
    requests(spark, sf).repartition(4).write.json(log)
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 2).json(log)
    vectors = document_vectors(spark, sf)
    answer_requests(stream, S.FlatIndex(vectors, SCORE_DIGITS), vectors, passages(spark, sf), encoder, out,
                    scratch_path(spark, "request-offsets"), FETCH, **ENCODE).awaitTermination()
    done = spark.read.parquet(f"{out}/answers")
    return done.select("query_id", "rank", "index_id", F.round("retrieval_score", 6).alias("retrieval_score"), "passage_id")


# ---- reranking on topic hits -------------------------------------------------------

@query("rerank_exact", f"""WITH {TOPICS_SQL}, {COARSE_SQL}, {CODES_SQL}, {PROBES_SQL},
parts AS (
  SELECT p.query_id, k.vec_id, p.list_id, p.q,
    sum(list_inner_product(p.q[k.m * {64 // N_SUB} + 1:(k.m + 1) * {64 // N_SUB}], k.w)) AS s
  FROM probes p JOIN codes k USING (list_id) GROUP BY p.query_id, k.vec_id, p.list_id, p.q),
top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT x.query_id, x.vec_id, x.q, round(x.s + list_inner_product(x.q, c.c), 9) AS score
    FROM parts x JOIN coarse c USING (list_id))) WHERE rank <= {K}),
cos AS (SELECT t.query_id, t.vec_id, t.rank, t.score, round(list_cosine_similarity(t.q, v.embedding::DOUBLE[]), 9) AS ex
  FROM top t JOIN embeddings v USING (vec_id))
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY ex DESC, rank) AS rank,
  round(score, 6) AS retrieval_score, round(ex, 6) AS exact_score FROM cos""")
def rerank_exact_codes(spark, sf):
    """Candidates found on codes, reordered by the exact cosine."""
    index, books = _books(spark, sf)
    asked_topics = topics(spark, sf)
    codes = pq.encode(index.postings, index.centroids, books, digits=SCORE_DIGITS)
    hits = pq.knn_ivfpq(asked_topics, codes, index.centroids, books, K, NPROBE, digits=SCORE_DIGITS)
    near = hits.join(embeddings(spark, sf).select("vec_id", "embedding"), "vec_id").join(asked_topics, "query_id")
    out = rerank_exact(near, "query_emb", "embedding")
    return out.select("query_id", "vec_id", "rank", F.round("score", 6).alias("retrieval_score"),
                      F.round("exact_score", 6).alias("exact_score"))


@query("rerank_mmr", f"""WITH {TOPICS_SQL}, {hits_sql(MMR_FETCH)},
pool AS (SELECT h.*, v.embedding::DOUBLE[] AS e, {LAMBDA} AS lam FROM hits h JOIN embeddings v USING (vec_id)),
{_mmr_steps('pool', 'lam', 'score', 'vec_id', 'e', MMR_PICKS)}
{' UNION ALL '.join(f'SELECT query_id, vec_id, {n}::BIGINT AS rank, round(mmr, 6) AS mmr_score FROM pick{n}' for n in range(1, MMR_PICKS + 1))}""")
def rerank_mmr_topics(spark, sf):
    vectors = embeddings(spark, sf)
    near = knn_flat(topics(spark, sf), vectors, MMR_FETCH, digits=SCORE_DIGITS).join(vectors.select("vec_id", "embedding"), "vec_id")
    out = rerank_mmr(near, "embedding", "score", LAMBDA, limit=MMR_PICKS, digits=SCORE_DIGITS)
    return out.withColumn("mmr_score", F.round("mmr_score", 6))


@query("rerank_mmr_full", f"""WITH RECURSIVE {TOPICS_SQL}, {hits_sql(FETCH)},
pool AS (SELECT h.query_id, h.vec_id, h.rank, h.score AS rel, v.embedding AS e FROM hits h JOIN embeddings v USING (vec_id)),
walk AS (
  SELECT query_id, vec_id, rank, rel, e, -2::DOUBLE AS far, 1::BIGINT AS step, rel AS mmr,
    row_number() OVER (PARTITION BY query_id ORDER BY round(rel, 9) DESC, rank) = 1 AS picked FROM pool
  UNION ALL
  SELECT query_id, vec_id, rank, rel, e, far, step, mmr,
    row_number() OVER (PARTITION BY query_id ORDER BY round(mmr, 9) DESC, rank) = 1 AS picked
  FROM (SELECT *, {LAMBDA} * rel - (1 - {LAMBDA}) * far AS mmr FROM (
    SELECT w.query_id, w.vec_id, w.rank, w.rel, w.e, w.step + 1 AS step,
      greatest(w.far, list_cosine_similarity(w.e::DOUBLE[], p.e::DOUBLE[])) AS far
    FROM walk w JOIN walk p ON p.query_id = w.query_id AND p.picked WHERE NOT w.picked)))
SELECT query_id, vec_id, step AS rank, round(mmr, 3) AS mmr_score FROM walk WHERE picked""")
def rerank_mmr_full(spark, sf):
    """The whole order of a deep candidate set."""
    vectors = embeddings(spark, sf)
    near = knn_flat(topics(spark, sf), vectors, FETCH, digits=SCORE_DIGITS).join(vectors.select("vec_id", "embedding"), "vec_id")
    return rerank_mmr(near, "embedding", "score", LAMBDA, digits=SCORE_DIGITS).withColumn("mmr_score", F.round("mmr_score", 3))


# ---- text hits ---------------------------------------------------------------------

TOP = 20

TEXT_HITS_SQL = f"""{DOC_VEC_SQL}, {ASK_VEC_SQL},
thits AS (
  SELECT query_id, rank, doc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT q.item_id AS query_id, d.doc_id, round(list_inner_product(q.e, d.e), 9) AS score FROM qvec q, dvec d))
  WHERE rank <= {TOP})"""


def text_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Best documents of every benchmark passage, with both texts."""
    items = table(spark, sf, "benchmark")
    ask = embed_texts(items, "item_id", "text", encoder, out="query_emb", **ENCODE).withColumnRenamed("item_id", "query_id")
    hits = knn_flat(ask, document_vectors(spark, sf), TOP, digits=SCORE_DIGITS).drop("score")
    texts = documents(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    answer = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    return texts.join(bounded(hits, items.count() * TOP), "vec_id").join(answer, "query_id")


@query("drop_redundant", f"""WITH RECURSIVE {TEXT_HITS_SQL},
cand AS (SELECT query_id, rank, doc_id, text FROM thits JOIN documents USING (doc_id)),
walk AS (
  SELECT query_id, rank, doc_id, [text] AS kept, true AS keep FROM cand WHERE rank = 1
  UNION ALL
  SELECT query_id, rank, doc_id, CASE WHEN keep THEN list_append(kept, text) ELSE kept END, keep FROM (
    SELECT c.query_id, c.rank, c.doc_id, c.text, w.kept,
      len(list_filter(w.kept, lambda t: contains(t, c.text) OR contains(c.text, t))) = 0 AS keep
    FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.rank = w.rank + 1))
SELECT query_id, doc_id, rank FROM walk WHERE keep""")
def drop_redundant_hits(spark, sf):
    return drop_redundant(text_hits(spark, sf)).withColumnRenamed("vec_id", "doc_id")


def judged_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = line_has_answer(token_line(F.col("text")), token_line(F.col("answer")))
    return text_hits(spark, sf).select("query_id", "rank", F.col("vec_id").alias("doc_id"), found.alias("hit"))


JUDGED_SQL = f"""{TEXT_HITS_SQL},
judged AS (SELECT h.query_id, h.rank, h.doc_id,
    {Q.token_line('b.text')} = chr(1) OR contains({Q.token_line('d.text')}, {Q.token_line('b.text')}) AS hit
  FROM thits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id)"""


@query("has_answer", f"WITH {JUDGED_SQL} SELECT query_id, rank, doc_id, hit FROM judged")
def has_answer_hits(spark, sf):
    return judged_hits(spark, sf)


@query("topk_hits", f"""WITH {JUDGED_SQL},
firsts AS (SELECT query_id, min(rank) FILTER (hit) AS best FROM judged GROUP BY query_id)
SELECT k, count(best) FILTER (best <= k) AS n_hits, count(*) AS n_questions
FROM range(1, {TOP + 1}) r(k), firsts GROUP BY k""")
def topk_hits(spark, sf):
    return hit_curve(judged_hits(spark, sf), TOP)
