"""Checked queries of searches over mixed batches and over stored, pruned indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators import ivf, pq
from findery.operators.encode import embed_texts
from findery.operators.passages import write_blocks
from findery.operators.topk import SCORE_DIGITS, Packed, list_matrix
from findery.plans import search as S
from findery.plans.corpus_queries import passages
from findery.plans.registry import query
from findery.plans.search_queries import (
    ASK_VEC_SQL, DIM, DOC_VEC_SQL, ENCODE, FLAT_FOUND_SQL, _scores, answers_sql, document_vectors, encoder,
)
from findery.session import scratch_path, table

SHALLOW, DEEP, LISTS, SUBS = 20, 60, 16, 8
WIDE = DIM // SUBS

MIXED_SQL = f"""
requests AS (
  SELECT item_id AS query_id, text AS query,
    CASE WHEN item_id % 7 = 3 THEN {DEEP} ELSE item_id % 4 + 1 END::INTEGER AS n_docs, item_id % 2 = 0 AS exact_search,
    item_id % 3 = 0 AND item_id % 7 <> 3 AS diverse_search, 0.5::DOUBLE AS "lambda", 2 * (item_id % 3 + 1) AS nprobe,
    CASE WHEN item_id % 4 = 1 THEN 150 END AS min_words, NULL AS error FROM benchmark)"""


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Deep, plain, exact and diverse requests side by side, with a probe depth of their own."""
    i = F.col("item_id")
    asked = table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.col("text").alias("query"),
        F.when(i % 7 == 3, DEEP).otherwise(i % 4 + 1).cast("int").alias("n_docs"), (i % 2 == 0).alias("exact_search"),
        ((i % 3 == 0) & (i % 7 != 3)).alias("diverse_search"), F.lit(0.5).alias("lambda"),
        (2 * (i % 3 + 1)).cast("int").alias("nprobe"), F.when(i % 4 == 1, F.lit(150)).cast("int").alias("min_words"))
    valid, _ = S.split_requests(asked)
    return valid.join(embed_texts(valid, "query_id", "query", encoder, out="query_emb", **ENCODE), "query_id")


ANSWER_ROWS_SQL = """SELECT query_id, rank, index_id, round(retrieval_score, 6) AS retrieval_score,
  round(exact_score, 6) AS exact_score, passage_id FROM answers JOIN passages USING (index_id)"""


def _rows(answers: DataFrame) -> DataFrame:
    return _scores(answers).select("query_id", "rank", "index_id", "retrieval_score", "exact_score", "passage_id")


@query("search_mixed_batch", f"""WITH {answers_sql(MIXED_SQL, FLAT_FOUND_SQL, SHALLOW, 'doc_id % 11 <> 0')}
{ANSWER_ROWS_SQL}""")
def search_mixed_batch(spark, sf):
    """A shallow fetch, some deep requests, and documents without a vector in the second stage."""
    vectors = document_vectors(spark, sf)
    second = vectors.where("vec_id % 11 <> 0")
    return _rows(S.search(mixed(spark, sf), S.FlatIndex(vectors, SCORE_DIGITS), second, passages(spark, sf), SHALLOW))


# ---- stored indexes: the first documents' vectors are centroids, their slices codewords ----

LIST_SQL = f"""
coarse AS (SELECT doc_id AS list_id, e AS c FROM dvec WHERE doc_id < {LISTS}),
owned AS (SELECT doc_id, list_id, e, c FROM (
  SELECT d.doc_id, d.e, l.list_id, l.c, row_number() OVER (PARTITION BY d.doc_id
    ORDER BY round(list_inner_product(d.e, l.c), 9) DESC, l.list_id) AS n FROM dvec d, coarse l) WHERE n = 1),
probes AS (SELECT query_id, q, list_id FROM (
  SELECT r.query_id, r.nprobe, q.e AS q, l.list_id, row_number() OVER (PARTITION BY r.query_id
    ORDER BY round(list_inner_product(q.e, l.c), 9) DESC, l.list_id) AS n
  FROM requests r JOIN qvec q ON q.item_id = r.query_id, coarse l) WHERE n <= nprobe)"""

LIST_FOUND_SQL = f"""{LIST_SQL},
scored AS (SELECT query_id, doc_id, round(list_inner_product(q, e), 9) AS score FROM probes JOIN owned USING (list_id))"""

CODE_SQL = f"""{LIST_SQL},
words AS (SELECT m, doc_id AS code, e[m * {WIDE} + 1:(m + 1) * {WIDE}] AS w
  FROM dvec, range({SUBS}) s(m) WHERE doc_id < {LISTS}),
rest AS (SELECT doc_id, list_id, m, list_transform(range(m * {WIDE} + 1, (m + 1) * {WIDE} + 1), lambda i: e[i] - c[i]) AS r
  FROM owned, range({SUBS}) s(m)),
codes AS (SELECT doc_id, list_id, m, code, w FROM (
  SELECT r.doc_id, r.list_id, r.m, w.code, w.w, row_number() OVER (PARTITION BY r.doc_id, r.m
    ORDER BY round(list_inner_product(w.w, w.w) - 2 * list_inner_product(r.r, w.w), 9), w.code) AS n
  FROM rest r JOIN words w USING (m)) WHERE n = 1)"""

CODE_FOUND_SQL = f"""{CODE_SQL},
scored AS (SELECT query_id, doc_id, round(s + list_inner_product(q, c), 9) AS score FROM (
  SELECT p.query_id, p.q, k.doc_id, k.list_id, sum(list_inner_product(p.q[k.m * {WIDE} + 1:(k.m + 1) * {WIDE}], k.w)) AS s
  FROM probes p JOIN codes k USING (list_id) GROUP BY ALL) JOIN coarse USING (list_id))"""


def _first(vectors: DataFrame) -> Packed:
    got = vectors.where(F.col("vec_id") < LISTS).toArrow().sort_by("vec_id")
    return Packed(got.column("vec_id").to_numpy(), list_matrix(got.column("embedding")))


def _books(first: Packed) -> pq.Codebooks:
    return pq.Codebooks(first.matrix.reshape(len(first.ids), SUBS, WIDE).transpose(1, 0, 2).copy())


def stored_lists(spark: SparkSession, vectors: DataFrame) -> S.ListIndex:
    """Centroids and postings written, then read back for the probe."""
    path, first = scratch_path(spark, "lists"), _first(vectors)
    ivf.write_centroids(spark, first, f"{path}-centroids")
    ivf.write_postings(ivf.build_postings(vectors, first, digits=SCORE_DIGITS), path)
    return S.ListIndex(ivf.read_centroids(spark, f"{path}-centroids"), ivf.read_postings(spark, path), SCORE_DIGITS)


def stored_codes(spark: SparkSession, vectors: DataFrame) -> S.CodeIndex:
    """Codes of the even documents, the odd ones appended; all parts written and read back."""
    path, first = scratch_path(spark, "codes"), _first(vectors)
    books = _books(first)
    old = pq.encode(ivf.build_postings(vectors.where("vec_id % 2 = 0"), first, digits=SCORE_DIGITS), first, books, digits=SCORE_DIGITS)
    ivf.write_centroids(spark, first, f"{path}-centroids")
    pq.write_codebooks(spark, books, f"{path}-books")
    ivf.write_postings(pq.append_codes(old, vectors.where("vec_id % 2 = 1"), first, books, digits=SCORE_DIGITS), path)
    return S.CodeIndex(ivf.read_centroids(spark, f"{path}-centroids"), pq.read_codebooks(spark, f"{path}-books"),
                       ivf.read_postings(spark, path), SCORE_DIGITS)


def stored_blocks(spark: SparkSession, rows: DataFrame, id_col: str) -> DataFrame:
    path = scratch_path(spark, "blocks")
    write_blocks(rows, path, id_col)
    return spark.read.parquet(path)


@query("search_lists", f"WITH {answers_sql(MIXED_SQL, LIST_FOUND_SQL, SHALLOW)} {ANSWER_ROWS_SQL}")
def search_lists(spark, sf):
    """Vectors and passages lie in blocks of ids, so the later stages read the blocks of the hits."""
    vectors = document_vectors(spark, sf)
    blocks = stored_blocks(spark, vectors, "vec_id"), stored_blocks(spark, passages(spark, sf), "index_id")
    return _rows(S.search(mixed(spark, sf), stored_lists(spark, vectors), *blocks, SHALLOW))


@query("search_codes", f"WITH {answers_sql(MIXED_SQL, CODE_FOUND_SQL, SHALLOW)} {ANSWER_ROWS_SQL}")
def search_codes(spark, sf):
    vectors = document_vectors(spark, sf)
    return _rows(S.search(mixed(spark, sf), stored_codes(spark, vectors), vectors, passages(spark, sf), SHALLOW))


@query("codes_append", f"""WITH {MIXED_SQL}, {DOC_VEC_SQL}, {ASK_VEC_SQL}, {CODE_SQL}
SELECT doc_id, list_id, string_agg(code::VARCHAR, ',' ORDER BY m) AS code FROM codes GROUP BY doc_id, list_id""")
def codes_append(spark, sf):
    codes = stored_codes(spark, document_vectors(spark, sf)).codes
    each = F.transform(F.sequence(F.lit(1), F.lit(SUBS)), lambda m: F.conv(F.hex(F.substring("code", m, F.lit(1))), 16, 10))
    return codes.select(F.col("vec_id").alias("doc_id"), "list_id", F.array_join(each, ",").alias("code"))
