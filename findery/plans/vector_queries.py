"""Checked queries over vectors: similarity, exact and indexed search, codes, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import vectors as V
from findery.operators import ivf, pq
from findery.operators.kmeans import assign, group_means, packed_frame
from findery.operators.rerank import candidate_l2, pairwise_cosine
from findery.operators.topk import SCORE_DIGITS, Packed, knn_flat
from findery.plans.registry import query
from findery.session import scratch_path, table
from findery.sources import vectors as S

N_SHARDS, N_LISTS, NPROBE, TRAIN_STEPS = 4, 16, 4, 10
N_SUB, N_WORDS, PQ_STEPS = 8, 128, 1
#: Training takes one vector of so many.
SAMPLE_PART = 2
K = 10
#: Depth of the deep answers, and a budget of a block that all vectors as queries exceed.
DEEP_K, SMALL_BLOCK = 1000, 1 << 17


# ---- tables the queries start from -------------------------------------------------

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def sharded(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).withColumn("shard_id", F.pmod("vec_id", F.lit(N_SHARDS)).cast("int"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = group_means(embeddings(spark, sf), "label", "embedding")
    return means.select(F.col("g").alias("query_id"), F.col("mean").alias("query_emb"))


def every_vector(spark: SparkSession, sf: str) -> DataFrame:
    """As many queries as vectors: the neighbour graph."""
    return embeddings(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_emb"))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = sharded(spark, sf)
    return ivf.train_sample(rows, rows.count() // SAMPLE_PART, N_SHARDS)


def coarse(spark: SparkSession, sf: str) -> Packed:
    return ivf.train_coarse(sample(spark, sf), N_LISTS, TRAIN_STEPS, digits=SCORE_DIGITS)


def with_index(spark: SparkSession, sf: str) -> ivf.IvfIndex:
    centroids = coarse(spark, sf)
    return ivf.IvfIndex(centroids, ivf.build_postings(embeddings(spark, sf), centroids, digits=SCORE_DIGITS))


# ---- the same in SQL ---------------------------------------------------------------

TOPICS_SQL = """
topic_dims AS (
  SELECT label, d, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
  GROUP BY label, d),
topics AS (SELECT label::BIGINT AS query_id, list(m ORDER BY d) AS q FROM topic_dims GROUP BY label)"""


EVERY_SQL = "topics AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings)"


def draw_sql(seed: str, *keys: str) -> str:
    text = " || ':' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5('{seed}:' || {text}), 1, 8))::BIGINT)"


def hits_sql(k: int) -> str:
    return f"""
hits AS (
  SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT query_id, vec_id, round(list_inner_product(q, embedding::DOUBLE[]), 9) AS score
      FROM topics, embeddings))
  WHERE rank <= {k})"""


SAMPLE_SQL = f"""
train_rows AS MATERIALIZED (
  SELECT vec_id, embedding, shard_id FROM (
    SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY {draw_sql('sample', 'vec_id')}, vec_id) AS n
    FROM (SELECT vec_id, embedding, vec_id % {N_SHARDS} AS shard_id FROM embeddings))
  WHERE n <= (SELECT count(*) FROM embeddings) // {SAMPLE_PART} // {N_SHARDS})"""


def _lloyd_step(step: int) -> str:
    return f"""
own{step} AS (
  SELECT list_id, e FROM (
    SELECT t.vec_id, t.embedding::DOUBLE[] AS e, c.list_id,
      row_number() OVER (PARTITION BY t.vec_id
        ORDER BY round(list_inner_product(t.embedding::DOUBLE[], c.c), 9) DESC, c.list_id) AS r
    FROM train_rows t, cen{step} c) WHERE r = 1),
mean{step} AS (
  SELECT list_id, list(m ORDER BY d) AS c FROM (
    SELECT list_id, d, avg(x) AS m FROM (
      SELECT list_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM own{step}) GROUP BY list_id, d)
  GROUP BY list_id),
cen{step + 1} AS MATERIALIZED (
  SELECT list_id, list_transform(c, lambda x: x / n) AS c FROM (
    SELECT list_id, c, greatest(sqrt(list_inner_product(c, c)), 1e-12) AS n FROM (
      SELECT o.list_id, coalesce(n.c, o.c) AS c FROM cen{step} o LEFT JOIN mean{step} n USING (list_id))))"""


COARSE_SQL = (
    SAMPLE_SQL
    + f""",
cen0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY w, vec_id) - 1 AS list_id,
    list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS c FROM (
    SELECT vec_id, embedding::DOUBLE[] AS e, {draw_sql('coarse', 'vec_id')} AS w FROM train_rows)
  ORDER BY w, vec_id LIMIT {N_LISTS}),"""
    + ",".join(_lloyd_step(i) for i in range(TRAIN_STEPS))
    + f""",
coarse AS (SELECT list_id::BIGINT AS list_id, c FROM cen{TRAIN_STEPS}),
owned AS (
  SELECT vec_id, list_id, score FROM (
    SELECT v.vec_id, c.list_id, round(list_inner_product(v.embedding::DOUBLE[], c.c), 9) AS score,
      row_number() OVER (PARTITION BY v.vec_id
        ORDER BY round(list_inner_product(v.embedding::DOUBLE[], c.c), 9) DESC, c.list_id) AS r
    FROM embeddings v, coarse c) WHERE r = 1)"""
)

PROBES_SQL = f"""
probes AS (
  SELECT query_id, q, list_id FROM (
    SELECT t.query_id, t.q, c.list_id,
      row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(t.q, c.c), 9) DESC, list_id) AS r
    FROM topics t, coarse c) WHERE r <= {NPROBE})"""

CODES_SQL = f"""
res AS (
  SELECT o.vec_id, o.list_id, s.m, list_transform(range(s.m * {64 // N_SUB} + 1, (s.m + 1) * {64 // N_SUB} + 1),
      lambda i: v.embedding[i]::DOUBLE - c.c[i]) AS r
  FROM owned o JOIN embeddings v USING (vec_id) JOIN coarse c USING (list_id), range({N_SUB}) s(m)),
first_words AS (
  SELECT row_number() OVER (ORDER BY w, vec_id) - 1 AS code, vec_id FROM (
    SELECT vec_id, {draw_sql('codes', 'vec_id')} AS w FROM train_rows) ORDER BY w, vec_id LIMIT {N_WORDS}),
word0 AS (SELECT m, code, r AS w FROM first_words JOIN res USING (vec_id)),
code0 AS (
  SELECT vec_id, m, code, r FROM (
    SELECT x.vec_id, x.m, w.code, x.r, row_number() OVER (PARTITION BY x.vec_id, x.m
      ORDER BY round(list_inner_product(w.w, w.w) - 2 * list_inner_product(x.r, w.w), 9), w.code) AS n
    FROM res x JOIN train_rows USING (vec_id) JOIN word0 w ON x.m = w.m) WHERE n = 1),
mean_words AS (
  SELECT m, code, list(a ORDER BY d) AS w FROM (
    SELECT m, code, d, avg(x) AS a FROM (
      SELECT m, code, unnest(r) AS x, generate_subscripts(r, 1) AS d FROM code0) GROUP BY m, code, d)
  GROUP BY m, code),
words AS (SELECT o.m, o.code, coalesce(n.w, o.w) AS w FROM word0 o LEFT JOIN mean_words n USING (m, code)),
codes AS (
  SELECT vec_id, list_id, m, code, w FROM (
    SELECT x.vec_id, x.list_id, x.m, w.code, w.w, row_number() OVER (PARTITION BY x.vec_id, x.m
      ORDER BY round(list_inner_product(w.w, w.w) - 2 * list_inner_product(x.r, w.w), 9), w.code) AS n
    FROM res x JOIN words w ON x.m = w.m) WHERE n = 1)"""


# ---- similarity functions ----------------------------------------------------------

def _beside_topic(spark: SparkSession, sf: str) -> DataFrame:
    t = topics(spark, sf).withColumnRenamed("query_id", "label")
    return embeddings(spark, sf).join(t, "label")


def _pair_sql(expr: str, name: str) -> str:
    return f"""WITH {TOPICS_SQL}
SELECT vec_id, round({expr}, 6) AS {name} FROM embeddings JOIN topics ON label = query_id"""


@query("vec_dot", _pair_sql("list_inner_product(embedding::DOUBLE[], q)", "dot"))
def vec_dot(spark, sf):
    pairs = _beside_topic(spark, sf)
    return pairs.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("query_emb")), 6).alias("dot"))


@query("vec_cosine", _pair_sql("list_cosine_similarity(embedding::DOUBLE[], q)", "cosine"))
def vec_cosine(spark, sf):
    pairs = _beside_topic(spark, sf)
    return pairs.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("query_emb")), 6).alias("cosine"))


@query("vec_normalize", f"""WITH {TOPICS_SQL}
SELECT query_id, d::BIGINT AS d, round(x / sqrt(list_inner_product(q, q)), 6) AS x
FROM (SELECT query_id, q, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS d FROM topics)""")
def vec_normalize(spark, sf):
    t = topics(spark, sf).select("query_id", F.posexplode(V.unit(F.col("query_emb"))).alias("d", "x"))
    return t.select("query_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


def _spoiled(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors with every element below -0.25 lost."""
    lost = F.transform(V.as_double(F.col("embedding")),
                       lambda x: F.when(x < -0.25, F.lit(float("nan"))).otherwise(x))
    return embeddings(spark, sf).withColumn("embedding", lost)


@query("finite_vectors", """
SELECT vec_id, list_min(embedding) >= -0.25 AS finite FROM embeddings""")
def finite_vectors(spark, sf):
    return _spoiled(spark, sf).select("vec_id", V.is_finite(F.col("embedding")).alias("finite"))


@query("fp16_roundtrip", """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
s AS (SELECT *, CASE WHEN abs(x) < pow(2, -14) THEN pow(2, -24)
                     ELSE pow(2, floor(log2(abs(x))) - 10) END AS step FROM e)
SELECT vec_id, d::BIGINT AS d, round(round_even(x / step, 0) * step, 8) AS x FROM s""")
def fp16_roundtrip(spark, sf):
    half = embeddings(spark, sf).select("vec_id", V.half_precision("embedding").alias("h"))
    out = half.select("vec_id", F.posexplode("h").alias("d", "x"))
    return out.select("vec_id", F.col("d").cast("long").alias("d"), F.round(F.col("x").cast("double"), 8).alias("x"))


# ---- exact search ------------------------------------------------------------------

@query("knn_flat", f"""WITH {TOPICS_SQL}, {hits_sql(K)}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM hits""")
def knn_flat_topics(spark, sf):
    hits = knn_flat(topics(spark, sf), embeddings(spark, sf), K, digits=SCORE_DIGITS)
    return hits.withColumn("score", F.round("score", 6))


@query("knn_flat_deep", f"""WITH {EVERY_SQL}, {hits_sql(DEEP_K)}
SELECT query_id, rank, vec_id, round(score, 3) AS score FROM hits""")
def knn_flat_deep(spark, sf):
    """Deep answers to many blocks of queries in one scan."""
    hits = knn_flat(every_vector(spark, sf), embeddings(spark, sf), DEEP_K, max_bytes=SMALL_BLOCK, digits=SCORE_DIGITS)
    return hits.withColumn("score", F.round("score", 3))


@query("candidate_l2", f"""WITH {TOPICS_SQL}, {hits_sql(K)}
SELECT query_id, vec_id, round(-list_distance(q, embedding::DOUBLE[]), 6) AS neg_l2
FROM hits JOIN topics USING (query_id) JOIN embeddings USING (vec_id)""")
def candidate_l2_topics(spark, sf):
    t, e = topics(spark, sf), embeddings(spark, sf)
    scored = candidate_l2(knn_flat(t, e, K, digits=SCORE_DIGITS), t, e, max_candidates=t.count() * K)
    return scored.select("query_id", "vec_id", F.round("neg_l2", 6).alias("neg_l2"))


@query("pairwise_cosine", f"""WITH {TOPICS_SQL}, {hits_sql(K)}, p AS (
  SELECT a.query_id, a.rank, a.vec_id, b.rank AS other,
    list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c
  FROM hits a JOIN hits b ON a.query_id = b.query_id
  JOIN embeddings x ON x.vec_id = a.vec_id JOIN embeddings y ON y.vec_id = b.vec_id)
SELECT query_id, rank, vec_id, round(max(c) FILTER (other <> rank), 6) AS max_other,
  round(max(c) FILTER (other < rank), 6) AS max_earlier, round(avg(c), 6) AS mean_cosine
FROM p GROUP BY query_id, rank, vec_id""")
def pairwise_cosine_topics(spark, sf):
    e = embeddings(spark, sf)
    out = pairwise_cosine(knn_flat(topics(spark, sf), e, K, digits=SCORE_DIGITS).join(e.select("vec_id", "embedding"), "vec_id"))
    return out.select("query_id", "rank", "vec_id",
                      *[F.round(c, 6).alias(c) for c in ("max_other", "max_earlier", "mean_cosine")])


# ---- inverted lists ----------------------------------------------------------------

@query("train_sample", f"WITH {SAMPLE_SQL} SELECT shard_id::INTEGER AS shard_id, vec_id FROM train_rows")
def train_sample(spark, sf):
    return sample(spark, sf).select("shard_id", "vec_id")


@query("train_coarse", f"""WITH {COARSE_SQL}
SELECT list_id, d::BIGINT AS d, round(x, 6) AS x FROM (
  SELECT list_id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS d FROM coarse)""")
def train_coarse(spark, sf):
    frame = packed_frame(spark, coarse(spark, sf), "list_id", "centroid")
    out = frame.select("list_id", F.posexplode("centroid").alias("d", "x"))
    return out.select("list_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("ivf_assign", f"WITH {COARSE_SQL} SELECT vec_id, list_id, round(score, 6) AS score FROM owned")
def ivf_assign(spark, sf):
    out = assign(embeddings(spark, sf), coarse(spark, sf), digits=SCORE_DIGITS)
    return out.withColumn("score", F.round("score", 6))


IVF_HITS_SQL = f"""{COARSE_SQL}, {PROBES_SQL}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT p.query_id, v.vec_id, round(list_inner_product(p.q, v.embedding::DOUBLE[]), 9) AS score
    FROM probes p JOIN owned o USING (list_id) JOIN embeddings v USING (vec_id)))
WHERE rank <= {K}"""


@query("knn_ivf", f"WITH {TOPICS_SQL}, {IVF_HITS_SQL}")
def knn_ivf(spark, sf):
    index = with_index(spark, sf)
    hits = ivf.knn_ivf(topics(spark, sf), index.postings, index.centroids, K, NPROBE, digits=SCORE_DIGITS)
    return hits.withColumn("score", F.round("score", 6))


@query("knn_ivf_join", f"WITH {EVERY_SQL}, {IVF_HITS_SQL}".replace("round(score, 6)", "round(score, 3)"))
def knn_ivf_join(spark, sf):
    """More queries than a block holds: they meet the postings in cells of a list."""
    index = with_index(spark, sf)
    hits = ivf.knn_ivf(every_vector(spark, sf), index.postings, index.centroids, K, NPROBE, max_bytes=SMALL_BLOCK,
                       digits=SCORE_DIGITS)
    return hits.withColumn("score", F.round("score", 3))


@query("index_stats", f"""WITH {COARSE_SQL}
SELECT list_id, count(*) AS list_size, (SELECT count(*) FROM owned) AS n_indexed,
  (SELECT count(*) FROM embeddings) AS n_vectors,
  (SELECT count(*) FROM owned) = (SELECT count(*) FROM embeddings) AS complete
FROM owned GROUP BY list_id""")
def index_stats(spark, sf):
    return ivf.index_stats(with_index(spark, sf).postings, embeddings(spark, sf))


@query("ivf_append", f"WITH {COARSE_SQL} SELECT list_id, vec_id, vec_id % {N_SHARDS} = 3 AS appended FROM owned")
def ivf_append(spark, sf):
    """The first three shards indexed, written, and the last one appended to the files."""
    centroids, rows = coarse(spark, sf), sharded(spark, sf)
    path = scratch_path(spark, "postings")
    old, new = rows.where("shard_id < 3"), rows.where("shard_id = 3")
    ivf.write_postings(ivf.build_postings(old, centroids, digits=SCORE_DIGITS).withColumn("appended", F.lit(False)), path)
    ivf.write_postings(ivf.build_postings(new, centroids, digits=SCORE_DIGITS).withColumn("appended", F.lit(True)), path, "append")
    return spark.read.parquet(path).select(F.col("list_id").cast("long").alias("list_id"), "vec_id", "appended")


# ---- product quantisation ----------------------------------------------------------

def _books(spark, sf):
    index = with_index(spark, sf)
    learn = ivf.build_postings(sample(spark, sf), index.centroids, digits=SCORE_DIGITS)
    return index, pq.train_codebooks(learn, index.centroids, N_SUB, N_WORDS, PQ_STEPS, digits=SCORE_DIGITS)


@query("train_pq", f"""WITH {COARSE_SQL}, {CODES_SQL}
SELECT m, code, d::BIGINT AS d, round(x, 6) AS x FROM (
  SELECT m::BIGINT AS m, code, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS d FROM words)""")
def train_pq(spark, sf):
    _, books = _books(spark, sf)
    out = books.frame(spark).select("m", "code", F.posexplode("codeword").alias("d", "x"))
    return out.select("m", "code", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("pq_encode", f"""WITH {COARSE_SQL}, {CODES_SQL}
SELECT vec_id, list_id, string_agg(code::VARCHAR, ',' ORDER BY m) AS code FROM codes GROUP BY vec_id, list_id""")
def pq_encode(spark, sf):
    index, books = _books(spark, sf)
    codes = pq.encode(index.postings, index.centroids, books, digits=SCORE_DIGITS)
    each = F.transform(F.sequence(F.lit(1), F.lit(N_SUB)),
                       lambda m: F.conv(F.hex(F.substring("code", m, F.lit(1))), 16, 10))
    return codes.select("vec_id", "list_id", F.array_join(each, ",").alias("code"))


@query("pq_decode", f"""WITH {COARSE_SQL}, {CODES_SQL}
SELECT vec_id, (k.m * {64 // N_SUB} + j)::BIGINT AS d, round(k.w[j + 1] + c.c[k.m * {64 // N_SUB} + j + 1], 6) AS x
FROM codes k JOIN coarse c USING (list_id), range({64 // N_SUB}) g(j)""")
def pq_decode(spark, sf):
    index, books = _books(spark, sf)
    approx = pq.decode(pq.encode(index.postings, index.centroids, books, digits=SCORE_DIGITS), index.centroids, books)
    out = approx.select("vec_id", F.posexplode("approx").alias("d", "x"))
    return out.select("vec_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("knn_ivfpq", f"""WITH {TOPICS_SQL}, {COARSE_SQL}, {CODES_SQL}, {PROBES_SQL},
parts AS (
  SELECT p.query_id, k.vec_id, p.list_id, p.q,
    sum(list_inner_product(p.q[k.m * {64 // N_SUB} + 1:(k.m + 1) * {64 // N_SUB}], k.w)) AS s
  FROM probes p JOIN codes k USING (list_id) GROUP BY p.query_id, k.vec_id, p.list_id, p.q)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT x.query_id, x.vec_id, round(x.s + list_inner_product(x.q, c.c), 9) AS score
    FROM parts x JOIN coarse c USING (list_id)))
WHERE rank <= {K}""")
def knn_ivfpq(spark, sf):
    index, books = _books(spark, sf)
    codes = pq.encode(index.postings, index.centroids, books, digits=SCORE_DIGITS)
    hits = pq.knn_ivfpq(topics(spark, sf), codes, index.centroids, books, K, NPROBE, digits=SCORE_DIGITS)
    return hits.withColumn("score", F.round("score", 6))


# ---- shards and conversion ---------------------------------------------------------

CHUNK_SQL = f"""
numbered AS (SELECT vec_id, vec_id % {N_SHARDS} AS shard_id, embedding,
  row_number() OVER (PARTITION BY vec_id % {N_SHARDS} ORDER BY vec_id) - 1 AS chunk_id FROM embeddings)"""


@query("chunk_ids", f"WITH {CHUNK_SQL} SELECT shard_id::INTEGER AS shard_id, vec_id, chunk_id FROM numbered")
def chunk_ids(spark, sf):
    return S.chunk_ids(sharded(spark, sf)).select("shard_id", "vec_id", "chunk_id")


@query("db_ids", f"""WITH {CHUNK_SQL}
SELECT row_number() OVER (ORDER BY shard_id, chunk_id) - 1 AS index_id, shard_id::INTEGER AS shard_id, chunk_id,
  vec_id::VARCHAR AS external_id FROM numbered""")
def db_ids(spark, sf):
    """Index id of every vector beside its (shard, chunk) pair and its external id."""
    path = scratch_path(spark, "shards")
    S.write_shards(S.chunk_ids(sharded(spark, sf)), path)
    loaded = S.load_shards(spark, path, "chunk_id")
    return loaded.select("index_id", "shard_id", "chunk_id", F.col("vec_id").cast("string").alias("external_id"))


@query("load_shard", f"""WITH {CHUNK_SQL}
SELECT shard_id::INTEGER AS shard_id, row_number() OVER (ORDER BY shard_id, chunk_id) - 1 AS index_id, vec_id,
  len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM numbered""")
def load_shard(spark, sf):
    path = scratch_path(spark, "shards")
    S.write_shards(S.chunk_ids(sharded(spark, sf)), path)
    loaded = S.load_shards(spark, path, "chunk_id")
    total = F.aggregate(V.as_double(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return loaded.select("shard_id", "index_id", "vec_id", F.size("embedding").cast("long").alias("dim"),
                         F.round(total, 6).alias("total"))


@query("load_one_shard", f"""WITH {CHUNK_SQL}
SELECT * FROM (SELECT shard_id::INTEGER AS shard_id, row_number() OVER (ORDER BY shard_id, chunk_id) - 1 AS index_id, vec_id
  FROM numbered) WHERE shard_id = 2""")
def load_one_shard(spark, sf):
    """One shard's folder; its ids keep the place they have among all shards."""
    path = scratch_path(spark, "shards")
    S.write_shards(S.chunk_ids(sharded(spark, sf)), path)
    return S.load_shards(spark, path, "chunk_id", shard_id=2).select("shard_id", "index_id", "vec_id")


PER_CHUNK = S.vectors_per_chunk(32 << 10, 64)


@query("shard_vectors", f"""
SELECT c.chunk_id, c.n_rows, c.first_id, c.last_id, ceil(t.n / {PER_CHUNK}.0)::BIGINT AS n_chunks, 64::BIGINT AS dim,
  t.n AS total_vectors, {PER_CHUNK}::BIGINT AS vectors_per_chunk, 'Flat' AS index_type
FROM (SELECT vec_id // {PER_CHUNK} AS chunk_id, count(*) AS n_rows, min(vec_id) AS first_id, max(vec_id) AS last_id
      FROM embeddings GROUP BY 1) c, (SELECT count(*) AS n FROM embeddings) t""")
def shard_vectors(spark, sf):
    rows = embeddings(spark, sf)
    meta = S.split_metadata(rows, PER_CHUNK, 64, "Flat").first().asDict()
    chunked = S.split_vectors(rows, PER_CHUNK, "vec_id").groupBy("chunk_id").agg(
        F.count("*").alias("n_rows"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
    for name in ("n_chunks", "dim", "total_vectors", "vectors_per_chunk"):
        chunked = chunked.withColumn(name, F.lit(meta[name]).cast("long"))
    return chunked.withColumn("index_type", F.lit(meta["index_type"]))


@query("combine_shards", f"""
SELECT vec_id, vec_id // {PER_CHUNK} AS chunk_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total
FROM embeddings""")
def combine_shards(spark, sf):
    path, rows = scratch_path(spark, "chunks"), embeddings(spark, sf)
    S.write_chunks(S.split_vectors(rows, PER_CHUNK, "vec_id"), S.split_metadata(rows, PER_CHUNK, 64, "Flat"), path)
    back = S.combine_chunks(spark, path)
    total = F.aggregate(V.as_double(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", F.col("chunk_id").cast("long").alias("chunk_id"), "label",
                       F.round(total, 6).alias("total"))


def _files(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", S.shard_name(F.col("label")))


def _report(spark, sf):
    """Status of one file per nation key; labels fill the first ten, one output is there already.

    Vectors of an odd label lose their elements below -0.25.
    """
    spoiled = F.when(F.col("label") % 2 == 1, F.transform(
        V.as_double(F.col("embedding")), lambda x: F.when(x < -0.25, F.lit(float("nan"))).otherwise(x)
    )).otherwise(V.as_double(F.col("embedding")))
    rows = _files(spark, sf, embeddings(spark, sf).withColumn("embedding", spoiled))
    files = table(spark, sf, "nation").select(S.shard_name(F.col("n_nationkey")).alias("file"))
    done = table(spark, sf, "region").where("r_name = 'ASIA'").select(S.shard_name(F.col("r_regionkey")).alias("file"))
    return rows, S.conversion_report(rows, files, done)


@query("convert_report", """
WITH f AS (SELECT 'passages_' || lpad(n_nationkey::VARCHAR, 2, '0') AS file FROM nation),
v AS (SELECT 'passages_' || lpad(label::VARCHAR, 2, '0') AS file, count(*) AS rows,
  count(*) FILTER (label % 2 = 1 AND list_min(embedding) < -0.25) AS bad FROM embeddings GROUP BY 1),
d AS (SELECT 'passages_' || lpad(r_regionkey::VARCHAR, 2, '0') AS file, true AS done FROM region WHERE r_name = 'ASIA')
SELECT file, coalesce(done, false) OR (coalesce(bad, 0) = 0 AND coalesce(rows, 0) > 0) AS ok,
  coalesce(rows, 0) AS rows,
  CASE WHEN done THEN 'skip (exists) ' || file
       WHEN bad > 0 THEN 'error: Non-finite value (NaN/Inf) in ' || file
       WHEN coalesce(rows, 0) = 0 THEN 'no rows' ELSE 'ok (rows=' || rows || ')' END AS message
FROM f LEFT JOIN v USING (file) LEFT JOIN d USING (file)""")
def convert_report(spark, sf):
    return _report(spark, sf)[1]


@query("verify_prefix", """
SELECT 'passages_' || lpad(label::VARCHAR, 2, '0') AS file, least(count(*), 256) AS need,
  least(count(*), 256) AS matched, true AS ok FROM embeddings GROUP BY label""")
def verify_prefix(spark, sf):
    """Convert every file, read the JSON lines back and compare the first 256 rows of each."""
    path = scratch_path(spark, "converted")
    rows = _files(spark, sf, embeddings(spark, sf))
    S.write_converted(rows, S.conversion_report(rows, rows.select("file")), path)
    return S.verify_prefix(rows, S.read_converted(spark, path), 256)
