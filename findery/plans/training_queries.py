"""Checked queries of training-data preparation on whole token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import draws as D
from findery.operators import training as T
from findery.operators.prefix import ranked_rows
from findery.plans import sqltext as Q
from findery.plans.registry import query
from findery.plans.text_queries import documents
from findery.plans.vector_queries import draw_sql, embeddings
from findery.session import materialize, scratch_path, table

LENGTH, P = 64, 0.1
RATIO = (0.25, 0.75)
LOW, HIGH, MASK, BOS, EOS, VOCABULARY = 1000, 29_999, 103, 101, 102, 30_000
BATCH, WORLD, COEFF = 16, 7, 0.5


def token_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as token arrays, stored as the token files a training job starts from."""
    path = scratch_path(spark, "tokens")
    documents(spark, sf).select(
        F.col("lang").alias("dataset"), "doc_id", T.token_ids(F.col("text"), VOCABULARY).alias("tokens"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_chunks(token_table(spark, sf), LENGTH, "offset")


def unit_draw(seed: str, *keys: str) -> str:
    return f"({draw_sql(seed, *keys)} / 4294967296.0::DOUBLE)"


def spot_hash(seed: str, i: str = "i") -> str:
    """Mixed hash of a position in a chunk, as ``position_hash`` does it."""
    x = f"(({draw_sql(seed, 'dataset', 'chunk_id')} + {i}::BIGINT * {D.STEP}) & {D.MASK32})"
    for factor, prime, mask in D.ROUNDS:
        x = f"({x} * {factor}::BIGINT % {prime})"
        x = f"xor({x}, {mask}::BIGINT)" if mask else x
    return x


def spot_draw(seed: str) -> str:
    return f"({spot_hash(seed)} / 4294967296.0::DOUBLE)"


CHUNKS_SQL = f"""
stream AS (
  SELECT dataset, t, row_number() OVER (PARTITION BY dataset ORDER BY doc_id, pos) - 1 AS place FROM (
    SELECT lang AS dataset, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos,
      ({Q.hash32('word')} % {VOCABULARY})::INTEGER AS t
    FROM (SELECT lang, doc_id, {Q.words('text')} AS w FROM documents))),
shifted AS (
  SELECT dataset, t, place - floor({unit_draw('offset', 'dataset')} * {LENGTH})::BIGINT AS place FROM stream),
tok AS (
  SELECT dataset, place // {LENGTH} AS chunk_id, place % {LENGTH} AS i, t FROM shifted
  WHERE place >= 0 QUALIFY count(*) OVER (PARTITION BY dataset, place // {LENGTH}) = {LENGTH})"""


def line_sql(value: str, order: str = "i") -> str:
    return f"string_agg({value}::VARCHAR, ',' ORDER BY {order})"


def line(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), ",")


def key() -> tuple[Column, Column]:
    return F.col("dataset"), F.col("chunk_id")


def _chunk_query(name: str, value: str, change, extra: str = "") -> None:
    """A rule on every chunk; ``value`` is its SQL per token row of ``tok``."""

    @query(name, f"WITH {CHUNKS_SQL} SELECT dataset, chunk_id, {value} AS tokens FROM tok {extra} GROUP BY dataset, chunk_id")
    def plan(spark, sf):
        return chunks(spark, sf).select("dataset", "chunk_id", line(change(F.col("tokens"))).alias("tokens"))


_chunk_query("token_chunks", line_sql("t"), lambda x: x)
_chunk_query(
    "augment_delete", f"coalesce({line_sql('t')} FILTER ({spot_draw('delete')} > {P}), '')",
    lambda x: T.delete_words(x, P, "delete", *key()))
_chunk_query(
    "augment_replace",
    line_sql(f"""CASE WHEN {spot_draw('replace')} > {P} THEN t
      ELSE ({LOW} + floor({spot_draw('replace-id')} * {HIGH - LOW + 1}))::INTEGER END"""),
    lambda x: T.replace_words(x, LOW, HIGH, P, "replace", *key()))
_chunk_query(
    "augment_mask", line_sql(f"CASE WHEN {spot_draw('mask')} > {P} THEN t ELSE {MASK} END"),
    lambda x: T.mask_words(x, MASK, P, "mask", *key()))
_chunk_query("add_bos_eos", f"'{BOS},' || {line_sql('t')} || ',{EOS}'", lambda x: T.add_ends(x, BOS, EOS))


@query("augment_shuffle", f"""WITH {CHUNKS_SQL},
d AS (SELECT *, {spot_draw('shuffle')} AS u,
  row_number() OVER (PARTITION BY dataset, chunk_id ORDER BY {spot_hash('shuffle-spot')}, i) AS spot
  FROM tok),
c AS (SELECT *, count(*) FILTER (u < {P}) OVER (PARTITION BY dataset, chunk_id) AS n FROM d),
m AS (SELECT dataset, chunk_id, t, row_number() OVER (PARTITION BY dataset, chunk_id
    ORDER BY {spot_hash('shuffle-move')}, i) AS spot FROM c WHERE spot <= n),
r AS (SELECT c.dataset, c.chunk_id, c.i, coalesce(m.t, c.t) AS t
  FROM c LEFT JOIN m ON m.dataset = c.dataset AND m.chunk_id = c.chunk_id AND m.spot = c.spot AND c.spot <= c.n)
SELECT dataset, chunk_id, {line_sql('t')} AS tokens FROM r GROUP BY dataset, chunk_id""")
def augment_shuffle(spark, sf):
    out = T.shuffle_words(F.col("tokens"), P, "shuffle", *key())
    return chunks(spark, sf).select("dataset", "chunk_id", line(out).alias("tokens"))


def _crop_sql(seed: str) -> str:
    n = f"floor({LENGTH} * ({RATIO[0]}::DOUBLE + {unit_draw(seed + '-ratio', 'dataset', 'chunk_id')} * {RATIO[1] - RATIO[0]}::DOUBLE))::BIGINT"
    start = f"floor({unit_draw(seed + '-start', 'dataset', 'chunk_id')} * ({LENGTH} - {n} + 1))::BIGINT"
    return f"{line_sql('t')} FILTER (i >= {start} AND i < {start} + {n})"


def _crop(seed: str):
    return T.random_crop(F.col("tokens"), *RATIO, seed, *key())


@query("random_crop_pair", f"""WITH {CHUNKS_SQL}
SELECT dataset, chunk_id, {_crop_sql('q')} AS q_tokens, {_crop_sql('k')} AS k_tokens FROM tok GROUP BY dataset, chunk_id""")
def random_crop_pair(spark, sf):
    return chunks(spark, sf).select("dataset", "chunk_id", line(_crop("q")).alias("q_tokens"), line(_crop("k")).alias("k_tokens"))


@query("pad_batch", f"""WITH {CHUNKS_SQL},
c AS (SELECT dataset, chunk_id, chunk_id // {BATCH} AS batch_id, {_crop_sql('q')} AS x FROM tok GROUP BY dataset, chunk_id),
n AS (SELECT *, len(string_split(x, ',')) AS n FROM c),
m AS (SELECT *, max(n) OVER (PARTITION BY dataset, batch_id) AS longest FROM n)
SELECT dataset, batch_id, chunk_id, x || repeat(',0', longest - n) AS ids,
  repeat('1', n) || repeat('0', longest - n) AS mask FROM m""")
def pad_batch(spark, sf):
    rows = chunks(spark, sf).select("dataset", F.floor(F.col("chunk_id") / BATCH).alias("batch_id"), "chunk_id",
                                    _crop("q").alias("tokens"))
    out = T.pad_batch(rows, ["dataset", "batch_id"])
    bits = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "")
    return out.select("dataset", "batch_id", "chunk_id", line(F.col("ids")).alias("ids"), bits.alias("mask"))


def _pair_side(side: str) -> str:
    """One side of a training pair in SQL: cropped, masked by position in the crop, fenced."""
    n = f"floor({LENGTH} * ({RATIO[0]}::DOUBLE + {unit_draw(f'pair-{side}-ratio', 'dataset', 'chunk_id')} * {RATIO[1] - RATIO[0]}::DOUBLE))::BIGINT"
    start = f"floor({unit_draw(f'pair-{side}-start', 'dataset', 'chunk_id')} * ({LENGTH} - {n} + 1))::BIGINT"
    spot = f"({spot_hash(f'pair-{side}-mask', 'j')} / 4294967296.0::DOUBLE)"
    return f"""
{side}_cut AS (SELECT dataset, chunk_id, i - {start} AS j, t FROM tok WHERE i >= {start} AND i < {start} + {n}),
{side} AS (SELECT dataset, chunk_id, chunk_id // {BATCH} AS batch_id, count(*) + 2 AS n,
    '{BOS},' || {line_sql(f'CASE WHEN {spot} > {P} THEN t ELSE {MASK} END', 'j')} || ',{EOS}' AS x
  FROM {side}_cut GROUP BY dataset, chunk_id),
{side}_pad AS (SELECT dataset, chunk_id, batch_id, x || repeat(',0', max(n) OVER w - n) AS ids, n
  FROM {side} WINDOW w AS (PARTITION BY dataset, batch_id))"""


@query("training_pair", f"""WITH {CHUNKS_SQL}, {_pair_side('q')}, {_pair_side('k')}
SELECT dataset, batch_id, chunk_id, q_pad.ids AS q_ids, q_pad.n AS q_n, k_pad.ids AS k_ids, k_pad.n AS k_n
FROM q_pad JOIN k_pad USING (dataset, batch_id, chunk_id)""")
def training_pair(spark, sf):
    """Two views of every chunk as a trainer takes them: cropped, masked, fenced, padded in their batch."""
    rows = chunks(spark, sf).withColumn("batch_id", F.floor(F.col("chunk_id") / BATCH))
    pairs = T.training_pairs(rows, ["dataset", "batch_id"], RATIO, "pair", key(), "mask", P, BOS, EOS, MASK)
    used = lambda side: F.size(F.filter(f"{side}_mask", lambda m: m)).cast("long")
    return pairs.select("dataset", "batch_id", "chunk_id", line(F.col("q_ids")).alias("q_ids"), used("q").alias("q_n"),
                        line(F.col("k_ids")).alias("k_ids"), used("k").alias("k_n"))


WEIGHTS_SQL = f"""
sizes AS (SELECT dataset, count(DISTINCT chunk_id) AS size FROM tok GROUP BY dataset),
powers AS (SELECT dataset, size, pow(size / (SELECT sum(size) FROM sizes)::DOUBLE, {COEFF}) AS p FROM sizes),
weights AS (SELECT dataset, size, p / (SELECT sum(p) FROM powers) AS weight FROM powers)"""


@query("sampling_weights", f"WITH {CHUNKS_SQL}, {WEIGHTS_SQL} SELECT dataset, size, round(weight, 6) AS weight FROM weights")
def sampling_weights(spark, sf):
    return T.sampling_weights(chunks(spark, sf), "dataset", COEFF).withColumn("weight", F.round("weight", 6))


@query("mix_datasets", f"""WITH {CHUNKS_SQL}, {WEIGHTS_SQL},
bands AS (SELECT dataset, size, sum(weight) OVER (ORDER BY dataset) - weight AS low, sum(weight) OVER (ORDER BY dataset) AS high FROM weights),
draws AS (SELECT doc_id AS sample_id, {unit_draw('mix-set', 'doc_id')} AS u, {unit_draw('mix-row', 'doc_id')} AS v FROM documents),
picks AS (SELECT sample_id, dataset, floor(v * size)::BIGINT AS chunk_id FROM draws JOIN bands ON u >= low AND u < high),
c AS (SELECT dataset, chunk_id, {line_sql('t')} AS tokens FROM tok GROUP BY dataset, chunk_id)
SELECT sample_id, dataset, chunk_id, tokens FROM picks JOIN c USING (dataset, chunk_id)""")
def mix_datasets(spark, sf):
    """One draw per document over the chunk sets of the four languages."""
    samples = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    stored = materialize(chunks(spark, sf))
    mixed = T.mix_datasets(stored, samples, COEFF, "mix")
    return mixed.select("sample_id", "dataset", "chunk_id", line(F.col("tokens")).alias("tokens"))


# ---- supervised examples -----------------------------------------------------------

NEGATIVES, HARD_RATIO, HARD_MIN = 3, 0.5, 1
GROUP = 8


def raw_examples(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions; nearby turns as positives, the next conversations' as negatives."""
    c = table(spark, sf, "conversations")

    def near(conv: int, turn: int, name: str) -> DataFrame:
        context = F.struct(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("role")).otherwise("").alias("title"), "text")
        return c.select((F.col("conv_id") - conv).alias("conv_id"), (F.col("turn") - turn).alias("turn"), context.alias(name))

    out = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    spots = {"p1": (0, 1), "p2": (0, 3), "n1": (1, 0), "n2": (1, 1), "n3": (2, 0), "h1": (0, 2), "h2": (0, 4), "h3": (0, 5)}
    for name, (conv, turn) in spots.items():
        out = out.join(near(conv, turn, name), ["conv_id", "turn"], "left")
    there = lambda *cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    return out.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("example_id"), "question", there("p1", "p2").alias("positive_ctxs"),
        there("n1", "n2", "n3").alias("negative_ctxs"), there("h1", "h2", "h3").alias("hard_negative_ctxs"),
    ).where(F.size("positive_ctxs") > 0)


_NEAR = {"p1": (0, 1), "p2": (0, 3), "n1": (1, 0), "n2": (1, 1), "n3": (2, 0), "h1": (0, 2), "h2": (0, 4), "h3": (0, 5)}

EXAMPLES_SQL = f"""
turns AS (SELECT conv_id, turn, role, text,
  CASE WHEN conv_id % 2 = 0 AND role <> '' THEN role || ' ' || text ELSE text END AS whole FROM conversations),
raw AS (
  SELECT c.conv_id * 1000000 + c.turn AS example_id, c.text AS question,
    list_filter([p1.whole, p2.whole], lambda x: x IS NOT NULL) AS pos,
    list_filter([n1.whole, n2.whole, n3.whole], lambda x: x IS NOT NULL) AS neg,
    list_filter([h1.whole, h2.whole, h3.whole], lambda x: x IS NOT NULL) AS hard
  FROM turns c {' '.join(f'LEFT JOIN turns {n} ON {n}.conv_id = c.conv_id + {a} AND {n}.turn = c.turn + {b}' for n, (a, b) in _NEAR.items())}
  WHERE c.role = 'user'),
counted AS (
  SELECT *, hard[{HARD_MIN + 1}:] AS pool,
    least({' + '.join(f"({unit_draw('ex-hard', 'example_id', str(j))} < {HARD_RATIO})::INTEGER" for j in range(NEGATIVES))},
      len(hard[{HARD_MIN + 1}:])) AS h
  FROM raw WHERE len(pos) > 0),
sized AS (SELECT *, least({NEGATIVES} - h, len(neg)) AS r FROM counted),
rnd AS (SELECT example_id, x, row_number() OVER (PARTITION BY example_id ORDER BY {draw_sql('ex-random', 'example_id', 'i')}, i) AS o, r
  FROM (SELECT example_id, r, unnest(neg) AS x, generate_subscripts(neg, 1) - 1 AS i FROM sized)),
hrd AS (SELECT example_id, x, row_number() OVER (PARTITION BY example_id ORDER BY {draw_sql('ex-pick', 'example_id', 'i')}, i) AS o, h
  FROM (SELECT example_id, h, unnest(pool) AS x, generate_subscripts(pool, 1) - 1 AS i FROM sized)),
negs AS (SELECT example_id, list(x ORDER BY kind, o) AS negatives FROM (
  SELECT example_id, 0 AS kind, o, x FROM rnd WHERE o <= r UNION ALL SELECT example_id, 1, o, x FROM hrd WHERE o <= h)
  GROUP BY example_id),
examples AS (SELECT example_id, question AS query,
    pos[1 + floor({unit_draw('ex-gold', 'example_id')} * len(pos))::BIGINT] AS gold, coalesce(negatives, []) AS negatives
  FROM sized LEFT JOIN negs USING (example_id))"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return T.training_examples(raw_examples(spark, sf), NEGATIVES, HARD_RATIO, HARD_MIN, "ex")


@query("training_examples", f"""WITH {EXAMPLES_SQL}
SELECT example_id, query, gold, array_to_string(negatives, ' || ') AS negatives FROM examples""")
def training_examples(spark, sf):
    return examples(spark, sf).withColumn("negatives", F.array_join("negatives", " || "))


@query("evaluation_examples", f"""WITH {EXAMPLES_SQL}
SELECT example_id, {Q.normalize_punctuation('question')} AS query, {Q.normalize_punctuation('pos[1]')} AS gold,
  coalesce({Q.normalize_punctuation('neg[1]')}, '') AS negatives FROM raw WHERE len(pos) > 0""")
def evaluation_examples(spark, sf):
    """The first positive and the first negative, texts normalised."""
    out = T.training_examples(raw_examples(spark, sf), NEGATIVES, HARD_RATIO, HARD_MIN, "ex", training=False, normalize=True)
    return out.withColumn("negatives", F.array_join("negatives", " || "))


@query("batch_passages", f"""WITH {EXAMPLES_SQL},
n AS (SELECT *, (row_number() OVER (ORDER BY example_id) - 1) // {GROUP} AS batch_id FROM examples),
all_rows AS (
  SELECT batch_id, 0 AS kind, example_id, 0 AS j, gold AS passage FROM n
  UNION ALL SELECT batch_id, 1, example_id, generate_subscripts(negatives, 1), unnest(negatives) FROM n)
SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY kind, example_id, j) - 1 AS pos, passage FROM all_rows""")
def batch_passages(spark, sf):
    numbered = ranked_rows(examples(spark, sf), [], [F.col("example_id")], "_n")
    batches = T.batch_passages(numbered.withColumn("batch_id", F.floor((F.col("_n") - 1) / GROUP)))
    out = batches.select("batch_id", F.posexplode("passages").alias("pos", "passage"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("array_split", f"""
SELECT doc_id AS index_id, ntile({WORLD}) OVER (ORDER BY doc_id) - 1 AS part FROM documents""")
def array_split(spark, sf):
    return T.array_split(table(spark, sf, "documents").select(F.col("doc_id").alias("index_id")), WORLD)


TAU, SMOOTH, PAIRS = 0.05, 0.1, 32


@query("inbatch_stats", f"""
WITH p AS (SELECT a.vec_id // 2 AS pair_id, a.vec_id // {2 * PAIRS} AS batch_id, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS k
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
s AS (SELECT x.batch_id, x.pair_id AS i, y.pair_id AS j, list_inner_product(x.q, y.k) / {TAU} AS s FROM p x JOIN p y USING (batch_id)),
l AS (SELECT batch_id, i, max(s) + ln(sum(exp(s - mx))) AS lse, avg(s) AS mean_s, max(s) FILTER (i = j) AS own,
    arg_max(j, s) = i AS good FROM (SELECT *, max(s) OVER (PARTITION BY batch_id, i) AS mx FROM s) GROUP BY batch_id, i),
e AS (SELECT batch_id, d, stddev_samp(x) AS sq, stddev_samp(y) AS sk FROM (
    SELECT batch_id, unnest(q) AS x, unnest(k) AS y, generate_subscripts(q, 1) AS d FROM p) GROUP BY batch_id, d),
f AS (SELECT batch_id, avg(sq) AS stdq, avg(sk) AS stdk FROM e GROUP BY batch_id)
SELECT l.batch_id, count(*) AS size, round(avg({1 - SMOOTH} * (lse - own) + {SMOOTH} * (lse - mean_s)), 6) AS loss,
  round(100 * avg(good::INTEGER), 6) AS accuracy, round(any_value(stdq), 6) AS stdq, round(any_value(stdk), 6) AS stdk
FROM l JOIN f USING (batch_id) GROUP BY l.batch_id""")
def inbatch_stats(spark, sf):
    """Neighbouring vectors as (query, key) pairs, 32 pairs a batch."""
    e = embeddings(spark, sf).select("vec_id", "embedding")
    q = e.where(F.pmod("vec_id", F.lit(2)) == 0).select(F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").alias("q"))
    k = e.where(F.pmod("vec_id", F.lit(2)) == 1).select(F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").alias("k"))
    pairs = q.join(k, "pair_id").withColumn("batch_id", F.floor(F.col("pair_id") / PAIRS))
    out = T.inbatch_stats(pairs, TAU, SMOOTH)
    return out.select("batch_id", "size", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "stdq", "stdk")])
