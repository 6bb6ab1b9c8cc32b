"""Checked queries over passage files: scans, numbering, offsets, fetch and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.text import word_count
from findery.operators.passages import expand_context, fetch_passages
from findery.operators.prefix import blocked_running_sum, id_block
from findery.operators.topk import SCORE_DIGITS, knn_flat
from findery.plans.registry import query
from findery.plans.search import expand_requests
from findery.plans.text_queries import documents
from findery.plans.vector_queries import K, TOPICS_SQL, embeddings, hits_sql, topics
from findery.session import scratch_path, table
from findery.sources import lines as L
from findery.sources import passages as P

LATE = ["src7", "src2"]


def written_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as passage files, every 97th line cut short, read back as lines."""
    docs = table(spark, sf, "documents").select(
        F.concat("source", F.lit("--raw_passages_"), F.when(F.col("lang") == "en", 10).otherwise(2), F.lit("-"),
                 F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2)), F.lit("-of-2.jsonl")).alias("passage_file"),
        F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("line"), "doc_id")
    cut = F.when(F.pmod("doc_id", F.lit(97)) == 5, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    path = scratch_path(spark, "passages")
    P.write_passages(docs.select("passage_file", cut.alias("value"), "doc_id"), path, order_col="doc_id")
    return L.scan_text(spark, path)


LINES_SQL = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id) - 1 AS line_no FROM (
    SELECT doc_id, text, source, doc_id % 97 = 5 AS cut, CASE WHEN lang = 'en' THEN 10 ELSE 2 END AS rank,
      doc_id // 20 % 2 AS shard,
      source || '--raw_passages_' || CASE WHEN lang = 'en' THEN 10 ELSE 2 END || '-' || (doc_id // 20 % 2)
        || '-of-2.jsonl' AS filename,
      strlen(json_object('id', doc_id::VARCHAR, 'text', text)::VARCHAR) + CASE WHEN doc_id % 97 = 5 THEN 0 ELSE 1 END
        AS n_bytes FROM documents)),
validity AS (SELECT filename, NOT bool_or(cut AND line_no < 3) AS valid FROM lines GROUP BY filename)"""

CORPUS_SQL = LINES_SQL + f""",
corpus AS (
  SELECT *, row_number() OVER (ORDER BY {' '.join(['CASE source'] + [f"WHEN '{d}' THEN {i}" for i, d in enumerate(LATE, 1)])}
      ELSE 0 END, source, rank, shard, line_no) - 1 AS index_id,
    coalesce(sum(n_bytes) OVER (PARTITION BY filename ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position
  FROM lines JOIN validity USING (filename) WHERE valid)"""


@query("scan_passages", f"""WITH {LINES_SQL}
SELECT filename, line_no, CASE WHEN NOT cut THEN doc_id::VARCHAR END AS passage_id, CASE WHEN NOT cut THEN text END AS text,
  source, cut AS corrupt FROM lines""")
def scan_passages(spark, sf):
    lines = L.number_lines(written_corpus(spark, sf))
    return P.parse_passages(lines).select("filename", "line_no", "passage_id", "text", "source", "corrupt")


@query("valid_files", f"WITH {LINES_SQL} SELECT filename, valid FROM validity")
def valid_files(spark, sf):
    return L.file_validity(L.split_table(written_corpus(spark, sf)))


@query("valid_file_counts", f"WITH {LINES_SQL} SELECT valid, count(*) AS n_files FROM validity GROUP BY valid")
def valid_file_counts(spark, sf):
    return L.valid_counts(L.file_validity(L.split_table(written_corpus(spark, sf))))


@query("corpus_index_ids", f"""WITH {CORPUS_SQL}
SELECT index_id, filename, line_no, CASE WHEN NOT cut THEN doc_id::VARCHAR END AS passage_id FROM corpus""")
def corpus_index_ids(spark, sf):
    lines = written_corpus(spark, sf)
    corpus = P.parse_passages(L.corpus_ids(lines, L.split_table(lines), LATE))
    return corpus.select("index_id", "filename", "line_no", "passage_id")


@query("line_offsets", f"WITH {CORPUS_SQL} SELECT index_id, filename, position FROM corpus")
def line_offsets(spark, sf):
    lines = written_corpus(spark, sf)
    return L.line_offsets(L.corpus_ids(lines, L.split_table(lines), LATE)).select("index_id", "filename", "position")


@query("scan_tsv", "SELECT doc_id::VARCHAR AS id, source AS title, text FROM documents")
def scan_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    docs = table(spark, sf, "documents")
    P.write_tsv(docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("title")), path)
    return P.read_tsv(spark, path)


@query("stride_split", """
SELECT counter, question, turn_text FROM (
  SELECT row_number() OVER (ORDER BY conv_id, turn) AS counter, text AS question, role AS turn_text FROM conversations)
WHERE counter % 3 = 1""")
def stride_split(spark, sf):
    """Conversation turns as example files; the share of worker 1 of 3."""
    path = scratch_path(spark, "examples")
    turns = table(spark, sf, "conversations").repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    one = F.array(F.struct(F.lit("").alias("title"), F.col("role").alias("text")))
    turns.select(F.col("text").alias("question"), one.alias("positive_ctxs")).write.json(path)
    staged = P.stage_examples(spark, path)
    numbered = L.attach(staged, L.with_starts(L.split_table(staged)))
    share = P.stride(numbered, world_size=3, rank=1)
    return share.select("counter", "question", F.col("positive_ctxs")[0]["text"].alias("turn_text"))


MAX_LOAD, FIRST_QUERIES = 100, 50


@query("array_examples", f"""
SELECT counter, question FROM (
  SELECT row_number() OVER (ORDER BY label, conv_id, turn) AS counter, text AS question
  FROM (SELECT *, conv_id % 2 AS label FROM conversations)) WHERE counter <= {MAX_LOAD} AND counter % 2 = 0""")
def array_examples(spark, sf):
    """Two files that hold one JSON array each; the first MAX_LOAD examples, every second one."""
    path = scratch_path(spark, "example-arrays")
    turns = table(spark, sf, "conversations").select(
        F.pmod("conv_id", F.lit(2)).alias("label"), "conv_id", "turn", F.col("text").alias("question"))
    one = F.struct("conv_id", "turn", "question", F.array(F.struct(F.lit("").alias("title"), F.lit("x").alias("text")))
                   .alias("positive_ctxs"))
    # a fixture's file is one array, so its turns meet in one row
    arrays = turns.groupBy("label").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("value"))
    arrays.repartitionByRange(2, "label").sortWithinPartitions("label").select("value").write.text(path)
    staged = P.stage_examples(spark, path, array=True)
    numbered = L.attach(staged, L.with_starts(L.split_table(staged)))
    return P.stride(numbered, world_size=2, rank=0, maxload=MAX_LOAD).select("counter", "question")


@query("first_queries", f"""
SELECT line_no, query FROM (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, text AS query FROM conversations)
WHERE line_no < {FIRST_QUERIES}""")
def first_queries(spark, sf):
    """The first FIRST_QUERIES lines of a query file, which is the cut a bench asks for."""
    path = scratch_path(spark, "query-file")
    turns = table(spark, sf, "conversations").repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    turns.select(F.to_json(F.struct(F.col("text").alias("question"))).alias("value")).write.text(path)
    staged = L.scan_text(spark, path)
    numbered = L.attach(staged, L.with_starts(L.split_table(staged)))
    numbered = numbered.withColumn("line_no", F.col("id_start") + F.col("seq") - F.col("first_seq"))
    return P.load_queries(numbered, FIRST_QUERIES)


@query("load_queries", f"""
WITH q AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, turn % 5 AS kind, role, text FROM conversations)
SELECT line_no, CASE kind WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text
  WHEN 4 THEN json_object('other', role)::VARCHAR END AS query
FROM q WHERE kind <> 3""")
def load_queries(spark, sf):
    """One line per turn: the three known fields, a blank line, and a record without any of them."""
    kind = F.pmod("turn", F.lit(5))
    blank = F.lit("")
    line = (
        F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("query"))))
        .when(kind == 1, F.to_json(F.struct(blank.alias("query"), F.col("text").alias("full_text"))))
        .when(kind == 2, F.to_json(F.struct(blank.alias("full_text"), F.col("text").alias("question"))))
        .when(kind == 3, F.lit("   ")).otherwise(F.to_json(F.struct(F.col("role").alias("other")))))
    path = scratch_path(spark, "query-file")
    turns = table(spark, sf, "conversations").repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    turns.select(line.alias("value")).write.text(path)
    staged = L.scan_text(spark, path)
    numbered = L.attach(staged, L.with_starts(L.split_table(staged)))
    return P.load_queries(numbered.withColumn("line_no", F.col("id_start") + F.col("seq") - F.col("first_seq")))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the passage table an ingest stores: ids, byte position within the source, word count."""
    docs = documents(spark, sf).select(
        F.col("doc_id").alias("index_id"), F.col("doc_id").cast("string").alias("passage_id"), "text", "source",
        F.concat("source", F.lit("--raw_passages_0-0-of-1.jsonl")).alias("filename"),
        (F.octet_length("text") + 1).cast("long").alias("n_bytes"))
    sized = docs.select("index_id", "source", "n_bytes").withColumn("_b", id_block("index_id"))
    placed = blocked_running_sum(sized, ["source"], "_b", ["index_id"], F.col("n_bytes"), "position")
    path = scratch_path(spark, "passage-table")
    table_rows = docs.drop("n_bytes").join(placed.select("index_id", "position"), "index_id")
    table_rows.withColumn("n_words", word_count(F.col("text"))).write.parquet(path)
    return spark.read.parquet(path)


PASSAGES_SQL = """
passages AS (
  SELECT doc_id AS index_id, doc_id::VARCHAR AS passage_id, text, source,
    source || '--raw_passages_0-0-of-1.jsonl' AS filename,
    coalesce(sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM documents)"""

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"


def topic_hits(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Hits of the topic queries as index ids, and a proven bound on their number."""
    asked = topics(spark, sf)
    hits = knn_flat(asked, embeddings(spark, sf), K, digits=SCORE_DIGITS).withColumnRenamed("vec_id", "index_id")
    return hits, asked.count() * K


@query("fetch_passages", f"""WITH {TOPICS_SQL}, {hits_sql(K)}, {PASSAGES_SQL}
SELECT query_id, rank, index_id, round(score, 6) AS score, passage_id, {STRIP.format('text')} AS text,
  text AS center_text, source, filename, position FROM hits JOIN passages ON vec_id = index_id""")
def fetch(spark, sf):
    hits, most = topic_hits(spark, sf)
    out = fetch_passages(hits, passages(spark, sf))
    return out.select("query_id", "rank", "index_id", F.round("score", 6).alias("score"), "passage_id", "text",
                      "center_text", "source", "filename", "position")


@query("expand_context", f"""WITH {PASSAGES_SQL}
SELECT c.index_id, {STRIP.format("concat_ws(' ', nullif(a.text, ''), c.text, nullif(b.text, ''))")} AS text,
  c.source, c.filename, c.position, {STRIP.format('c.text')} AS original_text
FROM passages c LEFT JOIN passages a ON a.index_id = c.index_id - 1 LEFT JOIN passages b ON b.index_id = c.index_id + 1""")
def expand(spark, sf):
    """Every passage of the corpus with its two neighbours."""
    corpus = passages(spark, sf)
    return expand_context(corpus.select("index_id"), corpus, 1, key_cols=())


@query("expand_within_file", f"""WITH {PASSAGES_SQL}, {TOPICS_SQL}, {hits_sql(K)}
SELECT h.query_id, c.index_id, {STRIP.format("string_agg(n.text, ' ' ORDER BY n.index_id)")} AS text,
  c.source, c.filename, c.position
FROM hits h JOIN passages c ON c.index_id = h.vec_id
JOIN passages n ON n.index_id BETWEEN c.index_id - 20 AND c.index_id + 20 AND n.filename = c.filename
  AND (n.text <> '' OR n.index_id = c.index_id)
GROUP BY h.query_id, c.index_id, c.source, c.filename, c.position""")
def expand_within_file(spark, sf):
    """Hits with up to twenty neighbours on each side that lie in the same file."""
    hits, _ = topic_hits(spark, sf)
    return expand_context(hits, passages(spark, sf), 20, within="filename")


@query("expand_requests", f"""WITH {PASSAGES_SQL},
asked AS (SELECT doc_id, 1 + quality + toxic AS o FROM labels),
near AS (SELECT a.doc_id, a.o, {STRIP.format("string_agg(n.text, ' ' ORDER BY n.index_id)")} AS text
  FROM asked a JOIN passages n ON n.index_id BETWEEN a.doc_id - a.o AND a.doc_id + a.o
    AND (n.text <> '' OR n.index_id = a.doc_id) GROUP BY a.doc_id, a.o)
SELECT x.doc_id AS query_id, x.doc_id AS index_id, x.o::BIGINT AS expand_offset, x.text, c.source, c.filename, c.position,
  CASE WHEN x.o = 1 THEN {STRIP.format('c.text')} END AS original_text
FROM near x JOIN passages c ON c.index_id = x.doc_id""")
def expand_requests_labels(spark, sf):
    """One expansion request per labelled document, the offset from its labels."""
    asked = table(spark, sf, "labels").select(
        F.col("doc_id").alias("query_id"), F.col("doc_id").alias("expand_index_id"),
        (1 + F.col("quality") + F.col("toxic")).alias("expand_offset"))
    return expand_requests(asked, passages(spark, sf))
