"""Declared schemas of the files and tables the operators read or write."""

from pyspark.sql import types as T

EMBEDDING_LINE = "file string, id string, embedding array<float>"

PASSAGE_LINE = "id string, text string, title string, _corrupt string"

SEARCH_CONFIG = "struct<nprobe:int,exact_search:boolean,diverse_search:boolean,lambda:double>"

VOTE_EVENT = (
    "seq long, ts long, query_hash string, query_norm string, passage_id string, "
    f"relevant boolean, config {SEARCH_CONFIG}"
)

QUERY_EVENT = (
    "ts long, query_hash string, query_norm string, "
    f"config {SEARCH_CONFIG}, n_docs int, latency double, "
    "expand_index_id long, expand_offset int, K int"
)

CONTEXT = "array<struct<title:string,text:string>>"
TRAINING_EXAMPLE = (
    f"question string, positive_ctxs {CONTEXT}, negative_ctxs {CONTEXT}, hard_negative_ctxs {CONTEXT}"
)

REQUEST = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("n_docs", T.IntegerType()),
    T.StructField("nprobe", T.IntegerType()),
    T.StructField("exact_search", T.BooleanType()),
    T.StructField("diverse_search", T.BooleanType()),
    T.StructField("lambda", T.DoubleType()),
    T.StructField("min_words", T.IntegerType()),
    T.StructField("expand_index_id", T.LongType()),
    T.StructField("expand_offset", T.IntegerType()),
])
