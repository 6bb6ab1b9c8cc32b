"""Vectors that were encoded before: a table that grows by batches and is merged by generations.

A run adds one folder of generation 0. When a generation has FANOUT folders they become one of the next, so a
vector is written again a logarithmic number of times and a read never opens many small folders. What is missing
is found from ids alone; texts are read where they lie and only those of missing ids go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.vectors import is_finite
from findery.operators.encode import Encoder, embed_texts
from findery.operators.passages import MAX_BROADCAST_HITS
from findery.session import materialize

#: Folders of one generation that are merged into one of the next.
FANOUT = 8


def read_cache(spark: SparkSession, path: str, id_col: str, kind: str) -> DataFrame:
    """The cache table as it is now (its files are listed here); an absent one is empty. An id may be there twice."""
    try:
        return spark.read.parquet(path).select(id_col, "embedding")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{id_col} {kind}, embedding array<double>")


def known_ids(passages: DataFrame, cache: DataFrame, id_col: str) -> DataFrame:
    """(id, rows, stored): how often each id stands in the passages and in the cache. Only ids are moved."""
    asked = passages.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("rows"))
    held = cache.groupBy(id_col).agg(F.count("*").alias("stored"))
    return asked.join(held, id_col, "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str, n_ids: int, n_most: int) -> DataFrame:
    """The rows of ``ids``, one for each: where the ids are few, or once, nothing wide is moved for it."""
    wanted = ids.select(id_col)
    found = rows.join(F.broadcast(wanted) if n_ids <= MAX_BROADCAST_HITS else wanted, id_col, "left_semi")
    return found if n_most <= 1 else found.dropDuplicates([id_col])


def embed_with_cache(passages: DataFrame, cache_path: str, make_encoder: Callable[[], Encoder],
                     id_col: str = "passage_id", text_col: str = "text", **options) -> DataFrame:
    """(id, embedding, cached): vectors from the cache, the rest encoded and appended to it.

    Vectors that are not finite are neither stored nor returned, passages without an id are left out, and of
    repeated ids one row counts. Queries are never cached: encode them with ``embed_texts``.
    """
    spark = passages.sparkSession
    kind = passages.schema[id_col].dataType.simpleString()
    cache = read_cache(spark, cache_path, id_col, kind)
    ids = materialize(known_ids(passages, cache, id_col))
    absent, present = ids.where("stored = 0"), ids.where("stored > 0")
    sizes = ids.agg(
        F.count_if(F.col("stored") == 0).alias("misses"), F.max(F.when(F.col("stored") == 0, F.col("rows"))).alias("rows"),
        F.count_if(F.col("stored") > 0).alias("hits"), F.max("stored").alias("stored")).first()
    texts = passages.select(id_col, text_col)
    misses = with_ids(texts, absent, id_col, sizes["misses"], sizes["rows"] or 0)
    batch = f"{cache_path}/generation=0/batch={uuid.uuid4().hex}"
    fresh = embed_texts(misses, id_col, text_col, make_encoder, **options)
    fresh.where(is_finite(F.col("embedding"))).write.parquet(batch)
    # what was new is read back, so that encoding happens once
    stored = spark.read.parquet(batch)
    # runs that overlapped may have stored an id twice
    hits = with_ids(cache, present, id_col, sizes["hits"], sizes["stored"] or 0)
    return hits.withColumn("cached", F.lit(True)).unionByName(stored.withColumn("cached", F.lit(False)))


def _folders(spark: SparkSession, path: str) -> list[str]:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(top):
        return []
    return sorted(f.getPath().toString() for f in store.listStatus(top) if f.isDirectory())


def merge_cache(spark: SparkSession, cache_path: str, id_col: str = "passage_id", fanout: int = FANOUT) -> int:
    """Merge every generation that has ``fanout`` folders into one folder of the next; returns how many merges there were.

    The merged folder is complete before its sources go, so a reader that comes in between finds a vector twice,
    which reads allow for; a run that breaks off leaves nothing out. Reads that began earlier must have ended.
    """
    merges, generation = 0, 0
    while _folders(spark, f"{cache_path}/generation={generation}"):
        folders = _folders(spark, f"{cache_path}/generation={generation}")
        if len(folders) >= fanout:
            merged = spark.read.parquet(*folders).select(id_col, "embedding").dropDuplicates([id_col])
            merged.sortWithinPartitions(id_col).write.parquet(f"{cache_path}/generation={generation + 1}/batch={uuid.uuid4().hex}")
            for one in folders:
                old = spark._jvm.org.apache.hadoop.fs.Path(one)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            merges += 1
        generation += 1
    return merges
