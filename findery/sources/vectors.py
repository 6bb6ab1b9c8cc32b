"""Vector shards on disk: load, convert, verify, split and combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.functions.vectors import is_finite
from findery.operators.passages import bounded
from findery.operators.prefix import blocked_row_number, id_block
from findery.schemas import EMBEDDING_LINE

SHARD_NAME = r"passages_(\d+)"


def shard_number(path: Column) -> Column:
    """Shard id inside a file name such as ``passages_07.parquet``."""
    return F.regexp_extract(path, SHARD_NAME, 1).cast("int")


def shard_name(shard_id: Column) -> Column:
    return F.concat(F.lit("passages_"), F.lpad(shard_id.cast("string"), 2, "0"))


def chunk_ids(vectors: DataFrame, shard_col: str = "shard_id", id_col: str = "vec_id") -> DataFrame:
    """Position of every vector inside its shard, from 0."""
    blocked = vectors.withColumn("_b", id_block(id_col))
    numbered = blocked_row_number(blocked, [shard_col], "_b", [id_col], "_n")
    return numbered.withColumn("chunk_id", F.col("_n") - 1).drop("_b", "_n")


def write_shards(vectors: DataFrame, path: str, shard_col: str = "shard_id") -> None:
    """One folder per shard; rows are not moved, so a large shard is written by many tasks."""
    vectors.withColumn("shard", shard_name(F.col(shard_col))).drop(shard_col).write.partitionBy("shard").parquet(path)


def load_shards(spark: SparkSession, path: str, local_id: str, vec_col: str = "embedding",
                shard_id: int | None = None) -> DataFrame:
    """Shards as one table; local ids are shifted by the sizes of the shards before.

    With ``shard_id`` only that shard's folder is read, but its ids keep the global offset.
    """
    raw = spark.read.parquet(path).withColumn("shard_id", shard_number(F.col("shard")))
    sizes = raw.groupBy("shard_id").agg(F.count("*").alias("_t"))
    before = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard
    starts = sizes.select("shard_id", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    wanted = raw if shard_id is None else raw.where(F.col("shard") == f"passages_{shard_id:02d}")
    return (
        wanted.join(starts, "shard_id")
        .withColumn("index_id", F.col("_start") + F.col(local_id))
        .withColumn(vec_col, F.col(vec_col).cast("array<float>"))
        .drop("_start", "shard")
    )


def conversion_report(vectors: DataFrame, files: DataFrame, existing: DataFrame | None = None,
                      file_col: str = "file", vec_col: str = "embedding") -> DataFrame:
    """Per-file status of a conversion: (file, ok, rows, message).

    A file fails as a whole on any non-finite vector or when it holds no rows; a
    file whose output exists is skipped and counts as done.
    """
    seen = vectors.groupBy(file_col).agg(
        F.count("*").alias("rows"), F.count(F.when(~is_finite(F.col(vec_col)), 1)).alias("_bad")
    )
    report = files.select(file_col).distinct().join(seen, file_col, "left")
    done = F.lit(False)
    if existing is not None:
        report = report.join(existing.select(file_col).distinct().withColumn("_done", F.lit(True)), file_col, "left")
        done = F.coalesce(F.col("_done"), F.lit(False))
    rows = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    bad = F.coalesce(F.col("_bad"), F.lit(0))
    name = F.col(file_col)
    message = (
        F.when(done, F.concat(F.lit("skip (exists) "), name))
        .when(bad > 0, F.concat(F.lit("error: Non-finite value (NaN/Inf) in "), name))
        .when(rows == 0, F.lit("no rows"))
        .otherwise(F.concat(F.lit("ok (rows="), rows.cast("string"), F.lit(")")))
    )
    return report.select(name, (done | ((bad == 0) & (rows > 0))).alias("ok"), rows.alias("rows"),
                         message.alias("message"))


def write_converted(vectors: DataFrame, report: DataFrame, path: str, id_col: str = "vec_id",
                    vec_col: str = "embedding", file_col: str = "file") -> None:
    """JSON lines ``{"id", "embedding"}`` of the files that passed, one folder per file."""
    good = report.where(F.col("ok") & F.col("message").startswith("ok")).select(file_col)
    (
        vectors.join(good, file_col, "left_semi")
        .select(file_col, F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("embedding"))
        .write.partitionBy(file_col).json(path)
    )


def read_converted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING_LINE).json(path)


def verify_prefix(source: DataFrame, written: DataFrame, first: int, file_col: str = "file",
                  id_col: str = "vec_id", vec_col: str = "embedding", tolerance: float = 1e-6) -> DataFrame:
    """Compare the first rows of each file with what was written: (file, need, matched, ok).

    Ids alone are numbered; vectors are read for the chosen rows.
    """
    ids = source.select(file_col, id_col).withColumn("_b", id_block(id_col))
    head = blocked_row_number(ids, [file_col], "_b", [id_col], "_n").where(F.col("_n") <= first)
    most = source.select(file_col).distinct().count() * first
    near = source.select(file_col, id_col, vec_col).join(bounded(head.select(file_col, id_col), most), [file_col, id_col])
    head = near.select(file_col, F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("_a"))
    back = written.select(file_col, "id", F.col("embedding").cast("array<double>").alias("_w"))
    gap = F.zip_with("_a", "_w", lambda a, w: F.abs(a - w) <= tolerance + tolerance * F.abs(a))
    close = (F.size("_a") == F.size("_w")) & F.forall(gap, lambda x: F.coalesce(x, F.lit(False)))
    found = back.join(bounded(head.select(file_col, "id"), most), [file_col, "id"])
    return (
        head.join(found, [file_col, "id"], "left")
        .groupBy(file_col)
        .agg(F.count("*").alias("need"), F.count(F.when(close, 1)).alias("matched"))
        .withColumn("ok", F.col("need") == F.col("matched"))
    )


def vectors_per_chunk(chunk_bytes: int, dim: int) -> int:
    return chunk_bytes // (4 * dim)


def split_vectors(vectors: DataFrame, per_chunk: int, index_col: str = "index_id") -> DataFrame:
    """Contiguous chunks by arithmetic on the dense index id: no shuffle."""
    return vectors.withColumn("chunk_id", F.floor(F.col(index_col) / F.lit(per_chunk)).cast("long"))


def split_metadata(vectors: DataFrame, per_chunk: int, dim: int, index_type: str) -> DataFrame:
    total = F.count("*")
    return vectors.agg(
        F.ceil(total / F.lit(per_chunk)).cast("long").alias("n_chunks"),
        F.lit(dim).cast("long").alias("dim"),
        total.alias("total_vectors"),
        F.lit(per_chunk).cast("long").alias("vectors_per_chunk"),
        F.lit(index_type).alias("index_type"),
    )


def write_chunks(chunked: DataFrame, metadata: DataFrame, path: str) -> None:
    chunked.write.partitionBy("chunk_id").parquet(f"{path}/chunks")
    metadata.write.json(f"{path}/metadata")


def combine_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks as one table; a missing or short chunk is an error."""
    chunks = spark.read.parquet(f"{path}/chunks")
    wanted = spark.read.json(f"{path}/metadata").first()
    got = chunks.agg(F.countDistinct("chunk_id").alias("n"), F.count("*").alias("rows")).first()
    if (got["n"], got["rows"]) != (wanted["n_chunks"], wanted["total_vectors"]):
        raise ValueError(
            f"incomplete split: {got['n']} of {wanted['n_chunks']} chunks, "
            f"{got['rows']} of {wanted['total_vectors']} vectors"
        )
    return chunks
