"""Numbered lines of sharded text files.

Lines come with (path, block, seq): their file, the split they begin in and their number
in it. Text is read by planned byte ranges, whose places never change, so it can be read
as often as needed and is never stored again. A small table with one row per split turns
the places into line numbers, byte offsets and corpus-wide ids; only that table is ever
sorted as a whole. Other formats are staged once as parquet, which freezes their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.session import materialize, scratch_path
from findery.sources.ranges import RANGE_BYTES, read_ranges, readable

FILE_PATTERN = r"([^/=]+--raw_passages_\d+-\d+-of-\d+\.jsonl)"
MAX_BROADCAST_SPLITS = 2_000_000


def logical_name(path: Column) -> Column:
    """Passage file name inside a path; a folder of that name counts as one file."""
    named = F.regexp_extract(path, FILE_PATTERN, 1)
    return F.when(named != "", named).otherwise(F.element_at(F.split(path, "/"), -1))


def stage(rows: DataFrame, out: str) -> DataFrame:
    """Freeze the scan order of a file source that carries ``_metadata``."""
    columns = [c for c in rows.columns if c != "_metadata"]
    rows.select(
        logical_name(F.col("_metadata.file_path")).alias("filename"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        *columns,
    ).write.parquet(out)
    return rows.sparkSession.read.parquet(out)


def scan_text(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines below ``path``: filename, path, block, seq, offset in the path, n_bytes (line end included), value.

    Nothing is stored. Only where tasks cannot open the store themselves is the text read by Spark and staged.
    """
    if readable(path):
        return read_ranges(spark, path, range_bytes).withColumn("filename", logical_name(F.col("path")))
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    sized = lines.select("value", (F.octet_length("value") + 1).alias("n_bytes"), "_metadata")
    return with_offsets(stage(sized, scratch_path(spark, "lines")))


def with_offsets(staged: DataFrame) -> DataFrame:
    """Staged lines with ``seq`` and ``offset`` from 0 inside their split; only sizes are shuffled, never text."""
    order = Window.partitionBy("path", "block").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = staged.select("path", "block", "seq", (F.row_number().over(order) - 1).cast("long").alias("_n"),
                           F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("offset"))
    return staged.join(inside, ["path", "block", "seq"]).withColumn("seq", F.col("_n")).drop("_n")


#: First lines of a file that are looked at to tell whether it is valid.
HEAD_LINES = 3


def split_table(lines: DataFrame) -> DataFrame:
    """One row per split: first seq, lines, bytes, offset of its first line, and which of its first lines are no JSON.

    One pass over the text; the table is stored, since numbering reads it several times.
    """
    text = "value" in lines.columns
    broken = F.when(F.col("seq") < HEAD_LINES, F.struct("seq", F.try_parse_json("value").isNull().alias("broken"))) if text else None
    return materialize(lines.groupBy("filename", "path", "block").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n_lines"),
        (F.sum("n_bytes") if text else F.lit(0).cast("long")).alias("split_bytes"),
        (F.min("offset") if text else F.lit(0).cast("long")).alias("first_offset"),
        (F.collect_list(broken) if text else F.array()).alias("head")))


def file_order(deprioritized: list[str]) -> list[Column]:
    """Sort key of passage files: late domains last (in the given order), domain, rank, shard."""
    name = F.col("filename")
    domain = F.split_part(F.split_part(name, F.lit("raw_passages"), F.lit(1)), F.lit("--"), F.lit(1))
    late = F.lit(0)
    for place, one in enumerate(deprioritized, start=1):
        late = F.when(domain == one, place).otherwise(late)
    rank = F.regexp_extract(name, r"passages_(\d+)", 1).try_cast("int")
    shard = F.regexp_extract(name, r"(\d+)-of-", 1).try_cast("int")
    return [late, domain, rank, shard, name]


def with_starts(splits: DataFrame, deprioritized: list[str] | None = None) -> DataFrame:
    """Line and byte start of every split in its file, and its first corpus-wide id."""
    in_file = Window.partitionBy("filename").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy(*file_order(deprioritized or []), "path", "block").rowsBetween(
        Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        splits.withColumn("line_start", zero(F.sum("n_lines").over(in_file)))
        .withColumn("byte_start", zero(F.sum("split_bytes").over(in_file)))
        .withColumn("id_start", zero(F.sum("n_lines").over(overall)))
    )


def attach(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Bring split starts to the lines; the split table is broadcast when its size allows."""
    starts = materialize(starts.select("path", "block", "first_seq", "first_offset", "line_start", "byte_start", "id_start"))
    if starts.count() <= MAX_BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["path", "block"])


def number_lines(lines: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """``line_no`` inside the file, from 0: arithmetic on the places of the lines, no shuffle of the text."""
    numbered = attach(lines, with_starts(split_table(lines) if splits is None else splits))
    return numbered.withColumn("line_no", F.col("line_start") + F.col("seq") - F.col("first_seq"))


def file_validity(splits: DataFrame) -> DataFrame:
    """(filename, valid) from the split table: false when one of the first lines of a file is not JSON."""
    heads = with_starts(splits).select("filename", "line_start", F.explode_outer("head").alias("h"))
    bad = heads.groupBy("filename").agg(F.max(
        (F.col("line_start") + F.col("h.seq") < HEAD_LINES) & F.col("h.broken")).alias("_bad"))
    return bad.select("filename", (~F.coalesce("_bad", F.lit(False))).alias("valid"))


def valid_counts(validity: DataFrame) -> DataFrame:
    return validity.groupBy("valid").agg(F.count("*").alias("n_files"))


def corpus_ids(lines: DataFrame, splits: DataFrame, deprioritized: list[str] | None = None) -> DataFrame:
    """Lines of the valid files with ``index_id`` 0..N-1 in corpus order and their ``line_no``."""
    good = file_validity(splits).where("valid").select("filename")
    numbered = attach(lines, with_starts(splits.join(good, "filename", "left_semi"), deprioritized))
    offset = F.col("seq") - F.col("first_seq")
    return numbered.withColumn("index_id", F.col("id_start") + offset).withColumn(
        "line_no", F.col("line_start") + offset)


def line_offsets(numbered: DataFrame) -> DataFrame:
    """Byte ``position`` of every line in its file: the bytes of the splits before and the place in its own.

    Arithmetic on the lines where they are read; no shuffle.
    """
    return numbered.drop("value").withColumn("position", F.col("byte_start") + F.col("offset") - F.col("first_offset"))
