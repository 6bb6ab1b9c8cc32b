"""Passage corpora: JSON lines, tab-separated files and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.text import source_label
from findery.schemas import PASSAGE_LINE, TRAINING_EXAMPLE
from findery.session import scratch_path
from findery.sources.lines import stage

QUERY_FIELDS = ("query", "full_text", "question")


def parse_passages(lines: DataFrame) -> DataFrame:
    """JSON lines as passages; a bad line keeps its row with null id and text."""
    parsed = F.from_json("value", PASSAGE_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in lines.columns if c != "value"]
    good = F.col("_p._corrupt").isNull()
    return lines.withColumn("_p", parsed).select(
        *rest, F.when(good, F.col("_p.id")).alias("passage_id"), F.when(good, F.col("_p.text")).alias("text"),
        F.when(good, F.col("_p.title")).alias("title"), source_label(F.col("filename")).alias("source"),
        (~good).alias("corrupt"),
    )


def write_passages(passages: DataFrame, path: str, file_col: str = "passage_file", order_col: str | None = None) -> None:
    """JSON lines, one folder per passage file.

    With ``order_col`` the lines of a file follow it, over all part files. Else rows stay in the tasks that hold them,
    and lines lie as the scan dealt them: a table of several files is not scanned in the order of their names.
    """
    if order_col is not None:
        # a null name would make the writer sort again, by the name alone
        named = passages.withColumn(file_col, F.coalesce(file_col, F.lit("")))
        passages = named.repartitionByRange(file_col, order_col).sortWithinPartitions(file_col, order_col)
    passages.select(file_col, "value").write.partitionBy(file_col).text(path)


def read_tsv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Passages from ``id <tab> text <tab> title``; header rows are dropped.

    Quoted line breaks force whole-file reads; pass ``multiline=False`` for files
    without them, which Spark can then split.
    """
    rows = spark.read.csv(path, schema="id string, text string, title string", sep="\t", quote='"', escape='"',
                          multiLine=multiline, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.where(F.col("id") != "id").select("id", F.coalesce("title", F.lit("")).alias("title"),
                                                  F.coalesce("text", F.lit("")).alias("text"))


def write_tsv(passages: DataFrame, path: str) -> None:
    passages.select("id", "text", "title").write.csv(
        path, sep="\t", quote='"', escape='"', header=True, quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def stage_examples(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Training examples in file order, from JSON lines or from JSON arrays."""
    rows = spark.read.schema(TRAINING_EXAMPLE).option("multiLine", array).json(path)
    return stage(rows.select("*", "_metadata"), scratch_path(spark, "examples"))


def stride(numbered: DataFrame, world_size: int, rank: int, maxload: int | None = None) -> DataFrame:
    """One worker's share: the counter starts at 1 and runs on across files."""
    counted = numbered.withColumn("counter", F.col("id_start") + F.col("seq") - F.col("first_seq") + 1)
    if rank >= 0:
        counted = counted.where(F.pmod("counter", F.lit(world_size)) == rank)
    return counted if not maxload else counted.where(F.col("counter") <= maxload)


def _field(record: Column, name: str) -> Column:
    """A record's field when it would count as present: not empty, zero or false."""
    kind = F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant"))
    text = F.try_variant_get(record, f"$.{name}", "string")
    empty = F.when(kind == "STRING", text == "").otherwise(text.isin("0", "0.0", "false", "[]", "{}"))
    return F.when(text.isNotNull() & ~empty, F.struct((kind == "STRING").alias("is_text"), text.alias("text")))


def query_text(line: Column, json_lines: bool = True) -> Column:
    """Query of one line: a known text field of a JSON record, else the line itself."""
    trimmed = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    if not json_lines:
        return trimmed
    record = F.try_parse_json(trimmed)
    found = F.coalesce(*[_field(record, f) for f in QUERY_FIELDS])
    return F.when(found["is_text"], found["text"]).otherwise(trimmed)


def load_queries(numbered: DataFrame, num_queries: int | None = None, json_lines: bool = True) -> DataFrame:
    """Queries of the first ``num_queries`` lines; blank lines count but give nothing."""
    rows = numbered if num_queries is None else numbered.where(F.col("line_no") < num_queries)
    rows = rows.where(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]+", "") != "")
    return rows.select("line_no", query_text(F.col("value"), json_lines).alias("query"))
