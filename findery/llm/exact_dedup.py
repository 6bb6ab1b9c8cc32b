"""Exact duplicates by a content sort.

Sampled splitters cut the order of the normalised texts into ranges, every range is sorted
externally, equal texts meet as neighbours, and each row is compared in full with the one before.
Column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.common import stage

#: Splitters hold only this many leading characters and a hash, so the sample the driver sees stays small.
LEAD_CHARS = 32
#: A text's copies are sorted as this many runs, so that one text may hold a third of all rows.
RUNS = 1024


def unchanged(text: Column) -> Column:
    return text


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is the empty text. Of equal texts the smallest (or largest) id stays; a null id
    stays only where no other is there. Of rows that repeat an id and a text exactly one is kept.
    An empty table gives no rows; other columns are never looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.max if keep == "largest" else F.min
    first = F.desc_nulls_last if keep == "largest" else F.asc_nulls_last
    body = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    rows = rows.select(
        "doc_id", "body", F.substring("body", 1, LEAD_CHARS).alias("lead"), F.xxhash64("body").alias("hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).alias("run"),
    )
    # The ranges are cut by (lead, hash, run); the window below needs no other exchange.
    sorted_rows = Window.partitionBy("lead", "hash", "run").orderBy("body", first("doc_id"))
    compared = rows.repartitionByRange("lead", "hash", "run").select(
        "doc_id", "run", F.unhex(F.sha2("body", 256)).alias("sha"),
        F.coalesce(F.col("body") != F.lag("body").over(sorted_rows), F.lit(True)).alias("head"),
    )
    compared = stage(compared, "exact")
    runs = compared.groupBy("sha", "run").agg(best("doc_id").alias("best"), F.count("*").alias("n"))
    # At most RUNS rows per text meet here.
    whole = Window.partitionBy("sha")
    groups = runs.select("sha", "run", best("best").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("n"))
    return compared.join(groups, ["sha", "run"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("head") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """The documents that stay, with all their columns; one row of each (id, text) that repeats."""
    groups = duplicate_groups(docs, id_col, text_col, keep, normalise).where("kept")
    wanted = groups.select(F.struct("doc_id", F.unhex("text_sha256").alias("sha")).alias("key"))
    body = normalise(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("sha"))
    # one key for both steps, so the texts move once; a struct of nulls equals its like
    held = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return held.join(wanted.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
