"""Row numbers and running sums that never sort a whole group in one task.

A group (a file, a source, a shard) may hold a third of all rows. Every operator
here first cuts the group into ordered blocks, sums the blocks with a partial
aggregation, and only then works inside a block; the block totals form a small
table whose running sum supplies each block's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.session import materialize

BLOCK_ROWS = 1 << 16
MAX_BROADCAST_STARTS = 1_000_000


def _starts(df: DataFrame, keys: list[str], block: str, value: Column) -> DataFrame:
    # Joined with a merge hint: the rows stay hashed by (keys, block). A broadcast the
    # other way round would hand on a partitioning by keys alone, one task per group.
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, block, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_start"))


def blocked_running_sum(
    df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str,
    inclusive: bool = False,
) -> DataFrame:
    """Running sum of ``value`` over ``keys`` in the order (block, order...).

    ``block`` must be monotone in the wanted order and bound the rows that share
    one value of it. The current row counts only when ``inclusive``. Rows without a
    key or block are left out. Where ``block`` is one of the keys, no block comes before
    another, and rows that are hashed by some of the keys stay where they are.
    """
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*dict.fromkeys([*keys, block])).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inside = df.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    if block in keys:
        return inside.dropna(subset=keys).withColumnRenamed("_in", out)
    starts = _starts(df, keys, block, value)
    return (
        inside.join(starts.hint("merge"), [*keys, block])
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_start", "_in")
    )


def blocked_row_number(df: DataFrame, keys: list[str], block: str, order: list[str], out: str) -> DataFrame:
    """1-based row number over ``keys`` in the order (block, order...)."""
    w = Window.partitionBy(*keys, block).orderBy(*order)
    inside = df.withColumn("_in", F.row_number().over(w).cast("long"))
    starts = _starts(df, keys, block, F.lit(1))
    return (
        inside.join(starts.hint("merge"), [*keys, block])
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_start", "_in")
    )


def id_block(id_col: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a dense integer id; holds at most ``rows`` distinct ids.

    Ids with wide gaps give about as many blocks as rows: use the ranged functions for those.
    """
    return F.floor(F.col(id_col) / F.lit(rows)).cast("long")


def ranked_rows(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based rank inside ``keys`` by any order that ends in a unique column.

    Rows are range-partitioned on (keys, order), so a large group spreads over
    many sorted partitions; the partition sizes give each one its start. The
    ranged rows are checkpointed because both passes must see one partitioning.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in keys], *order)
    ranged = materialize(
        spread.sortWithinPartitions(*[F.col(c) for c in keys], *order).withColumn(
            "_p", F.spark_partition_id()
        ).withColumn("_m", F.monotonically_increasing_id())
    )
    firsts = ranged.groupBy(*keys, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select(*keys, "_p", "_first", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_start"))
    if firsts.limit(MAX_BROADCAST_STARTS + 1).count() <= MAX_BROADCAST_STARTS:
        starts = F.broadcast(starts)  # the ranged rows then stay where they are
    return (
        ranged.join(starts, [*keys, "_p"])
        .withColumn(out, F.col("_m") - F.col("_first") + F.col("_start") + 1)
        .drop("_p", "_m", "_first", "_start")
    )


def ranged_running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one, inside ``keys`` in ``order``, for ids of any spacing.

    Range partitions on (keys, order) hold a bounded run of rows each, whatever the ids; their
    totals, one row per key and partition, give the starts.
    """
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in keys], *order).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_p").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_p", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts.hint("merge"), [*keys, "_p"]).withColumn(
        out, F.col("_start") + F.col("_in")).drop("_p", "_start", "_in")
