"""How well a predicted order agrees with a gold order.

A ranking is rows ``(list, pos, val)``: at predicted position ``pos`` stands the
item whose gold position is ``val``, both from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.operators.prefix import blocked_running_sum, id_block, ranked_rows

#: Bits of a value inside its block; a block's rows times these stay below those of a block of positions.
LOW_BITS = 12


def ranking_from_scores(scores: DataFrame, list_col: str, item_col: str, score_col: str) -> DataFrame:
    """Order the items of every list by score, best first; equal scores keep the gold order."""
    ranked = ranked_rows(scores.select(list_col, item_col, score_col), [list_col],
                         [F.col(score_col).desc(), F.col(item_col).asc()], "_n")
    return ranked.select(list_col, (F.col("_n") - 1).alias("pos"), F.col(item_col).alias("val"))


def inversions(ranking: DataFrame, list_col: str) -> DataFrame:
    """(list, inversions): pairs that stand in the wrong order, without forming a pair.

    Two values differ first at some bit; the larger one has it set. So for each bit
    and shared higher part, every unset value adds the set values placed before it.
    That is one running count per bit, n log n rows in all.

    Values that differ in their LOW_BITS last bits only lie in one block of values: rows are dealt
    out by list and block, and get their bits where they are. The other bits matter to lists of
    several blocks only. The partitions are as many as the session asks for, because small ones
    that Spark would merge hold LOW_BITS times the rows after that.
    """
    top = ranking.agg(F.max("val")).first()[0] or 0
    n_bits = max(1, int(top).bit_length())
    placed = ranking.where("pos is not null").select(
        list_col, "pos", "val", F.expr(f"shiftright(val, {LOW_BITS})").alias("_values"))

    def marked(rows: DataFrame, bits: range) -> DataFrame:
        return rows.withColumn("_bit", F.explode(F.array(*[F.lit(b) for b in bits]))).select(
            list_col, "_values", "pos", "_bit", F.expr("shiftright(val, _bit + 1)").alias("_high"),
            F.expr("shiftright(val, _bit) & 1").cast("long").alias("_set"))

    parts = int(ranking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = marked(placed.repartition(parts, list_col, "_values"), range(min(n_bits, LOW_BITS)))
    counted = blocked_running_sum(
        low, [list_col, "_values", "_bit", "_high"], "_values", ["pos"], F.col("_set"), "_before")
    if n_bits > LOW_BITS:
        several = placed.groupBy(list_col).agg(F.min("_values").alias("_lo"), F.max("_values").alias("_hi")).where("_lo < _hi")
        high = marked(placed.join(several.select(list_col), list_col, "left_semi"), range(LOW_BITS, n_bits))
        # dealt out anew: the join may hand on a partitioning by list alone, one task per list
        keys = [list_col, "_bit", "_high"]
        high = high.withColumn("_b", id_block("pos")).repartition(*keys, "_b")
        counted = counted.unionByName(
            blocked_running_sum(high, keys, "_b", ["pos"], F.col("_set"), "_before").select(counted.columns))
    return counted.groupBy(list_col).agg(
        F.coalesce(F.sum(F.when(F.col("_set") == 0, F.col("_before"))), F.lit(0)).alias("inversions"))


def overlap_at(ranking: DataFrame, list_col: str, ks: list[int]) -> DataFrame:
    """(list, k, overlap): share of the first k that belongs to the gold first k."""
    cut = ranking.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where("pos < k")
    return cut.groupBy(list_col, "k").agg(F.avg((F.col("val") < F.col("k")).cast("int")).alias("overlap"))


def depth_to_cover(ranking: DataFrame, list_col: str, ks: list[int]) -> DataFrame:
    """(list, k, depth): positions needed to see all of the gold first k; the length if none is there."""
    found = [F.max(F.when(F.col("val") < k, F.col("pos"))).alias(f"_d{k}") for k in ks]
    wide = ranking.groupBy(list_col).agg(F.count("*").alias("_n"), *found)
    pairs = F.array(*[
        F.struct(F.lit(k).cast("long").alias("k"), F.coalesce(F.col(f"_d{k}") + 1, F.col("_n")).alias("depth"))
        for k in ks])
    return wide.select(list_col, F.explode(pairs).alias("_p")).select(list_col, "_p.k", "_p.depth")


def evaluate_ranking(ranking: DataFrame, list_col: str, ks: list[int]) -> DataFrame:
    """Inversions, overlap and depth side by side."""
    return (
        overlap_at(ranking, list_col, ks)
        .join(depth_to_cover(ranking, list_col, ks), [list_col, "k"])
        .join(inversions(ranking, list_col), list_col)
    )
