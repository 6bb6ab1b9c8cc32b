"""From hits to passages: text fetch and context expansion."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from findery.functions.text import source_label
from findery.session import materialize

MAX_BROADCAST_HITS = 1_000_000


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast a table whose row count the caller has proven small; else leave the choice to Spark."""
    return F.broadcast(df) if max_rows is not None and max_rows <= MAX_BROADCAST_HITS else df


#: Ids that share a folder of a stored table, and the column that names the folder.
BLOCK_IDS, BLOCK_COL = 1 << 16, "id_block"
#: Folders that a read names one by one; beyond, all are read.
MAX_BLOCKS = 10_000


def write_blocks(rows: DataFrame, path: str, id_col: str) -> None:
    """A table stored by blocks of neighbouring ids, sorted by id inside: a look-up reads its blocks only."""
    block = F.floor(F.col(id_col) / BLOCK_IDS).cast("long")
    ranged = rows.withColumn(BLOCK_COL, block).repartitionByRange(id_col).sortWithinPartitions(id_col)
    ranged.write.mode("overwrite").partitionBy(BLOCK_COL).parquet(path)


def in_blocks(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The stored blocks that hold an id of ``ids``; a table without blocks comes back as it is.

    ``ids`` is read for it, so pass rows that are stored already.
    """
    if BLOCK_COL not in rows.columns:
        return rows
    found = ids.select(F.floor(F.col(id_col) / BLOCK_IDS).cast("long").alias("b")).distinct().limit(MAX_BLOCKS + 1).collect()
    kept = rows if len(found) > MAX_BLOCKS else rows.where(F.col(BLOCK_COL).isin([r["b"] for r in found]))
    return kept.drop(BLOCK_COL)


def fetch_passages(hits: DataFrame, passages: DataFrame, id_col: str = "index_id",
                   max_hits: int | None = None) -> DataFrame:
    """Passage fields of every hit; a hit without a passage is dropped.

    Text joins only the final hits. With a proven ``max_hits`` the corpus is
    scanned in place and never shuffled.
    """
    fields = passages.select(
        F.col("index_id").alias(id_col), "passage_id", strip(F.col("text")).alias("text"),
        F.col("text").alias("center_text"), source_label(F.col("filename")).alias("source"), "filename", "position",
    )
    return fields.join(bounded(hits, max_hits), id_col)


#: Ids of a block of the expansion (or this many times its reach, if that is more), and hits that a task takes of a block.
HALO_IDS, HALO_REACHES, HALO_HITS = 4096, 4, 100_000


def _answered(cells: DataFrame, reach: int, within: bool, hit_type: StructType, place: list[StructField]) -> DataFrame:
    """(hit, body, filename, position, text): hits with their joined neighbours, from cells in id order.

    A task keeps the texts around the hits it still waits to answer, ``reach`` ids to either side, nothing more.
    """
    schema = StructType([StructField("hit", hit_type), StructField("body", StringType()), *place])
    names = [f.name for f in place]

    def answer(hit: dict, texts: Iterable[dict]) -> dict | None:
        centres = [t for t in texts if t["i"] == hit["i"]]
        if not centres:
            return None
        centre = max(centres, key=lambda t: tuple((t[c] is not None, t[c]) for c in names))
        used = [t["text"] or "" for t in texts if abs(t["i"] - hit["i"]) <= hit["step"]
                and (t["i"] == hit["i"] or t["text"])
                and (not within or (t["side"] is not None and t["side"] == centre["side"]))]
        return {"hit": hit["hit"], "body": " ".join(used), **{c: centre[c] for c in names}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        cell, texts, waiting, made, size = None, deque(), deque(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                moved = cell != (row["block"], row["col"])
                while waiting and (moved or waiting[0]["i"] + reach < row["i"]):
                    if (found := answer(waiting.popleft(), texts)) is not None:
                        made.append(found)
                        size += len(found["body"]) + len(found["text"] or "")
                if moved:
                    cell = (row["block"], row["col"])
                    texts.clear()
                first = (waiting[0]["i"] if waiting else row["i"]) - reach
                while texts and texts[0]["i"] < first:
                    texts.popleft()
                (texts if row["hit"] is None else waiting).append(row)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made, size = [], 0
        made += [found for hit in waiting if (found := answer(hit, texts)) is not None]
        yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return cells.mapInArrow(run, schema)


def expand_context(hits: DataFrame, passages: DataFrame, offset: int | str = 1, within: str | None = None,
                   key_cols: tuple[str, ...] = ("query_id",), id_col: str = "index_id") -> DataFrame:
    """Each hit's text with its ``offset`` neighbours on either side, in id order.

    Missing and empty neighbours are skipped. Neighbours come from the corpus-wide
    id line; ``within='filename'`` (or ``'source'``) stops at that boundary.
    ``offset`` may name a column. ``original_text`` is given for offset 1 only.

    Ids are cut into blocks. A text goes to its own block and, near a border, to the next one too, so
    whatever a hit reaches lies in its block, and a text moves once however many hits need it. Blocks
    without hits are not moved; a block of very many hits is dealt over several cells.
    """
    varies = isinstance(offset, str)
    step = F.col(offset) if varies else F.lit(offset)
    keys = [*key_cols, id_col, *([offset] if varies else [])]
    asked = hits.where(F.col(id_col).isNotNull() & (step >= 0)).select(
        F.col(id_col).cast("long").alias("i"), step.cast("long").alias("step"), F.struct(*keys).alias("hit"))
    reach = int(asked.agg(F.max("step")).first()[0] or 0) if varies else offset
    width = max(HALO_IDS, HALO_REACHES * reach)
    asked = asked.withColumn("block", F.floor(F.col("i") / width))
    grid = materialize(asked.groupBy("block").agg(F.ceil(F.count("*") / HALO_HITS).cast("int").alias("cols")))
    grid = bounded(grid, grid.count())
    asked = asked.join(grid, "block").withColumn("col", F.pmod(F.xxhash64("hit"), F.col("cols")).cast("int"))
    near = passages.select(
        F.col("index_id").cast("long").alias("i"), "text", "filename", "position",
        (F.col(within).cast("string") if within else F.lit(None).cast("string")).alias("side"))
    reached = _few(asked, 2 * reach + 1)
    if reached is not None:  # only texts that some hit reaches
        near = near.join(F.broadcast(reached), "i", "left_semi")
    first, last = (F.floor((F.col("i") + d) / width) for d in (-reach, reach))
    near = near.withColumn("block", F.explode(F.sequence(first, last))).join(grid, "block")
    near = near.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    hit_type = asked.schema["hit"].dataType
    place = [StructField(n, near.schema[n].dataType) for n in ("filename", "position", "text")]
    cells = near.withColumn("hit", F.lit(None).cast(hit_type)).withColumn("step", F.lit(None).cast("long")).drop("cols").unionByName(
        asked.drop("cols"), allowMissingColumns=True)
    cells = cells.repartition("block", "col").sortWithinPartitions("block", "col", "i", F.col("hit").isNotNull(), "text")
    done = _answered(cells, reach, within is not None, hit_type, place)
    out = [F.col(f"hit.{k}").alias(k) for k in keys] + [
        strip(F.col("body")).alias("text"), source_label(F.col("filename")).alias("source"), "filename", "position"]
    if varies:
        out.append(F.when(F.col(f"hit.{offset}") == 1, strip(F.col("text"))).alias("original_text"))
    elif offset == 1:
        out.append(strip(F.col("text")).alias("original_text"))
    return done.select(*out)


def _few(asked: DataFrame, each: int) -> DataFrame | None:
    """The ids within reach of a hit, where a broadcast of them is proven small."""
    if asked.count() * each > MAX_BROADCAST_HITS:
        return None
    half = each // 2
    return asked.select(F.explode(F.sequence(F.col("i") - half, F.col("i") + half)).alias("i")).distinct()
