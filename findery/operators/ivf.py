"""Inverted-list index as two tables: ``centroids`` and ``postings``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.functions.draws import hash32
from findery.operators.kmeans import assign, packed_frame, train_centroids
from findery.operators.passages import bounded
from findery.operators.topk import (
    BROADCAST_BYTES,
    Packed,
    RunningTopK,
    Scorer,
    barred_topk,
    best_per_query,
    block_size,
    inner_products,
    lengths,
    list_matrix,
    pack,
    row_blocks,
    row_topk,
)
from findery.session import materialize

DEFAULT_NPROBE = 32
#: Neighbouring lists that share a folder, and the column that names it.
GROUP_LISTS, GROUP_COL = 64, "list_group"
SAMPLE_BLOCKS = 1 << 16
#: Postings, and queries with their best rows, that a cell of a list holds.
CELL_BYTES = 32 << 20


def train_sample(
    vectors: DataFrame, sample_size: int, n_shards: int, shard_col: str = "shard_id",
    id_col: str = "vec_id", seed: str = "sample",
) -> DataFrame:
    """``sample_size // n_shards`` rows of every shard without replacement, all of a smaller shard.

    Rows are ordered by a hash draw, and the draw's high bits cut a shard into
    blocks. Block counts tell which block holds a shard's last wanted row: rows of
    earlier blocks are taken where they lie, and only that one block is ranked.
    """
    per_shard = sample_size // n_shards
    drawn = vectors.withColumn("_d", hash32(seed, F.col(id_col))).withColumn(
        "_b", F.floor(F.col("_d") / ((1 << 32) // SAMPLE_BLOCKS)).cast("long"))
    sizes = drawn.groupBy(shard_col, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_start") < per_shard)
    cuts = reach.groupBy(shard_col).agg(
        F.max("_b").alias("_cut"), (per_shard - F.max("_start")).alias("_room"))  # one row per shard
    placed = drawn.join(bounded(cuts, n_shards), shard_col)
    edge = Window.partitionBy(shard_col).orderBy("_d", id_col)
    sure = placed.where(F.col("_b") < F.col("_cut"))
    last = placed.where(F.col("_b") == F.col("_cut")).withColumn("_n", F.row_number().over(edge))
    last = last.where(F.col("_n") <= F.col("_room")).drop("_n")
    return sure.unionByName(last).drop("_d", "_b", "_cut", "_room")


def train_coarse(sample: DataFrame, n_lists: int, iterations: int = 10, **names) -> Packed:
    return train_centroids(sample, n_lists, iterations, **names)


def probed_lists(queries: DataFrame, centroids: Packed, nprobe: int | str, query_col: str, query_vec: str,
                 keep: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """(query, list_id, ...): the ``nprobe`` best lists of every query, chosen in the tasks that read the queries.

    ``nprobe`` is one number, or a column whose nulls mean the default. Centroids are broadcast: as many as were
    trained.
    """
    depth = F.lit(nprobe) if isinstance(nprobe, int) else F.coalesce(F.col(nprobe), F.lit(DEFAULT_NPROBE))
    asked = queries.withColumn("_depth", depth.cast("long"))
    deepest = nprobe if isinstance(nprobe, int) else asked.agg(F.max("_depth")).first()[0] or 1
    near = row_topk(asked, query_col, query_vec, centroids, deepest, "list_id", ["_depth", *(keep or [])], digits=digits)
    return near.where(F.col("rank") <= F.col("_depth")).select(query_col, "list_id", *(keep or []))


def probes_of(queries: DataFrame, packed: Packed, centroids: Packed, nprobe: int | str, query_col: str,
              query_vec: str, digits: int | None = None) -> dict[int, np.ndarray]:
    """For each list, the positions of the packed queries whose best centroids include it."""
    pairs = probed_lists(queries, centroids, nprobe, query_col, query_vec, digits=digits).toArrow()  # a block's queries x nprobe
    lists, at = pairs.column("list_id").to_numpy(), np.searchsorted(packed.ids, pairs.column(query_col).to_numpy())
    order = np.lexsort((at, lists))
    names, first = np.unique(lists[order], return_index=True)
    return {int(one): rows for one, rows in zip(names, np.split(at[order], first[1:]))}


def build_postings(vectors: DataFrame, centroids: Packed, id_col: str = "vec_id",
                   vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """Every vector with its list; a map-only pass."""
    return assign(vectors, centroids, id_col, vec_col, keep=[vec_col], digits=digits).select("list_id", id_col, vec_col)


def append_postings(postings: DataFrame, fresh: DataFrame, centroids: Packed, id_col: str = "vec_id",
                    vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """Add new vectors to a trained index without touching what is there."""
    return postings.unionByName(build_postings(fresh, centroids, id_col, vec_col, digits))


def write_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings or codes stored by groups of neighbouring lists, sorted by list inside each file.

    A probe reads the folders of its lists only, and inside them the row groups of its lists. Some
    lists share a folder, which bounds the number of files. No shuffle on ``list_id``: a hot list
    is written by every task that holds rows of it.
    """
    grouped = postings.withColumn(GROUP_COL, F.floor(F.col("list_id") / GROUP_LISTS).cast("int"))
    grouped.sortWithinPartitions("list_id").write.mode(mode).partitionBy(GROUP_COL).parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Stored postings or codes; the folder column stays, so that a probe can prune on it."""
    return spark.read.parquet(path)


def write_centroids(spark: SparkSession, centroids: Packed, path: str) -> None:
    packed_frame(spark, centroids, "list_id", "centroid").coalesce(1).write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str) -> Packed:
    """Stored centroids; as many as were trained, so they fit where training held them."""
    return pack(spark.read.parquet(path), "list_id", "centroid")


def knn_ivf(
    queries: DataFrame,
    postings: DataFrame,
    centroids: Packed,
    k: int,
    nprobe: int | str = DEFAULT_NPROBE,
    query_col: str = "query_id",
    query_vec: str = "query_emb",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    max_bytes: int = BROADCAST_BYTES,
    digits: int | None = None,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Top-k over the ``nprobe`` best lists of each query; ``nprobe`` may name a column.

    Postings that are stored by list (:func:`write_postings`) are read only where a query looks.
    """
    return probed_topk(queries, postings, centroids, k, nprobe, query_col, query_vec, id_col, vec_col, max_bytes,
                       digits=digits, cell_bytes=cell_bytes)


def probed_topk(
    queries: DataFrame, postings: DataFrame, centroids: Packed, k: int, nprobe: int | str, query_col: str,
    query_vec: str, id_col: str, vec_col: str, max_bytes: int, extra_bytes: int = 0,
    read: Callable[[pa.Array], np.ndarray] = list_matrix, scorer: Callable[[np.ndarray], Scorer] = inner_products,
    digits: int | None = None, cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Top-k of every query over the lists it probes.

    One block of queries (``max_bytes``) is broadcast and meets the lists where they lie. More of them meet their
    lists in a join by list. A list that fills one cell (``cell_bytes``) is moved once; one of R x C cells moves its
    queries R times and its postings C times, so cells are as large as a task's memory allows, not as a block.
    """
    n, block = block_size(queries, query_vec, k, max_bytes, extra_bytes)
    if n > block:
        hits = list_join(queries, postings, centroids, k, nprobe, query_col, query_vec, id_col, vec_col, cell_bytes,
                         read, scorer, digits)
        return best_per_query(hits, k, query_col, id_col)
    packed = pack(queries, query_col, query_vec)
    probes = probes_of(queries, packed, centroids, nprobe, query_col, query_vec, digits) if packed.rows else {}
    named = [int(x) for x in probes]
    probed = postings.where(F.col("list_id").isin(named))
    if GROUP_COL in postings.columns:
        probed = probed.where(F.col(GROUP_COL).isin(sorted({x // GROUP_LISTS for x in named})))
    hits = barred_topk(probed, packed, k, id_col, vec_col, query_col, probes=probes, read=read, scorer=scorer,
                       digits=digits)
    return best_per_query(hits, k, query_col, id_col)


def list_join(
    queries: DataFrame, postings: DataFrame, centroids: Packed, k: int, nprobe: int | str, query_col: str,
    query_vec: str, id_col: str, vec_col: str, cell_bytes: int, read: Callable[[pa.Array], np.ndarray],
    scorer: Callable[[np.ndarray], Scorer], digits: int | None = None,
) -> DataFrame:
    """Candidates of any number of queries: queries and postings of a list meet in cells of bounded size.

    Queries find their lists in tasks. A list of many postings or many queries is cut into a grid: postings are
    dealt over its rows by their id and queries over its columns by theirs, so a hot list becomes many cells. A
    cell keeps the k best of each of its queries.
    """
    pairs = materialize(probed_lists(queries, centroids, nprobe, query_col, query_vec, [query_vec], digits))
    probing = pairs.groupBy("list_id").agg(F.count("*").alias("_m"))
    sizes = postings.groupBy("list_id").agg(F.count("*").alias("_n"))
    width = max(1, centroids.matrix.shape[1] if centroids.matrix.size else 1)
    most = max(1, cell_bytes // (8 * width))  # rows of a cell, and queries of a cell
    most_queries = max(1, cell_bytes // (8 * width + 16 * k))
    grid = sizes.join(probing, "list_id").select(
        "list_id", F.ceil(F.col("_n") / most).cast("int").alias("_rows"), F.ceil(F.col("_m") / most_queries).cast("int").alias("_cols"))
    grid = materialize(grid)
    if GROUP_COL in postings.columns:  # folders of lists that nobody probes are not read
        groups = grid.select(F.floor(F.col("list_id") / GROUP_LISTS).cast("int").alias("g")).distinct().collect()
        postings = postings.where(F.col(GROUP_COL).isin([r["g"] for r in groups]))
    grid = bounded(grid, centroids.rows)
    asked = pairs.join(grid.select("list_id", "_rows", "_cols"), "list_id").select(
        "list_id", F.col(query_col).alias("q"), F.col(query_vec).alias("v"),
        F.pmod(F.xxhash64(query_col), F.col("_cols")).cast("int").alias("_col"), F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_row"))
    held = postings.join(grid, "list_id").select(
        "list_id", F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"),
        F.pmod(F.xxhash64(id_col), F.col("_rows")).cast("int").alias("_row"),
        F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("_col"))
    names = [query_col, id_col, "score"]

    def cell(asking: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        if asking.num_rows == 0 or found.num_rows == 0:
            return empty
        qids, qmat = asking.column("q").to_numpy(), list_matrix(asking.column("v"))
        order = np.argsort(qids, kind="stable")
        qids, qmat = qids[order], qmat[order]
        running, score, everyone = RunningTopK(lengths(qmat), k, digits=digits), scorer(qmat), np.arange(len(qids))
        ids, one = found.column("i").to_numpy(), int(found.column("list_id")[0].as_py())
        vectors = read(found.column("v").combine_chunks())
        for part in row_blocks(len(ids), len(qids)):
            made, scale = score(one, everyone, vectors[part])
            running.offer(everyone, made, ids[part], scale)
        q, s, i = running.best()
        return pa.table([pa.array(qids[q]), pa.array(i), pa.array(s)], names=names)

    key = ["list_id", "_row", "_col"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        cell, f"{query_col} long, {id_col} long, score double")


def index_stats(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """List sizes beside the two totals that must agree."""
    n_vectors = vectors.count()
    sizes = postings.groupBy("list_id").agg(F.count("*").alias("list_size"))
    # one row per list: the running total over them is a small table
    everything = Window.partitionBy()
    return sizes.select(
        "list_id", "list_size", F.sum("list_size").over(everything).alias("n_indexed"),
        F.lit(n_vectors).cast("long").alias("n_vectors"),
    ).withColumn("complete", F.col("n_indexed") == F.col("n_vectors"))


@dataclass(frozen=True)
class IvfIndex:
    centroids: Packed
    postings: DataFrame

    def centroid_table(self) -> DataFrame:
        return packed_frame(self.postings.sparkSession, self.centroids, "list_id", "centroid")


def build_index(vectors: DataFrame, n_lists: int, sample_size: int, n_shards: int = 1,
                shard_col: str | None = None, iterations: int = 10, id_col: str = "vec_id",
                vec_col: str = "embedding", digits: int | None = None) -> IvfIndex:
    """Sample, train, assign."""
    base = vectors if shard_col else vectors.withColumn("shard_id", F.lit(0))
    sample = train_sample(base, sample_size, n_shards, shard_col or "shard_id", id_col)
    centroids = train_coarse(sample, n_lists, iterations, id_col=id_col, vec_col=vec_col, digits=digits)
    return IvfIndex(centroids, build_postings(vectors, centroids, id_col, vec_col, digits))
