"""Centroid training and vector means as map-side partial sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions.draws import DRAW_RANGE, hash32
from findery.functions.vectors import NORM_FLOOR
from findery.operators.topk import BROADCAST_BYTES, Packed, comparable, lengths, list_matrix, row_blocks, row_topk
from findery.session import materialize

SUMS_SCHEMA = "g long, n long, s array<double>"


def sums_batch(groups: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(
        pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel())
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(groups.astype(np.int64)), pa.array(counts.astype(np.int64)), flat], names=["g", "n", "s"]
    )


#: Tasks whose partial sums one level of a fold brings together.
FOLD_TASKS = 256


def _folded(partials: DataFrame, means: bool, by: list[str]) -> DataFrame:
    """Sums (or means) of the partial sums of a group that share the columns ``by``, merged batch by batch.

    Sums travel as whole arrays, sorted by group; only the open group is held back.
    """

    def out(groups: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return sums_batch(groups, counts, sums / counts[:, None] if means else sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            groups, counts = g[first], np.add.reduceat(n, first)
            sums = np.add.reduceat(list_matrix(batch.column(2)), first, axis=0)
            if held is not None and held[0][0] == groups[0]:
                counts[0] += held[1][0]
                sums[0] += held[2][0]
            elif held is not None:
                yield out(*held)
            if len(groups) > 1:
                yield out(groups[:-1], counts[:-1], sums[:-1])
            held = (groups[-1:], counts[-1:].copy(), sums[-1:].copy())
        if held is not None:
            yield out(*held)

    ordered = partials.repartition(*by).sortWithinPartitions(*reversed(by))
    return ordered.select("g", "n", "s").mapInArrow(run, SUMS_SCHEMA)


def fold_means(partials: DataFrame, tasks: int = FOLD_TASKS) -> DataFrame:
    """Add up partial sums per group: (g, n, mean).

    Sums of more tasks than one level takes are added up in two: first those of some tasks, then what these give.
    No task meets more than about the square root of a group's partial sums.
    """
    n = partials.rdd.getNumPartitions()
    if n > tasks:
        part = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(n) + 1))
        partials = _folded(partials.withColumn("p", part), False, ["g", "p"])
    return _folded(partials, True, ["g"]).withColumnRenamed("s", "mean")


#: Bytes of group sums that a task holds back before it ships them.
HELD_BYTES = 64 << 20


def group_means(vectors: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """Mean vector per group (``g, n, mean``); a task ships one sum per group, as far as they fit its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g, mat = batch.column(0).to_numpy(zero_copy_only=False), list_matrix(batch.column(1))
            n = np.ones(len(g), np.int64)
            if held is not None:
                g, n, mat = (np.concatenate(x) for x in zip(held, (g, n, mat)))
            groups, where = np.unique(g, return_inverse=True)
            sums, counts = np.zeros((len(groups), mat.shape[1])), np.zeros(len(groups), np.int64)
            np.add.at(sums, where, mat)
            np.add.at(counts, where, n)
            held = (groups, counts, sums)
            if sums.nbytes > HELD_BYTES:
                yield sums_batch(*held)
                held = None
        if held is not None:
            yield sums_batch(*held)

    chosen = vectors.select(F.col(group_col).cast("long").alias("g"), F.col(vec_col).alias("v"))
    return fold_means(chosen.mapInArrow(run, SUMS_SCHEMA))


def start_vectors(vectors: DataFrame, id_col: str, vec_col: str, n: int, seed: str) -> np.ndarray:
    """Matrix of the ``n`` vectors with the smallest hash draws, in draw order.

    The draw looks at ids only; vectors are read for the chosen ids. ``n`` rows
    reach the driver, as the centroids do anyway.
    """
    drawn = vectors.select(F.col(id_col).cast("long").alias("i"), hash32(seed, F.col(id_col)).alias("d"))
    # draws are even, so few of them can be among the n smallest; only those are sorted
    total = vectors.count()
    likely = drawn.where(F.col("d") < F.lit(int(DRAW_RANGE * min(1.0, (2 * n + 1000) / max(1, total)))))
    chosen = (likely if likely.count() >= n else drawn).orderBy("d", "i").limit(n)
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    got = rows.join(F.broadcast(chosen), "i").toArrow().sort_by([("d", "ascending"), ("i", "ascending")])
    return list_matrix(got.column("v"))


def unit_rows(mat: np.ndarray) -> np.ndarray:
    return mat / np.maximum(np.sqrt((mat * mat).sum(axis=1, keepdims=True)), NORM_FLOOR)


def train_centroids(
    vectors: DataFrame,
    n_lists: int,
    iterations: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: str = "coarse",
    max_bytes: int = BROADCAST_BYTES,
    digits: int | None = None,
) -> Packed:
    """Spherical k-means: assign by inner product, average, scale to unit length.

    One job per iteration. A task returns one partial sum per centroid, so what
    is shuffled depends on ``n_lists`` and the number of tasks, not on the rows.
    Centroids beyond ``max_bytes`` are broadcast in blocks: vectors keep their best one so far
    while the blocks pass, and tasks ship sums whenever they hold enough.
    The sample is drawn once and read from the shared folder by every pass. A centroid that loses all members keeps its last position.
    """
    vectors = materialize(vectors.select(id_col, vec_col))
    centroids = unit_rows(start_vectors(vectors, id_col, vec_col, n_lists, seed))
    if centroids.nbytes > max_bytes:
        return _train_in_blocks(vectors, centroids, iterations, id_col, vec_col, max_bytes, digits)
    sc = vectors.sparkSession.sparkContext
    for _ in range(iterations):
        shared = sc.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current = shared.value  # noqa: B023
            sizes = lengths(current)
            sums, counts = np.zeros(current.shape), np.zeros(len(current), np.int64)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                whole = list_matrix(batch.column(0))
                for part in row_blocks(len(whole), len(current)):
                    mat = whole[part]
                    owner = np.argmax(comparable(mat @ current.T, lengths(mat)[:, None], sizes, digits), axis=1)
                    np.add.at(sums, owner, mat)
                    counts += np.bincount(owner, minlength=len(current))
            used = np.flatnonzero(counts)
            if len(used):
                yield sums_batch(used, counts[used], sums[used])

        got = fold_means(vectors.select(F.col(vec_col).alias("v")).mapInArrow(run, SUMS_SCHEMA)).toArrow()
        fresh = centroids.copy()
        if got.num_rows:
            fresh[got.column("g").to_numpy()] = list_matrix(got.column("mean"))
        centroids = unit_rows(fresh)
        shared.unpersist()
    return Packed(np.arange(len(centroids), dtype=np.int64), centroids)


def _train_in_blocks(vectors: DataFrame, centroids: np.ndarray, iterations: int, id_col: str, vec_col: str, max_bytes: int,
                     digits: int | None = None) -> Packed:
    """Steps of k-means for centroids that no task can hold at once."""
    for _ in range(iterations):
        known = Packed(np.arange(len(centroids), dtype=np.int64), centroids)
        owned = row_topk(vectors, id_col, vec_col, known, 1, "list_id", [vec_col], max_bytes, digits)
        got = group_means(owned, "list_id", vec_col).toArrow()
        centroids = centroids.copy()
        if got.num_rows:
            centroids[got.column("g").to_numpy()] = list_matrix(got.column("mean"))
        centroids = unit_rows(centroids)
    return Packed(np.arange(len(centroids), dtype=np.int64), centroids)


def packed_frame(spark, packed: Packed, id_col: str, vec_col: str) -> DataFrame:
    """A small packed table as a DataFrame again."""
    rows = pa.table({id_col: pa.array(packed.ids.astype(np.int64)), vec_col: pa.array(packed.matrix.tolist())})
    return spark.createDataFrame(rows)


def assign(vectors: DataFrame, centroids: Packed, id_col: str = "vec_id", vec_col: str = "embedding",
           keep: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Best centroid of every vector by inner product; ties go to the smaller list."""
    best = row_topk(vectors, id_col, vec_col, centroids, 1, "list_id", keep, digits=digits)
    return best.drop("rank")
