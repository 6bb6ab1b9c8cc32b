"""Product quantisation on residuals to the coarse centroid.

A code is one byte per sub-space, kept as ``binary``. The score of a coded vector is
``q . centroid + sum_m (q_m . codeword[m, code_m])``, exact for the decoded vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators.ivf import DEFAULT_NPROBE, build_postings, probed_topk
from findery.operators.kmeans import SUMS_SCHEMA, sums_batch, fold_means, start_vectors
from findery.operators.topk import (
    BROADCAST_BYTES,
    Packed,
    Scorer,
    comparable,
    lengths,
    list_matrix,
)
from findery.session import materialize


@dataclass(frozen=True)
class Codebooks:
    """``words[m, code]`` is a codeword of sub-space ``m``."""

    words: np.ndarray

    @property
    def m(self) -> int:
        return self.words.shape[0]

    def frame(self, spark) -> DataFrame:
        m, n, d = self.words.shape
        return spark.createDataFrame(pa.table({
            "m": pa.array(np.repeat(np.arange(m), n)),
            "code": pa.array(np.tile(np.arange(n), m)),
            "codeword": pa.array(self.words.reshape(m * n, d).tolist()),
        }))


def write_codebooks(spark: SparkSession, books: Codebooks, path: str) -> None:
    books.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def read_codebooks(spark: SparkSession, path: str) -> Codebooks:
    """Stored codebooks: sub-spaces x at most 256 codewords."""
    got = spark.read.parquet(path).toArrow().sort_by([("m", "ascending"), ("code", "ascending")])
    m = len(got.column("m").unique())
    words = list_matrix(got.column("codeword"))
    return Codebooks(words.reshape(m, len(words) // m, -1))


def byte_matrix(column: pa.Array) -> np.ndarray:
    """Codes as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _residuals(mat: np.ndarray, lists: np.ndarray, centroids: Packed) -> np.ndarray:
    return mat - centroids.matrix[np.searchsorted(centroids.ids, lists)]


def nearest_codes(residuals: np.ndarray, words: np.ndarray, digits: int | None = None) -> np.ndarray:
    """Index of the nearest codeword per row and sub-space; ties go to the smaller code."""
    m, _, d = words.shape
    codes = np.empty((len(residuals), m), np.int64)
    for s in range(m):
        part = residuals[:, s * d:(s + 1) * d]
        far = (words[s] ** 2).sum(axis=1)
        gap = far[None, :] - 2.0 * part @ words[s].T
        codes[:, s] = np.argmin(comparable(gap, (part ** 2).sum(axis=1)[:, None] + far.max(), digits=digits), axis=1)
    return codes


def train_codebooks(
    postings: DataFrame, centroids: Packed, m: int, n_words: int, iterations: int = 10,
    id_col: str = "vec_id", vec_col: str = "embedding", seed: str = "codes",
    digits: int | None = None,
) -> Codebooks:
    """Per sub-space Euclidean k-means over residuals; all sub-spaces share each pass.

    A task ships one partial sum per (sub-space, codeword). A codeword without
    members keeps its last value. Pass the postings of the training sample; they
    are stored once and read by every pass. A code is a byte, so there are 256 codewords at most.
    """
    if n_words > 256:
        raise ValueError("a code has one byte")
    postings = materialize(postings.select("list_id", id_col, vec_col))
    sc = postings.sparkSession.sparkContext
    coarse = sc.broadcast((centroids.ids, centroids.matrix))
    residual = residual_table(postings, centroids, id_col, vec_col)
    start = start_vectors(residual, id_col, "residual", n_words, seed)
    dim = start.shape[1] // m
    words = np.stack([start[:, s * dim:(s + 1) * dim] for s in range(m)])
    for _ in range(iterations):
        shared = sc.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value  # noqa: B023
            known = Packed(*coarse.value)
            sums, counts = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                lists = batch.column(0).to_numpy(zero_copy_only=False)
                rest = _residuals(list_matrix(batch.column(1)), lists, known)
                codes = nearest_codes(rest, now, digits)
                for s in range(now.shape[0]):
                    np.add.at(sums[s], codes[:, s], rest[:, s * dim:(s + 1) * dim])
                    counts[s] += np.bincount(codes[:, s], minlength=now.shape[1])
            used = np.flatnonzero(counts.ravel())
            if len(used):
                yield sums_batch(used, counts.ravel()[used], sums.reshape(-1, dim)[used])

        chosen = postings.select(F.col("list_id").cast("long"), F.col(vec_col))
        got = fold_means(chosen.mapInArrow(run, SUMS_SCHEMA)).toArrow()
        fresh = words.reshape(-1, dim).copy()
        if got.num_rows:
            fresh[got.column("g").to_numpy()] = list_matrix(got.column("mean"))
        words = fresh.reshape(words.shape)
        shared.unpersist()
    return Codebooks(words)


def residual_table(postings: DataFrame, centroids: Packed, id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    coarse = postings.sparkSession.sparkContext.broadcast((centroids.ids, centroids.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Packed(*coarse.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            rest = _residuals(list_matrix(batch.column(2)), lists, known)
            offsets = np.arange(0, rest.size + 1, rest.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest.ravel()))],
                names=["list_id", id_col, "residual"],
            )

    chosen = postings.select(F.col("list_id").cast("long"), F.col(id_col).cast("long"), F.col(vec_col))
    return chosen.mapInArrow(run, f"list_id long, {id_col} long, residual array<double>")


def encode(postings: DataFrame, centroids: Packed, books: Codebooks, id_col: str = "vec_id",
           vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(list_id, id, code): a map-only pass with both small tables broadcast."""
    shared = postings.sparkSession.sparkContext.broadcast((centroids.ids, centroids.matrix, books.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat, words = shared.value
        known = Packed(ids, mat)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            codes = nearest_codes(_residuals(list_matrix(batch.column(2)), lists, known), words, digits)
            offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
            body = pa.py_buffer(codes.astype(np.uint8).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), body])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed],
                                             names=["list_id", id_col, "code"])

    chosen = postings.select(F.col("list_id").cast("long"), F.col(id_col).cast("long"), F.col(vec_col))
    return chosen.mapInArrow(run, f"list_id long, {id_col} long, code binary")


def decode(codes: DataFrame, centroids: Packed, books: Codebooks, id_col: str = "vec_id") -> DataFrame:
    """(list_id, id, approx): centroid plus the chosen codewords."""
    shared = codes.sparkSession.sparkContext.broadcast((centroids.ids, centroids.matrix, books.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat, words = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            code = byte_matrix(batch.column(2))
            rest = np.concatenate([words[s][code[:, s]] for s in range(words.shape[0])], axis=1)
            full = mat[np.searchsorted(ids, lists)] + rest
            offsets = np.arange(0, full.size + 1, full.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(full.ravel()))],
                names=["list_id", id_col, "approx"],
            )

    chosen = codes.select(F.col("list_id").cast("long"), F.col(id_col).cast("long"), F.col("code"))
    return chosen.mapInArrow(run, f"list_id long, {id_col} long, approx array<double>")


def knn_ivfpq(
    queries: DataFrame, codes: DataFrame, centroids: Packed, books: Codebooks, k: int,
    nprobe: int | str = DEFAULT_NPROBE,
    query_col: str = "query_id", query_vec: str = "query_emb", id_col: str = "vec_id",
    max_bytes: int = BROADCAST_BYTES,
    digits: int | None = None,
) -> DataFrame:
    """Top-k by table lookup over the probed lists.

    The scan reads codes only; a query's products with all codewords are made once per task.
    """
    shared = codes.sparkSession.sparkContext.broadcast((centroids.ids, centroids.matrix, books.words))

    def scorer(qmat: np.ndarray) -> Scorer:
        ids, mat, words = shared.value
        m, _, d = words.shape
        tables = np.stack([qmat[:, s * d:(s + 1) * d] @ words[s].T for s in range(m)])
        longest = sum(lengths(words[s]).max() for s in range(m))

        def score(one: int, rows: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            centre = mat[np.searchsorted(ids, one)]
            total = np.repeat((qmat[rows] @ centre)[:, None], len(code), axis=1)
            for s in range(m):
                total += tables[s][rows][:, code[:, s]]
            return total, np.full(len(code), np.sqrt(centre @ centre) + longest)

        return score

    return probed_topk(queries, codes, centroids, k, nprobe, query_col, query_vec, id_col, "code", max_bytes,
                       extra_bytes=books.words.shape[0] * books.words.shape[1] * 8, read=byte_matrix, scorer=scorer,
                       digits=digits)


def append_codes(codes: DataFrame, fresh: DataFrame, centroids: Packed, books: Codebooks, id_col: str = "vec_id",
                 vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """Add new vectors to a coded index without touching what is there."""
    coded = encode(build_postings(fresh, centroids, id_col, vec_col, digits), centroids, books, id_col, vec_col, digits)
    return codes.select("list_id", id_col, "code").unionByName(coded)
