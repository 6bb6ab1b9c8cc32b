"""Second-stage ranking of a query's candidates.

A candidate set is what a search fetched (``fetch_k`` rows at most), so one
query's candidates are a bounded group; queries are what Spark spreads.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.vectors import NORM_FLOOR, cosine, l2_distance
from findery.operators.containment import first_apart
from findery.operators.passages import bounded
from findery.operators.topk import SCORE_DIGITS, rounded


def candidate_l2(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, query_col: str = "query_id",
                 query_vec: str = "query_emb", id_col: str = "vec_id", vec_col: str = "embedding",
                 max_candidates: int | None = None) -> DataFrame:
    """Negative Euclidean distance of given (query, id) candidates.

    With a proven ``max_candidates`` the vectors are scanned in place.
    """
    return (
        vectors.select(id_col, vec_col)
        .join(bounded(candidates.select(query_col, id_col), max_candidates), id_col)
        .join(queries.select(query_col, query_vec), query_col)
        .select(query_col, id_col, (-l2_distance(F.col(query_vec), F.col(vec_col))).alias("neg_l2"))
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    mat = np.array(vectors.tolist(), dtype=np.float64)
    return mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), NORM_FLOOR)


#: Cosines of a query's candidates that a task holds at once.
TILE_CELLS = 1 << 22


def redundancy(mat: np.ndarray, cells: int = TILE_CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit row: largest cosine to another row, to an earlier row, and mean cosine; made tile by tile."""
    n = len(mat)
    other, earlier, mean = np.full(n, -np.inf), np.full(n, -np.inf), np.empty(n)
    tile = max(1, cells // max(1, n))
    for a in range(0, n, tile):
        b = min(n, a + tile)
        sims = np.round(mat[a:b] @ mat.T, SCORE_DIGITS)
        mean[a:b] = sims.mean(axis=1)
        rows = np.arange(a, b)
        sims[rows - a, rows] = -np.inf
        other[a:b] = sims.max(axis=1)
        sims[np.arange(n)[None, :] > rows[:, None]] = -np.inf
        earlier[a:b] = sims.max(axis=1)
    return other, earlier, mean


def pairwise_cosine(candidates: DataFrame, query_col: str = "query_id", id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """Redundancy of each candidate inside its query, from the candidate cosine matrix.

    The matrix is made in tiles of bounded size and never held; per row come its largest
    off-diagonal value, the largest against better-ranked candidates, and its mean.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        other, earlier, mean = redundancy(_unit(pdf[vec_col]))
        pick = lambda m: [None if x == -np.inf else float(x) for x in m]
        return pd.DataFrame({
            query_col: pdf[query_col], "rank": pdf["rank"], id_col: pdf[id_col],
            "max_other": pd.Series(pick(other), dtype="Float64"),
            "max_earlier": pd.Series(pick(earlier), dtype="Float64"), "mean_cosine": mean,
        })

    schema = f"{query_col} long, rank long, {id_col} long, max_other double, max_earlier double, mean_cosine double"
    return candidates.select(query_col, "rank", id_col, vec_col).groupBy(query_col).applyInPandas(one, schema)


def rerank_exact(candidates: DataFrame, query_vec: str, vec_col: str, query_col: str = "query_id",
                 rank_col: str = "rank") -> DataFrame:
    """Reorder by cosine to the query, best first; ties keep the retrieval order.

    A NaN or missing similarity counts as -1. The retrieval score stays on its row.
    """
    sim = cosine(F.col(query_vec), F.col(vec_col))
    safe = F.when(sim.isNull() | F.isnan(sim), F.lit(-1.0)).otherwise(F.round(sim, SCORE_DIGITS))
    w = Window.partitionBy(query_col).orderBy(F.col("exact_score").desc(), F.col(rank_col))
    scored = candidates.withColumn("exact_score", safe)
    return scored.withColumn(rank_col, F.row_number().over(w).cast("long"))


def mmr_order(mat: np.ndarray, relevance: np.ndarray, weight: float, wanted: int,
              digits: int | None = None) -> tuple[list[int], list[float], int]:
    """Greedy picks among unit rows, their scores, and the products of rows it took.

    A candidate's redundancy only grows with the picks, so a score worked out earlier is an upper bound. Candidates
    wait in a heap by such bounds; the first one is brought up to date, and is the next pick if it stays first.
    Scores are compared to nine decimals of the largest one possible, or to ``digits`` decimals, ties by place.
    """
    def shown(x, unit):
        return np.round(x / unit, SCORE_DIGITS) if digits is None else rounded(x, digits)

    size = weight * np.abs(relevance).max(initial=0.0) + (1.0 - weight) or 1.0
    rank = np.abs(relevance).max(initial=0.0) or 1.0
    first = int(np.argmax(shown(relevance, rank))) if len(relevance) else 0
    picks, values, products = ([first], [float(relevance[first])], 0) if wanted and len(relevance) else ([], [], 0)
    closest, seen = np.full(len(mat), -np.inf), np.zeros(len(mat), np.int64)
    bound = shown(weight * relevance + (1.0 - weight), size)  # no cosine is below -1
    heap = [(-b, i) for i, b in enumerate(bound.tolist()) if i != first]
    heapify(heap)
    chosen = mat[picks[:1]] if picks else mat[:0]
    chosen = np.concatenate((chosen, np.empty((max(0, wanted - len(chosen)), mat.shape[1])))) if picks else chosen
    while len(picks) < wanted:
        at = heap[0][1]
        if seen[at] == len(picks):
            heappop(heap)
            chosen[len(picks)] = mat[at]
            picks.append(at)
            values.append(float(weight * relevance[at] - (1.0 - weight) * closest[at]))
            continue
        new = chosen[seen[at]: len(picks)] @ mat[at]
        products += len(new)
        closest[at], seen[at] = max(closest[at], new.max()), len(picks)
        score = weight * relevance[at] - (1.0 - weight) * closest[at]
        heapreplace(heap, (-float(shown(score, size)), at))
    return picks, values, products


def rerank_mmr(candidates: DataFrame, vec_col: str, relevance: str, lambda_relevance: float | None = None,
               lambda_col: str | None = None, limit_col: str | None = None, limit: int | None = None,
               query_col: str = "query_id", id_col: str = "vec_id", rank_col: str = "rank",
               keep: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Maximal marginal relevance: (query, id, rank, mmr_score) and the ``keep`` columns.

    The most relevant candidate first, then repeatedly the one with the largest
    ``lambda * relevance - (1 - lambda) * max cosine to those chosen``. A larger
    lambda therefore favours relevance; it is clamped to [0, 1]. Only as many
    picks as asked for are made, and only candidates that may come next meet the
    picks (:func:`mmr_order`).
    """
    lam = F.lit(lambda_relevance) if lambda_col is None else F.col(lambda_col)
    top = F.lit(limit) if limit_col is None else F.col(limit_col)
    keep = keep or []
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in candidates.schema.fields if f.name in keep)
    chosen = candidates.select(
        F.col(query_col), F.col(id_col), F.col(rank_col).alias("_r"), F.col(relevance).cast("double").alias("_rel"),
        F.col(vec_col).alias("_v"), lam.cast("double").alias("_lam"), top.cast("long").alias("_top"), *keep,
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r", ignore_index=True)
        weight = min(1.0, max(0.0, float(pdf["_lam"].iat[0])))
        wanted = len(pdf) if pd.isna(pdf["_top"].iat[0]) else min(len(pdf), int(pdf["_top"].iat[0]))
        picks, values, _ = mmr_order(_unit(pdf["_v"]), pdf["_rel"].to_numpy(dtype=np.float64), weight, wanted,
                                     digits)
        return pd.DataFrame({
            query_col: pdf[query_col].to_numpy()[picks], id_col: pdf[id_col].to_numpy()[picks],
            "rank": np.arange(1, len(picks) + 1), "mmr_score": values,
            **{c: pdf[c].to_numpy()[picks] for c in keep},
        })

    return chosen.groupBy(query_col).applyInPandas(
        one, f"{query_col} long, {id_col} long, rank long, mmr_score double{kept}"
    )


def drop_redundant(candidates: DataFrame, text_col: str = "text", query_col: str = "query_id",
                   id_col: str = "vec_id", rank_col: str = "rank") -> DataFrame:
    """Walk each query's candidates by rank and drop a text that contains, or lies in, one kept before.

    Containment comes from an index over the texts of the query, in time that follows their length.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank_col, ignore_index=True)
        return pdf.iloc[first_apart(pdf[text_col].tolist())][[query_col, id_col, rank_col]]

    chosen = candidates.select(query_col, id_col, rank_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return chosen.groupBy(query_col).applyInPandas(one, f"{query_col} long, {id_col} long, {rank_col} long")
