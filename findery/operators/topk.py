"""Inner-product top-k between two vector tables, without emitting the pairs.

* queries are read in blocks of a bounded size (usually there is one); a block is broadcast,
  the corpus is scanned, and every task keeps a running top-k. Many blocks share a scan: a task
  holds a chunk of vectors while the blocks pass over it. A score bar from a few partitions keeps
  what the tasks ship small;
* so many queries that their best rows outweigh the vectors -> the blocks are gathered in cells, every
  cell has a task that all vectors of the scan pass, and a query is finished there: its rows stay where they are;
* many queries over few vectors (centroids, say) -> broadcast those and finish each query row in
  place: no shuffle at all.

A probe list restricts which vectors a query may see (``list_id``), which makes the same code
serve the flat and the inverted-list searches. Scores are compared on a grid that follows the
lengths of both vectors: equal vectors tie exactly, however the rows were batched, the smaller id
then wins, and short vectors are told apart as well as long ones. With ``digits`` scores are rounded to
that many decimals instead, whatever the lengths, which is what SQL's ``round`` compares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.operators.prefix import ranked_rows
from findery.session import materialize

#: Decimals of cosines and other numbers of a fixed scale.
SCORE_DIGITS = 9
#: Cells of the comparison grid per unit of length, as a power of two: about nine decimals.
GRID_BITS = 33
BROADCAST_BYTES = 64 << 20
#: Query vectors that one scan of the corpus serves, and vectors that a task holds while they pass.
SCAN_BYTES, CHUNK_BYTES = 2 << 30, 64 << 20
BAR_PARTITIONS = 16
#: Scores a task makes at once; choosing among them takes about ten times their bytes.
_SCORE_BLOCK = 1 << 20
#: Queries of a cell that are scored together; a cell has so many at least, and more where each core has so many cells.
TILE, CELL_QUERIES, CORE_CELLS = 64, 1 << 10, 4
#: Bytes of a candidate that is shipped.
_HIT_BYTES = 24

#: (list, query positions, block of vectors or codes) -> scores, and a length for each row of the block
Scorer = Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def snap(x: np.ndarray, scale: np.ndarray, other: np.ndarray | float = 1.0) -> np.ndarray:
    """Values on a grid of 2^-GRID_BITS times the next powers of two above ``scale`` and ``other``."""
    up = np.ldexp(1.0, GRID_BITS - np.frexp(scale)[1])
    more = np.ldexp(1.0, -np.frexp(other)[1])
    # powers of two: nothing but the rounding changes a bit
    return np.rint(x * up * more) / up / more


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Values with ``digits`` decimals, halves away from zero as in SQL."""
    scaled = np.asarray(x, dtype=np.float64) * 10.0 ** digits
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0 ** digits


def comparable(x: np.ndarray, scale: np.ndarray, other: np.ndarray | float = 1.0, digits: int | None = None) -> np.ndarray:
    """Values as they are compared: with ``digits`` decimals, or on the grid of their lengths."""
    return snap(x, scale, other) if digits is None else rounded(x, digits)


def lengths(mat: np.ndarray) -> np.ndarray:
    return np.sqrt((mat * mat).sum(axis=1))


def inner_products(qmat: np.ndarray) -> Scorer:
    def score(one: int, rows: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return qmat[rows] @ block.T, lengths(block)

    return score


@dataclass(frozen=True)
class Packed:
    """A small vector table held as arrays, ready to be broadcast."""

    ids: np.ndarray
    matrix: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ids)


def list_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a dense double matrix; ragged input is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or widths.min() != widths.max():
        raise ValueError("vectors must be present and of one dimension")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), int(widths[0]))


def _measure(df: DataFrame, vec_col: str) -> tuple[int, int]:
    found = df.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    return found["n"], max(0, found["d"] or 0)


def pack(df: DataFrame, id_col: str, vec_col: str) -> Packed:
    got = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).toArrow()
    if got.num_rows == 0:
        return Packed(np.empty(0, np.int64), np.empty((0, 0)))
    ids = got.column("i").to_numpy()
    order = np.argsort(ids, kind="stable")
    return Packed(ids[order], list_matrix(got.column("v"))[order])


def pack_if_small(
    df: DataFrame, id_col: str, vec_col: str, max_bytes: int = BROADCAST_BYTES
) -> Packed | None:
    """The table as arrays if it fits the budget, else ``None``; counted before anything is moved."""
    n, dim = _measure(df, vec_col)
    return pack(df, id_col, vec_col) if n * (8 * dim + 8) <= max_bytes else None


def queries_within(max_bytes: int, dim: int, k: int, extra_bytes: int = 0) -> int:
    """How many queries with k best rows and ``extra_bytes`` each fit the budget, one at least."""
    return max(1, max_bytes // (8 * dim + 8 + 16 * k + extra_bytes))


def block_size(
    queries: DataFrame, vec_col: str, k: int, max_bytes: int = BROADCAST_BYTES, extra_bytes: int = 0,
) -> tuple[int, int]:
    """How many queries there are, and how many of them with k best rows and ``extra_bytes`` each fit the budget."""
    n, dim = _measure(queries, vec_col)
    return n, queries_within(max_bytes, dim, k, extra_bytes)


def query_blocks(
    queries: DataFrame, query_col: str, vec_col: str, k: int, max_bytes: int = BROADCAST_BYTES, extra_bytes: int = 0,
) -> Iterator[Packed]:
    """The queries as arrays, in blocks that fit the budget.

    The driver reads one block at a time, of small ones as many as BROADCAST_BYTES hold: a job for each of them would
    cost more than its search.
    """
    n, dim = _measure(queries, vec_col)
    block = queries_within(max_bytes, dim, k, extra_bytes)
    if n <= block:
        yield pack(queries, query_col, vec_col)
        return
    numbered = materialize(ranked_rows(queries.select(query_col, vec_col), [], [F.col(query_col)], "_n"))
    step = block * max(1, BROADCAST_BYTES // (block * (8 * dim + 8)))
    for start in range(0, n, step):
        some = pack(numbered.where(F.col("_n").between(start + 1, start + step)), query_col, vec_col)
        for at in range(0, some.rows, block):
            yield Packed(some.ids[at: at + block], some.matrix[at: at + block])


def rank_in_group(q: np.ndarray) -> np.ndarray:
    """Position of each row within its run of equal values, from 0."""
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    return np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))


def keep_best(q: np.ndarray, s: np.ndarray, i: np.ndarray, k: int):
    """First k of every query by (score desc, id)."""
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    keep = rank_in_group(q) < k
    return q[keep], s[keep], i[keep]


class RunningTopK:
    """Best k of each query seen so far, with the k-th score as an entry bar.

    State is one dense row of k scores and ids per query. A block first loses what is below the
    bars, then one partial selection per query merges the rest in.
    """

    def __init__(self, query_lengths: np.ndarray, k: int, bar: np.ndarray | None = None, digits: int | None = None):
        n = len(query_lengths)
        self.k, self.lengths, self.digits = k, query_lengths, digits
        self.bar = np.full(n, -np.inf) if bar is None else bar.copy()
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, scale: np.ndarray) -> None:
        """Add a block: ``scores[r, j]`` is query ``rows[r]`` against ``ids[j]``, a vector as long as ``scale[j]``."""
        if scores.size == 0:
            return
        near = self.lengths[rows] * (scale.max() * 2.0 ** (3 - GRID_BITS)) if self.digits is None else 10.0 ** -self.digits
        floor = self.bar[rows] - near
        fresh = np.flatnonzero(np.isneginf(floor))
        if scores.shape[1] > self.k and len(fresh):
            # no bar yet: the block's own k-th score, lowered by what rounding and a tie may move
            top = np.partition(scores[fresh], scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k:]
            last = np.minimum(top[:, 0], np.finfo(np.float64).max)
            lowered = last - 2 * np.broadcast_to(near, len(rows))[fresh] - 1e-15 * np.abs(last)
            floor[fresh] = np.where(np.isnan(top).any(axis=1), -np.inf, lowered)  # NaN sorts above all scores
        r, j = np.nonzero(scores >= floor[:, None])
        if not len(r):
            return
        value = comparable(scores[r, j], self.lengths[rows][r], scale[j], self.digits)
        value[~(value >= self.bar[rows][r])] = -np.inf
        # what is left of each query, moved together to the left
        counts = np.bincount(r, minlength=len(rows))
        place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        line = (np.cumsum(counts > 0) - 1)[r]
        rows = rows[counts > 0]
        fresh = np.full((len(rows), counts.max()), -np.inf)
        fresh_ids = np.full(fresh.shape, np.iinfo(np.int64).max)
        fresh[line, place], fresh_ids[line, place] = value, ids[j]
        s = np.concatenate((self.scores[rows], fresh), axis=1)
        i = np.concatenate((self.ids[rows], fresh_ids), axis=1)
        last = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        keep, tied = s > last[:, None], s == last[:, None]
        room = self.k - keep.sum(axis=1)
        for at in np.flatnonzero(tied.sum(axis=1) > room):  # of equal last scores the smaller ids stay
            places = np.flatnonzero(tied[at])
            tied[at, places[np.argsort(i[at, places], kind="stable")[room[at]:]]] = False
        keep |= tied
        self.scores[rows], self.ids[rows] = s[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)
        self.bar[rows] = np.maximum(self.bar[rows], last)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, score, id) of all rows kept, each query's best first."""
        order = np.lexsort((self.ids, -self.scores), axis=1)
        s, i = np.take_along_axis(self.scores, order, 1), np.take_along_axis(self.ids, order, 1)
        q, at = np.nonzero(s > -np.inf)
        return q, s[q, at], i[q, at]


def row_blocks(n_rows: int, n_queries: int) -> Iterator[slice]:
    step = max(1, _SCORE_BLOCK // max(1, n_queries))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def best_per_query(hits: DataFrame, k: int, query_col: str, id_col: str) -> DataFrame:
    """Final cut with a 1-based rank; Spark limits each group before and after the shuffle."""
    w = Window.partitionBy(query_col).orderBy(F.col("score").desc(), F.col(id_col))
    return (
        hits.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= k)
        .select(query_col, "rank", id_col, "score")
    )


def scan_topk(
    vectors: DataFrame,
    queries: Packed,
    k: int,
    id_col: str,
    vec_col: str,
    query_col: str = "query_id",
    probes: dict[int, np.ndarray] | None = None,
    list_col: str = "list_id",
    read: Callable[[pa.Array], np.ndarray] = list_matrix,
    scorer: Callable[[np.ndarray], Scorer] = inner_products,
    bar: np.ndarray | None = None,
    stride: int = 1,
    digits: int | None = None,
) -> DataFrame:
    """Per-task candidates of a broadcast query block over one scan of ``vectors``.

    ``probes`` maps a list to the positions of the queries that look into it; without it every
    query sees every row. ``scorer`` is made once per task from the query matrix. ``bar`` holds a
    score per query below which a row cannot be among its best; ``stride`` reads every n-th
    partition only.
    """
    sc = vectors.sparkSession.sparkContext
    shared = sc.broadcast((queries.ids, queries.matrix, probes, bar))
    columns = [F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")]
    if probes is not None:
        columns.append(F.col(list_col).cast("long").alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % stride:
            return
        qids, qmat, wanted, floor = shared.value
        if len(qids) == 0:
            return
        everyone = np.arange(len(qids))
        running, score = RunningTopK(lengths(qmat), k, floor, digits), scorer(qmat)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mat = read(batch.column(1))
            if wanted is None:
                groups = [(-1, everyone, np.arange(len(ids)))]
            else:
                lists = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(lists, kind="stable")
                names, first = np.unique(lists[order], return_index=True)
                groups = [(int(one), wanted[int(one)], members)
                          for one, members in zip(names, np.split(order, first[1:])) if int(one) in wanted]
            for one, rows, members in groups:
                for part in row_blocks(len(members), len(rows)):
                    pick = members[part]
                    running.offer(rows, (made := score(one, rows, mat[pick]))[0], ids[pick], made[1])
        q, s, i = running.best()
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[q]), pa.array(i), pa.array(s)], names=[query_col, id_col, "score"])

    return vectors.select(*columns).mapInArrow(
        run, f"{query_col} long, {id_col} long, score double"
    )


def scan_blocks(
    vectors: DataFrame, cells: list[Broadcast], block: int, k: int, id_col: str, vec_col: str, query_col: str = "query_id",
    bars: list[np.ndarray] | None = None, stride: int = 1, digits: int | None = None,
) -> DataFrame:
    """Candidates of many query blocks over a single scan of ``vectors``; a cell is a broadcast (ids, matrix) of blocks.

    A task holds CHUNK_BYTES of vectors and lets one block after the other pass over them; what a block finds
    in a chunk is put out at once, so neither the blocks nor their best rows are held together.
    """
    floors = vectors.sparkSession.sparkContext.broadcast(bars)  # one number per query

    def found(ids: np.ndarray, mat: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = lengths(mat)
        for at, shared in enumerate(cells):
            every_id, every = shared.value
            for start in range(0, len(every_id), block):
                qids, qmat = every_id[start: start + block], every[start: start + block]
                bar = None if floors.value is None else floors.value[at][start: start + block]
                running, everyone = RunningTopK(lengths(qmat), k, bar, digits), np.arange(len(qids))
                for part in row_blocks(len(ids), len(qids)):
                    running.offer(everyone, qmat @ mat[part].T, ids[part], sizes[part])
                q, s, i = running.best()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[q]), pa.array(i), pa.array(s)], names=[query_col, id_col, "score"])
            if getattr(shared, "_path", None):
                vars(shared).pop("_value", None)  # read again from the executor's disk for the next chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % stride:
            return
        for ids, mat, _ in chunks(batches):
            yield from found(ids, mat)

    chosen = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    return chosen.mapInArrow(run, f"{query_col} long, {id_col} long, score double")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(ids, matrix, is the last one) of about CHUNK_BYTES of vectors each, from batches of (id, vector, ...)."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if size >= CHUNK_BYTES:
            yield *(np.concatenate(x) for x in zip(*held)), False
            held, size = [], 0
        held.append((batch.column(0).to_numpy(zero_copy_only=False), list_matrix(batch.column(1))))
        size += held[-1][1].nbytes
    if held:
        yield *(np.concatenate(x) for x in zip(*held)), True


def dealt_topk(
    vectors: DataFrame, cells: list[Broadcast], k: int, id_col: str, vec_col: str, query_col: str = "query_id",
    digits: int | None = None,
) -> DataFrame:
    """Ranked best k of each query row: a cell, a broadcast (ids, matrix), has a task, and all vectors pass every task.

    A task holds CHUNK_BYTES of vectors at a time. While there are more to come it keeps k best rows of each query
    of its cell; with the last chunk the queries are finished tile by tile.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[int] = set()

        def checked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own.update(pc.unique(batch.column(2)).to_pylist())
                if len(own) > 1:
                    raise ValueError("a task has one cell of queries")
                yield batch

        qids, state = None, {}
        for ids, mat, last in chunks(checked()):
            if qids is None:
                shared = cells[min(own)]
                qids, qmat = shared.value
                if getattr(shared, "_path", None):
                    vars(shared).pop("_value", None)
            sizes = lengths(mat)
            for start in range(0, len(qids), TILE):
                asking = qmat[start: start + TILE]
                running = state.pop(start, None) or RunningTopK(lengths(asking), k, digits=digits)
                for part in row_blocks(len(ids), TILE):
                    running.offer(np.arange(len(asking)), asking @ mat[part].T, ids[part], sizes[part])
                if not last:
                    state[start] = running
                    continue
                q, s, i = running.best()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[start + q]), pa.array(1 + rank_in_group(q)), pa.array(i), pa.array(s)],
                    names=[query_col, "rank", id_col, "score"])

    each = F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))).alias("c")
    dealt = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"), each)
    return dealt.repartitionById(len(cells), "c").mapInArrow(
        run, f"{query_col} long, rank long, {id_col} long, score double")


def scan_parts(vectors: DataFrame) -> int:
    """Partitions of a scan, as far as the last one with rows."""
    last = vectors.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    return 0 if last is None else last + 1


def scan_stride(parts: int) -> int | None:
    """Every how many partitions one is read for the bars; None where there are too few to need any."""
    return None if parts < BAR_PARTITIONS else math.isqrt(parts)


def kth_scores(some: DataFrame, ids: np.ndarray, k: int, id_col: str, query_col: str) -> np.ndarray:
    """The k-th best score of each query among the rows found so far, minus infinity where there are fewer."""
    found = best_per_query(some, k, query_col, id_col).where(F.col("rank") == k).select(query_col, "score").toArrow()
    bar = np.full(len(ids), -np.inf)
    bar[np.searchsorted(ids, found.column(query_col).to_numpy())] = found.column("score").to_numpy()
    return bar


def entry_bars(vectors: DataFrame, queries: Packed, k: int, *names: str, **how) -> np.ndarray | None:
    """A safe lower bound of every query's k-th best score, from about sqrt(P) of P partitions.

    The k-th best of some rows is never above the k-th best of all, so rows below
    it can be left out of the shuffle without changing the answer. A full scan then
    ships about ``sqrt(P) * k`` rows per query instead of ``P * k``. Few partitions
    need no bar.
    """
    stride = scan_stride(scan_parts(vectors)) if queries.rows else None
    if stride is None:
        return None
    some = scan_topk(vectors, queries, k, *names, stride=stride, **how)
    return kth_scores(some, queries.ids, k, names[0], names[2] if len(names) > 2 else "query_id")


def blocks_topk(
    vectors: DataFrame, blocks: Iterator[Packed], k: int, id_col: str, vec_col: str, query_col: str,
    n_queries: int, block: int, scan_bytes: int = SCAN_BYTES, digits: int | None = None,
) -> DataFrame:
    """Best k of many query blocks: as many blocks as fit ``scan_bytes`` share one scan (and one for their bars).

    Blocks go to the executors' disks as broadcasts of bounded size, cells of small blocks or pieces of large ones; the
    driver keeps ids only. Few queries go to the vectors. Where the rows that tasks would ship outweigh a copy of the vectors for each cell,
    the vectors go to the cells.
    """
    sc, parts = vectors.sparkSession.sparkContext, scan_parts(vectors)
    n_vectors, dim = _measure(vectors, vec_col)
    stride, cores = scan_stride(parts), sc.defaultParallelism
    copy = max(1, n_vectors * (8 * dim + 8))
    shipped = n_queries * min(n_vectors, k * (parts if stride is None else 2 * stride)) * _HIT_BYTES
    most = max(1, min(queries_within(BROADCAST_BYTES, dim, k), scan_bytes // max(1, 8 * dim)))

    def whole_blocks(wanted: int) -> int:
        return block * max(1, min(-(-wanted // block), most // block))

    # queries of a cell: for every core, but no more copies than the rows that they spare
    even = max(min(CELL_QUERIES, -(-n_queries // cores)), -(-n_queries // (CORE_CELLS * cores)),
               -(-n_queries // max(1, shipped // copy)))
    even = min(even, most)
    size = whole_blocks(even) if even >= block else even
    n_cells = -(-n_queries // size)
    dealt = 2 * n_cells >= min(parts, cores) and n_cells * copy <= shipped
    size = size if dealt else whole_blocks(CELL_QUERIES)
    piece = min(size, block)

    def scanned(cells: list[Broadcast], ids: list[np.ndarray]) -> DataFrame:
        if dealt:
            return dealt_topk(vectors, cells, k, id_col, vec_col, query_col, digits)
        bars = None
        if stride is not None:
            every = np.concatenate(ids)  # blocks follow the order of the ids
            some = scan_blocks(vectors, cells, block, k, id_col, vec_col, query_col, stride=stride, digits=digits)
            whole = kth_scores(some, every, k, id_col, query_col)
            bars = np.split(whole, np.cumsum([len(x) for x in ids])[:-1])
        return scan_blocks(vectors, cells, block, k, id_col, vec_col, query_col, bars, digits=digits)

    out, cells, ids, held, taken, last, unique = [], [], [], [], 0, None, True

    def close() -> None:
        nonlocal held, last, unique
        whole = [np.concatenate(x) for x in zip(*held)]
        cells.append(sc.broadcast(tuple(whole)))
        ids.append(whole[0])
        unique = unique and last != whole[0][0] and bool((whole[0][1:] != whole[0][:-1]).all())
        last, held = whole[0][-1], []

    for one in blocks:
        for at in range(0, one.rows, piece):
            held.append((one.ids[at: at + piece], one.matrix[at: at + piece]))
            taken += held[-1][1].nbytes
            if len(held) * piece >= size or taken >= scan_bytes:
                close()
            if taken >= scan_bytes:
                out.append(scanned(cells, ids))
                cells, ids, taken = [], [], 0
    if held:
        close()
    if cells:
        out.append(scanned(cells, ids))
    hits = reduce(DataFrame.unionByName, out)
    # rows of one query id meet in the final cut; a cell has ranked each of its rows by itself
    return hits if dealt and unique else best_per_query(hits, k, query_col, id_col)


def barred_topk(vectors: DataFrame, queries: Packed, k: int, *names: str, **how) -> DataFrame:
    """Candidates of one query block: a few partitions give the bar, then all are scanned."""
    return scan_topk(vectors, queries, k, *names, bar=entry_bars(vectors, queries, k, *names, **how), **how)


def row_topk(
    rows: DataFrame,
    row_id: str,
    row_vec: str,
    small: Packed,
    k: int,
    small_id: str,
    keep: list[str] | None = None,
    max_bytes: int = BROADCAST_BYTES,
    digits: int | None = None,
) -> DataFrame:
    """Each row's best k of a broadcast table, finished inside its own task.

    A table beyond ``max_bytes`` is broadcast in blocks. A task then gathers a chunk of rows, which keep their best
    so far while one block after the other passes over them.
    """
    keep = keep or []
    step = len(small.ids) if small.matrix.nbytes <= max_bytes else max(1, max_bytes // max(1, small.matrix[:1].nbytes))
    sc = rows.sparkSession.sparkContext
    blocks = [sc.broadcast((small.ids[a: a + step], small.matrix[a: a + step])) for a in range(0, len(small.ids), max(1, step))]
    most = min(k, len(small.ids))
    kept = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{row_id} long, " + "".join(f"{c} {kept[c]}, " for c in keep)
    schema += f"rank long, {small_id} long, score double"

    def answered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vecs = list_matrix(batch.column(1))
        sizes = lengths(vecs)
        parts = list(row_blocks(len(vecs), step))
        state = [RunningTopK(sizes[part], most, digits=digits) for part in parts] if len(blocks) > 1 else None
        for at, shared in enumerate(blocks):
            ids, mat = shared.value
            far = lengths(mat)
            for n, part in enumerate(parts):
                running = state[n] if state else RunningTopK(sizes[part], most, digits=digits)
                running.offer(np.arange(part.stop - part.start), vecs[part] @ mat.T, ids, far)
                if at == len(blocks) - 1:
                    q, s, i = running.best()
                    take = pa.array(q + part.start)
                    out = [batch.column(0).take(take)]
                    out += [batch.column(2 + c).take(take) for c in range(len(keep))]
                    out += [pa.array(1 + rank_in_group(q)), pa.array(i), pa.array(s)]
                    yield pa.RecordBatch.from_arrays(out, names=[row_id, *keep, "rank", small_id, "score"])
            if len(blocks) > 1 and getattr(shared, "_path", None):
                vars(shared).pop("_value", None)  # the next chunk reads it from the executor's disk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0 or not blocks:
                continue
            if len(blocks) == 1:
                yield from answered(batch)
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from answered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
        if held:
            yield from answered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    chosen = rows.select(F.col(row_id).cast("long").alias(row_id), F.col(row_vec).alias("_v"), *keep)
    return chosen.mapInArrow(run, schema)


def knn_flat(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query_col: str = "query_id",
    query_vec: str = "query_emb",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    max_bytes: int = BROADCAST_BYTES,
    scan_bytes: int = SCAN_BYTES,
    digits: int | None = None,
) -> DataFrame:
    """Exact inner-product top-k of every query over every vector.

    Beyond one block of queries (``max_bytes``) a small vector table is broadcast instead; over a large one many
    blocks (``scan_bytes`` of query vectors) share a scan. What is shuffled stays in proportion to queries x k, or is
    the vectors once for each cell of queries where that is less.
    ``digits`` compares scores rounded to so many decimals, not on the grid of the lengths.
    """
    n, block = block_size(queries, query_vec, k, max_bytes)
    if n <= block:
        hits = barred_topk(vectors, pack(queries, query_col, query_vec), k, id_col, vec_col, query_col, digits=digits)
        return best_per_query(hits, k, query_col, id_col)
    if (small := pack_if_small(vectors, id_col, vec_col, max_bytes)) is not None:
        done = row_topk(queries, query_col, query_vec, small, k, id_col, digits=digits)
        return done.select(query_col, "rank", id_col, "score")
    return blocks_topk(vectors, query_blocks(queries, query_col, query_vec, k, max_bytes), k, id_col, vec_col, query_col,
                       n, block, scan_bytes, digits)
