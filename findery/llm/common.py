"""Helpers shared by the corpus operators: staging, Arrow mapping, text codes, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from findery.session import scratch_path

#: A word is a run of anything but blanks and the ASCII white space of TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, prunes columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) under fixed names, whatever else the table holds; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def map_texts(
    df: DataFrame, text_col: str, make: Callable[[], Callable[[list], dict]], fields: list[StructField],
) -> DataFrame:
    """Add the columns that ``make()(texts)`` returns for each Arrow batch; the text itself is dropped.

    ``make`` runs once per task. Batches are bounded by Spark in rows and bytes.
    """
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            made = work(batch.column(text_col).to_pylist())
            columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in kept]
            columns += [pa.array(made[f.name], arrow.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def fold_texts(
    df: DataFrame, make: Callable[[], object], schema: StructType,
) -> DataFrame:
    """One task-wide accumulator per task: ``add(batch)`` for every batch, then the rows of ``rows()``.

    Ships counts instead of texts; the caller sums them with a normal aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            work.add(batch)
        made = work.rows()
        arrays = [pa.array(made[f.name], f.type) for f in arrow]
        table = pa.Table.from_arrays(arrays, schema=arrow)
        yield from table.to_batches(max_chunksize=1 << 16)

    return df.mapInArrow(run, schema)


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class CodeTable:
    """Maps code points by ``rule``, which gives a text whose first character stands for one.

    The rule runs once for each code point that occurs; the rest is a look-up.
    """

    UNSEEN = 0xFFFFFFFF

    def __init__(self, rule: Callable[[str], str]):
        self.rule, self.table = rule, np.full(0x110000, self.UNSEEN, np.uint32)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.table[at]
        if (new := out == self.UNSEEN).any():
            for c in np.unique(at[new]):
                self.table[c] = ord(self.rule(chr(c))[:1] or " ")
            out = self.table[at]
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash: two multiplications with shifts in between."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every word in an array of bytes, in order."""
    return placed_words(data)[0]


def placed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in an array of bytes, in order, and the place of its first byte.

    A polynomial in an odd base, evaluated over the whole array at once; the part before a
    word is taken off and the power divided out, so equal words hash alike anywhere.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def utf8(text: str) -> np.ndarray:
    """Bytes of a text, ASCII capitals lowered."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the life of a worker and grown on demand."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 17, 1 << int(n).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[k: k + n])
    return total


FILTER_BITS, MOST_FILTER_BITS = 26, 29
_BITMAP_BYTES = 1 << 12  # size of one of Spark's bitmaps


class Filter:
    """One bit for every place that a value of a table falls on: none is missed, others may pass.

    The size is 8 MiB, or more than a byte for each of ``count`` values, at most 64 MiB; on a very large
    table it only lets more pass.
    """

    def __init__(self, values: DataFrame, count: int = 0):
        size = min(max(FILTER_BITS, (8 * count).bit_length()), MOST_FILTER_BITS)
        place = F.col(values.columns[0]).cast("long").bitwiseAND(F.lit((1 << size) - 1))
        placed = values.select(place.alias("p")).where("p is not null")
        parts = placed.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
        bits = bytearray((1 << size) // 8 + 2 * _BITMAP_BYTES)
        for row in parts:  # bitmaps are numbered from 1; 0 holds the place 0 alone
            bits[row["k"] * _BITMAP_BYTES: row["k"] * _BITMAP_BYTES + len(row["bits"])] = row["bits"]
        bits[_BITMAP_BYTES - 1] |= (bits[0] & 1) << 7  # right before place 1, so that places follow each other
        self.shared = values.sparkSession.sparkContext.broadcast(bytes(bits))

    def __getstate__(self):
        return {"shared": self.shared}

    def passes(self, values: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.shared.value, np.uint8)
        last = (len(bits) - 2 * _BITMAP_BYTES) * 8 - 1
        at = (values.astype(np.int64) & last) + (_BITMAP_BYTES * 8 - 1)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def passing(df: DataFrame, column: str, wanted: Filter) -> DataFrame:
    """The rows whose value may be in the filter; nulls never are."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            mask = wanted.passes(values.fill_null(0).to_numpy(zero_copy_only=False))
            if values.null_count:
                mask &= values.is_valid().to_numpy(zero_copy_only=False)
            if mask.any():
                yield batch.filter(pa.array(mask))

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the undirected (a, b) pairs.

    Alternates two contractions, each a grouped minimum and a join: every node hands its larger
    neighbours to its smallest one, then every node hands its smaller ones on likewise. Stars
    remain. Nothing is collected; a node with very many links is a min() with partial sums, and
    each round is staged in the shared folder.
    """
    current = stage(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(),
        label,
    )
    for _ in range(rounds):
        both = current.union(current.select("hi", "lo").toDF("lo", "hi")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("_l")).select("n", F.least("n", "_l").alias("low"))
        large = both.join(low, "n").where("m > n").select(F.col("low").alias("lo"), F.col("m").alias("hi"))
        large = large.where("lo < hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(down, "hi").select(
            F.explode(F.array(
                F.struct(F.col("low").alias("lo"), F.col("hi").alias("hi")),
                F.struct(F.col("low").alias("lo"), F.col("lo").alias("hi")),
            )).alias("e")).select("e.lo", "e.hi").where("lo < hi").distinct()
        following = stage(small, label)
        sums = [
            df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
            for df in (current, following)
        ]
        current = following
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def running_start(df: DataFrame, keys: list[str], order: str, value: str, out: str, label: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one, inside ``keys`` in the order of ``order``.

    Rows are dealt out by ranges of (keys, order), so a key with a third of all rows spreads over
    many sorted partitions; one total per key and partition supplies each partition's start.
    """
    ranged = stage(
        df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), label)
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_at"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    condition = F.col("_part") == F.col("_at")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = joined.join(starts.hint("merge"), condition)
    return joined.select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))
