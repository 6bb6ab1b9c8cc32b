"""Quality by importance resampling.

Two generative models of hashed n-grams, one of the texts labelled good and one of all texts, give
each document a log ratio per n-gram. Gumbel noise makes the top k of the noisy weights a sample
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from findery.llm.common import (
    CodeTable, codes, fold_texts, map_texts, running_start, shingles, stage, text_rows, utf8, word_hashes,
)
from findery.llm.langid import gram_buckets

BITS = 14
SIZES = (2, 3)
SMOOTHING = 2.0
#: A document's weight is that of a stretch of so many n-grams of its average kind.
STRETCH = 100.0
#: Labelled rows the good model and the cut are fitted on, of each class; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Marks tell how a word repeats what came before: the word itself or its run of five words.
MARKS = 16


def _shape(c: str) -> str:
    if c.isalpha():
        return c if c == c.lower() else "A"
    return "0" if c.isdigit() else " " if c.isspace() else c


class Grams:
    """Two bags for a text: hashed n-grams of its shape, and n-grams of its repetition marks."""

    def __init__(self):
        self.table = CodeTable(_shape)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """None without a word."""
        raw = codes(text)
        words = word_hashes(utf8(text))
        if not len(words):
            return None
        c = self.table[raw]
        chars = np.bincount(np.concatenate([gram_buckets(c, n, BITS) for n in SIZES]), minlength=1 << BITS)
        again = np.zeros(len(words) + 1, np.int64)
        again[2:] = words[1:] == words[:-1]
        runs = shingles(words, 5)
        _, first = np.unique(runs, return_index=True)
        seen = np.ones(len(runs), np.int64)
        seen[first] = 0
        marks = np.bincount(again[:-1] * 2 + again[1:], minlength=MARKS)
        if len(words) >= 10:
            marks = marks + np.bincount(8 + seen, minlength=MARKS)
        return chars, marks


class _Counts:
    """N-gram counts of one task, by class (-1: not labelled)."""

    def __init__(self):
        self.grams = Grams()
        self.seen = {c: np.zeros((1 << BITS) + MARKS, np.int64) for c in (-1, 0, 1)}

    def add(self, batch: pa.RecordBatch) -> None:
        for label, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist()):
            if (counts := self.grams.counts(text)) is not None:
                self.seen[label] += np.concatenate(counts)

    def rows(self) -> dict:
        made: dict[str, list] = {"quality": [], "bucket": [], "n": []}
        for label, seen in self.seen.items():
            at = np.flatnonzero(seen)
            made["quality"] += [label] * len(at)
            made["bucket"] += at.tolist()
            made["n"] += seen[at].tolist()
        return made


COUNTED = StructType([StructField("quality", LongType()), StructField("bucket", LongType()),
                      StructField("n", LongType())])


@dataclass(frozen=True)
class Model:
    chars: np.ndarray  # log ratio by bucket
    marks: np.ndarray


def _sample(labels: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, quality) of a bounded, hash-chosen sample; an id with both labels is left out."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.min("quality").alias("_least")).where("quality = _least").drop("_least")
    picks = [usable.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
             for v in (0, 1)]
    return picks[0].union(picks[1])


def fit(rows: DataFrame, sample: DataFrame) -> Model | None:
    """Log ratio of the good to the raw model; the raw counts cover every document.

    None without a good example: then nothing can be told apart.
    """
    marked = rows.join(F.broadcast(sample), "doc_id", "left").select(
        F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), "text")
    sums = fold_texts(marked, _Counts, COUNTED).groupBy("quality", "bucket").agg(F.sum("n").alias("n")).toPandas()
    size = (1 << BITS) + MARKS
    good, raw = np.zeros(size), np.zeros(size)
    for label in (-1, 0, 1):
        part = sums[sums["quality"] == label]
        at, n = part["bucket"].to_numpy(dtype=np.int64), part["n"].to_numpy(dtype=np.float64)
        raw[at] += n
        if label == 1:
            good[at] += n
    if not good.any():
        return None

    def ratio(part: slice, groups: list[slice]) -> np.ndarray:
        out = np.zeros(size)
        for g in groups:
            a, b = good[g], raw[g]
            pb = (b + SMOOTHING) / (b + SMOOTHING).sum()
            # the good model falls back on the raw one where it has seen little
            pa_ = (a + SMOOTHING * len(b) * pb) / (a.sum() + SMOOTHING * len(b))
            out[g] = np.log(pa_ / pb)
        return out[part]

    cut = 1 << BITS
    chars = ratio(slice(0, cut), [slice(0, cut)])
    marks = ratio(slice(cut, size), [slice(cut, cut + 8), slice(cut + 8, size)])
    return Model(chars, marks)


def weigh(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, log_weight): the mean log ratio per n-gram, for a stretch of the usual length."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], dict]:
        grams, ratios = Grams(), shared.value

        def one(text: str) -> float:
            counts = grams.counts(text)
            if counts is None:
                return 0.0
            chars, marks = counts
            at = np.flatnonzero(chars)
            mean = float(chars[at] @ ratios.chars[at]) / max(1, int(chars.sum()))
            return STRETCH * (mean + float(marks @ ratios.marks) / max(1, int(marks.sum())))

        return lambda texts: {"log_weight": [one(t or "") for t in texts]}

    return map_texts(rows, "text", make, [StructField("log_weight", DoubleType())])


def _cut(weights: DataFrame, sample: DataFrame) -> float:
    """The log weight that parts the labelled sample best: most of good kept and bad dropped."""
    got = weights.join(F.broadcast(sample), "doc_id").select("quality", "log_weight").toPandas()
    value, good = got["log_weight"].to_numpy(), got["quality"].to_numpy() == 1
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(value, kind="stable")
    value, good = value[order], good[order]
    lost = np.cumsum(good) / good.sum()
    dropped = np.cumsum(~good) / (~good).sum()
    # a good document lost weighs as much as five bad ones let through
    gain = dropped - 5.0 * lost
    best = int(gain.argmax())
    if gain[best] <= 0:
        return float("-inf")
    above = value[best + 1] if best + 1 < len(value) else value[best] + 1.0
    return float((value[best] + above) / 2)


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17,
    k: int | None = None,
) -> DataFrame:
    """The documents drawn: doc_id, log_weight, noisy_weight, rank (1 is the heaviest).

    ``k`` rows are drawn; by default as many as have a weight above the cut that the labels give,
    so the size of the sample follows the corpus. Empty and null texts weigh as the average (0).
    Noise is a hash of (seed, doc_id): reruns agree, repeated rows get equal weights and are drawn
    as rows of their own. Without good labels every document is drawn. Other columns are not read.
    """
    rows = text_rows(docs, id_col, text_col)
    sample = stage(_sample(labels, id_col), "quality-sample")
    model = fit(rows, sample)
    if model is None:
        model = Model(np.zeros(1 << BITS), np.zeros(MARKS))
    weights = stage(weigh(rows, model), "quality-weights")
    if k is None:
        k = weights.where(F.col("log_weight") >= _cut(weights, sample)).count()
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = weights.withColumn("noisy_weight", F.col("log_weight") - F.log(-F.log(unit)))
    # ranks by ranges of the noisy weight: no single task sees all rows
    placed = noisy.select("*", F.lit(0).alias("all_rows"), F.lit(1).alias("one"),
                          F.struct((-F.col("noisy_weight")).alias("w"), F.col("doc_id").alias("d")).alias("place"))
    ranked = running_start(placed, ["all_rows"], "place", "one", "before", "quality-ranks")
    return ranked.where(F.col("before") < k).select(
        "doc_id", "log_weight", "noisy_weight", (F.col("before") + 1).alias("rank"))


def keep_drawn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17,
) -> DataFrame:
    """The drawn documents with all their columns; rows that share an id stay or go together."""
    drawn = resample(docs, labels, id_col, text_col, seed).select(F.col("doc_id").alias("_drawn")).distinct()
    held = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
    return held.join(drawn, held["id"].eqNullSafe(drawn["_drawn"]), "left_semi").select("row.*")
