"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from findery.llm.common import CodeTable, codes, fold_texts, id_crc, map_texts, text_rows

BITS = 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Languages the broadcast matrix is made for: 2^15 buckets of 4 bytes each, 1 GiB at the very most.
MAX_LANGUAGES = 8192


def _letter(c: str) -> str:
    return c.lower() if c.isalpha() else " "


class Grams:
    """Hashed character n-grams of the letters of a text; all else is a gap."""

    def __init__(self, sizes: tuple[int, ...] = SIZES, bits: int = BITS):
        self.sizes, self.bits, self.table = sizes, bits, CodeTable(_letter)

    def counts(self, text: str) -> np.ndarray | None:
        """Occurrences by bucket; None without a letter."""
        c = self.table[codes(text)]
        gap = c == 32
        if gap.all():
            return None
        c = np.concatenate(([32], c[~(gap & np.concatenate(([True], gap[:-1])))], [32])).astype(np.uint32)
        found = [gram_buckets(c, n, self.bits) for n in self.sizes]
        return np.bincount(np.concatenate(found), minlength=1 << self.bits)


def gram_buckets(c: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bucket of every run of ``size`` code points."""
    n = len(c) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h = (h ^ c[k: k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # bucket x language


class _Counts:
    """What one task has seen: documents and n-grams of each language."""

    def __init__(self):
        self.grams, self.seen, self.docs = Grams(), {}, {}

    def add(self, batch: pa.RecordBatch) -> None:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if (counts := self.grams.counts(text)) is not None:
                if lang not in self.seen:
                    self.seen[lang], self.docs[lang] = np.zeros(1 << BITS, np.int64), 0
                self.seen[lang] += counts
                self.docs[lang] += 1

    def rows(self) -> dict:
        langs, buckets, counts = [], [], []
        for lang, seen in self.seen.items():
            at = np.flatnonzero(seen)
            langs += [lang] * (len(at) + 1)
            buckets += [-1, *at.tolist()]
            counts += [self.docs[lang], *seen[at].tolist()]
        return {"lang": langs, "bucket": buckets, "n": counts}


COUNTED = StructType([StructField("lang", StringType()), StructField("bucket", LongType()),
                      StructField("n", LongType())])


def fit(docs: DataFrame) -> Model:
    """Learn from (text, lang); rows without a language or a letter teach nothing.

    Counts cover every row. A task ships one row for each language and bucket it saw, Spark adds
    them up, and the driver takes the sums: languages x buckets of them.
    """
    counted = fold_texts(docs.where("lang is not null").select("lang", "text"), _Counts, COUNTED)
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if (n := sums.where("bucket < 0").count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; the matrix is made for {MAX_LANGUAGES}")
    got = sums.toPandas()
    languages = sorted(got["lang"].unique())
    column = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = got["bucket"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.float64)
    prior, table = np.zeros(len(languages)), np.full((1 << BITS, len(languages)), SMOOTHING)
    prior[column[bucket < 0]] = n[bucket < 0]
    table[bucket[bucket >= 0], column[bucket >= 0]] += n[bucket >= 0]
    return Model(languages, np.log(prior / max(1.0, prior.sum())), np.log(table / table.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score, the posterior of that language; drops the text.

    Without a letter, or when nothing was learned, the language is ``und`` and the score 0. Of
    equal posteriors the first language by code point wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], dict]:
        grams, known = Grams(), shared.value

        def one(text: str) -> tuple[str, float]:
            counts = grams.counts(text) if known.languages else None
            if counts is None:
                return UNKNOWN, 0.0
            at = np.flatnonzero(counts)
            total = known.log_prior + counts[at].astype(np.float64) @ known.log_prob[at]
            best = int(total.argmax())
            return known.languages[best], float(1.0 / np.exp(total - total[best]).sum())

        def work(texts: list) -> dict:
            made = [one(t or "") for t in texts]
            return {"lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

        return work

    return map_texts(docs, text_col, make, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a third of the ids is held out of training.

    Null texts are empty and ``und``; repeated rows are scored alike; an empty table gives no rows.
    """
    held = id_crc() % 3 == 1
    taught = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"),
                         F.col(lang_col).alias("lang")).where(~held)
    rows = text_rows(docs, id_col, text_col).withColumn("held_out", held)
    return predict(rows.select("doc_id", "held_out", "text"), fit(taught))
