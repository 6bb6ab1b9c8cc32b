"""Encoder hook: texts to vectors in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions.text import normalize_punctuation
from findery.functions.vectors import unit

Encoder = Callable[[list[str]], np.ndarray]
MAX_BATCH = 128
MAX_REMEMBERED = 1 << 16


class _Slots(dict):
    """Word to dimension, remembered for the life of a task up to a bound."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        if len(self) < MAX_REMEMBERED:
            self[word] = slot
        return slot


def _encode_words(texts: list[str], slots: _Slots) -> np.ndarray:
    bags = [[slots[w] for w in text.split()] for text in texts]
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = rows * slots.dim + np.array([x for b in bags for x in b], dtype=np.int64)
    out = np.bincount(flat, minlength=len(bags) * slots.dim).reshape(len(bags), slots.dim).astype(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def hashed_words(dim: int = 64) -> Encoder:
    """Deterministic stand-in for a trained encoder: hashed word counts at unit length."""
    return partial(_encode_words, slots=_Slots(dim))


def encoded_rows(texts: pa.Array, encoder: Encoder, step: int) -> np.ndarray:
    """Vectors of a column of texts; only ``step`` texts are Python strings at a time."""
    parts = (texts.slice(a, step).to_pylist() for a in range(0, len(texts), step))
    return np.concatenate([np.asarray(encoder(part), dtype=np.float64) for part in parts])


def embed_texts(
    df: DataFrame, id_col: str, text_col: str, make_encoder: Callable[[], Encoder], batch_size: int = MAX_BATCH,
    instruction: str = "", lower: bool = False, normalize_text: bool = False, normalize: bool = False,
    out: str = "embedding",
) -> DataFrame:
    """(id, embedding) of every row; ``make_encoder`` runs once per task, before its first batch.

    Text rules run in the JVM ahead of the encoder; ``instruction`` is put before
    each text. Only ids and texts travel to Python.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.lower(text) if lower else text
    text = normalize_punctuation(text) if normalize_text else text
    text = F.concat(F.lit(instruction), text) if instruction else text
    step = min(MAX_BATCH, batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            encoder = encoder or make_encoder()
            mat = encoded_rows(batch.column(1), encoder, step)
            offsets = np.arange(0, mat.size + 1, mat.shape[1], dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(mat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    encoded = df.select(id_col, text.alias("_text")).mapInArrow(run, f"{id_col} {kind}, {out} array<double>")
    return encoded.withColumn(out, unit(F.col(out))) if normalize else encoded
