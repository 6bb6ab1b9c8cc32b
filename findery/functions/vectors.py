"""Vector arithmetic as column expressions over ``array<float|double>``.

Elements are widened to double before any product, so that a sum does not
depend on how the rows were stored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORM_FLOOR = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, even where a lambda repeats it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(as_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with both norms floored, so a zero vector scores 0."""
    floor = F.lit(NORM_FLOOR)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def unit(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return let(length, lambda n: F.transform(as_double(v), lambda x: x / n))


def is_finite(v: Column) -> Column:
    """True when no element is null, NaN or infinite."""
    inf = F.lit(float("inf"))
    good = F.forall(
        as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    )
    return F.coalesce(good, F.lit(False))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def half_precision(v: pa.Array) -> pa.Array:
    """Round every element to half precision and widen it back to float."""
    flat = v.flatten().to_numpy(zero_copy_only=False)
    rounded = pa.array(flat.astype(np.float16).astype(np.float32))
    lengths = np.nan_to_num(np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rounded, mask=v.is_null())


@F.arrow_udf(T.DoubleType())
def cosine_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """``cosine`` over whole Arrow batches; pays off for long vectors and many rows.

    Rows whose vectors are missing or of different lengths give null.
    """
    wide_a, wide_b = (x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (a, b))
    out = np.full(len(a), np.nan)
    missing = (wide_a != wide_b) | (wide_a < 0)
    for dim in np.unique(wide_a[~missing]):
        rows = np.flatnonzero(~missing & (wide_a == dim))
        x, y = (v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                for v in (a, b))
        lengths = [np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), NORM_FLOOR) for m in (x, y)]
        out[rows] = np.einsum("ij,ij->i", x, y) / (lengths[0] * lengths[1])
    return pa.array(out, mask=missing)
