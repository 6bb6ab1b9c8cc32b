"""Repeatable random draws, taken from a hash of (seed, key, position).

A draw depends on nothing but its arguments, so a retried task or another
partitioning gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def hash32(seed: str, *keys: Column) -> Column:
    """Integer in [0, 2^32): the first eight hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw(seed: str, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, *keys) / F.lit(float(DRAW_RANGE))


def draw_int(low: Column, high: Column, seed: str, *keys: Column) -> Column:
    """Uniform integer in [low, high], both ends included."""
    return low + F.floor(draw(seed, *keys) * (high - low + 1)).cast("long")


# Constants of the position mix: a step, then (factor, prime, mask) per round.
STEP = 2654435769
ROUNDS = ((0x21F0AAAD, 4294967291, 0x9E3779B9), (0x735A2D97, 4294967279, 0x85EBCA6B), (0x21F0AAAD, 4294967291, 0))
MASK32 = DRAW_RANGE - 1


def position_hash(row_hash: Column, i: Column) -> Column:
    """Integer in [0, 2^32) for position ``i``, mixed from one row hash.

    Each round uses its input once, so the expression stays small: multiply, reduce
    by a prime, flip bits.
    """
    x = (row_hash + i.cast("long") * F.lit(STEP)).bitwiseAND(F.lit(MASK32))
    for factor, prime, mask in ROUNDS:
        x = (x * F.lit(factor).cast("long")) % F.lit(prime)
        x = x.bitwiseXOR(F.lit(mask)) if mask else x
    return x


def position_draw(row_hash: Column, i: Column) -> Column:
    """Uniform double in [0, 1) for position ``i``; hash the row once and pass that in."""
    return position_hash(row_hash, i) / F.lit(float(DRAW_RANGE))
