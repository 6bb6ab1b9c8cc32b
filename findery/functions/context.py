"""Canonical search context: what distinguishes one way of searching from another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_context(nprobe: Column, exact: Column, diverse: Column, lam: Column) -> Column:
    """Struct in key order; lambda (two decimals, half up) only counts for a diverse search."""
    return F.struct(
        diverse.cast("boolean").alias("diverse_search"),
        exact.cast("boolean").alias("exact_search"),
        F.when(diverse.cast("boolean"), F.round(lam.cast("double"), 2)).alias("lambda"),
        nprobe.cast("int").alias("nprobe"),
    )


def context_hash(context: Column) -> Column:
    """SHA-1 of the compact JSON; absent fields are left out, no fields gives ``{}``."""
    return F.sha1(F.encode(F.coalesce(F.to_json(context), F.lit("{}")), "UTF-8"))
