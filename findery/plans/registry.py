"""Registry of checked queries: the Spark plan beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is left out only where SQL cannot state the answer."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from findery.plans import (  # noqa: F401
        corpus_queries,
        event_queries,
        index_queries,
        ranking_queries,
        search_queries,
        stream_queries,
        text_queries,
        training_queries,
        vector_queries,
    )
