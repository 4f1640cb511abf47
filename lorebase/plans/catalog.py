"""The registered queries of the library, by operator id, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorebase.sources.fixtures import derive, with_derivations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, oracle: str | None = None):
    """Register a function of the given tables as a query (spark, sf_dir), with its DuckDB SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(derive(spark, sf_dir, t) for t in tables))
        if oracle:
            ORACLES[name] = with_derivations(oracle)
        return f

    return register


from lorebase.plans import entities, extraction, facts, graph, ingest, lifecycle, reports, search, streams  # noqa: E402, F401
