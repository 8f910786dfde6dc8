"""Every registered query of the report audit with its DuckDB oracle.

Text queries run over reports rendered from the order tables; their oracles compute the answer from the figures, not
from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle if SQL has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["annual_repair"](spark, sf_dir)


from tallyproof.plans import atoms, contracts, exports, facts, forecasts, graphs, jobs, reviews, streams  # noqa: E402, F401  (they register their queries)
