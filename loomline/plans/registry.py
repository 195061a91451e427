"""Named queries with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function ``(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        from loomline.plans.tables import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables.of(spark, sf_dir))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            # Adding zero turns a negative zero left by rounding into zero on both sides.
            ORACLES[name] = re.sub(r"(,\s*\d+\))( ELSE [0-9.]+)?( END)? AS (?!DATE|VARCHAR|BIGINT|DOUBLE)", r"\1 + 0.0\2\3 AS ", sql)
        return fn

    return wrap
