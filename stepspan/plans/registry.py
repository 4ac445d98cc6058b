"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name. Dates come out as text, alike in all clients."""

    def add(f):
        @functools.wraps(f)
        def with_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})

        QUERIES[f.__name__] = with_text_dates
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
