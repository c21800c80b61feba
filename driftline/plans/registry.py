"""Queries by name, and their SQL where there is one."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Decimal places of the doubles that queries and SQL return.
PLACES = 6


def query(sql: str = "", doubles: str = ""):
    """Registers a function of (spark, sf_dir) under its name. Doubles are rounded; sql's are those named in doubles."""

    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, PLACES) for c, t in df.dtypes if t == "double"})

        QUERIES[f.__name__] = run
        if sql:
            names = doubles.split()
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, {PLACES}) AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return put
