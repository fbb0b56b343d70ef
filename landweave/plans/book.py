"""A list of named queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, doubles: Sequence[str] = ()) -> Callable[[Query], Query]:
        """Register a query under its function's name; ``doubles`` are rounded to six places on both sides."""

        def put(f: Query) -> Query:
            name = f.__name__

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in doubles}) if doubles else df

            self.queries[name] = run
            if sql is not None:
                parts = ", ".join(f"round({c}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in doubles)
                self.sql[name] = f"SELECT * REPLACE ({parts}) FROM ({sql})" if doubles else sql
            return f

        return put
