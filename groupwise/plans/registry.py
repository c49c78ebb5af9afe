"""A registry that keeps a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Means of decimal numbers often lie on a rounding edge, where the order of a sum decides. This shift, far below the last digit kept, moves them off it.
EDGE = 1.2345678912e-7


def registry() -> tuple[dict, dict, Callable]:
    queries, oracle = {}, {}

    def add(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
        """rounded: double columns that both sides round."""
        columns = rounded.split()

        def take(f: Callable) -> Callable:
            def run(spark, sf_dir: str) -> DataFrame:
                out = f(spark, sf_dir)
                return out.withColumns({c: F.round(F.col(c) + EDGE, digits) for c in columns}) if columns else out

            queries[name] = run
            if sql:
                swaps = ", ".join(f"round({c} + {EDGE}, {digits}) AS {c}" for c in columns)
                oracle[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if columns else sql
            return f

        return take

    return queries, oracle, add
