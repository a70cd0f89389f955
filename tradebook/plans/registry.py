"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import pin_session
from .standins import check_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under the operator's name; `check` is SQL over the flat tables, `recursive` if a CTE is."""

    def register(run: Query) -> Query:
        def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(pin_session(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = pinned
        if check is not None:
            sql = check_sql(check)
            CHECKS[name] = sql.replace("with ", "with recursive ", 1) if recursive else sql
        return run

    return register


def check_sql(body: str) -> str:
    """The flat tables in front of a SELECT, or of further CTEs if the text starts with a comma."""
    return check_ctes() + body.strip()
