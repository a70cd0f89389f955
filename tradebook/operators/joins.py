"""Joins of rows that carry documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Up to this size in bytes, as the planner expects it, a side is left to Spark's own rule. The planner goes by
# compressed files and by 20 bytes a text, and documents are some hundred times as large as it expects.
SMALL = 100_000


def _expected_size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def document_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """The join of rows with documents, or with the keys of as many, that are not broadcast by an estimate.

    Unless a side that may be broadcast is small beyond doubt (of an inner join either one, else the right
    one), both move by a shuffle and no task or driver holds one whole.
    """
    sides = (left, right) if how == "inner" else (right,)
    if min(map(_expected_size, sides)) > SMALL:
        right = right.hint("merge")
    return left.join(right, key, how)
