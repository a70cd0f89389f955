"""Columns worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns (all of `df`'s, or `keep`, come first) by a generator of one row.

    A projection may be merged into the next one or pushed into a filter, which repeats its
    expressions wherever they are used; a long chain over a parsed document then grows without
    bound. The output of a generator is never taken apart. The values are worked out by a projection
    below it, whose code is compiled, as a generator's own is not where it holds a lambda.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_once")
    if keep is None:
        return df.select("*", row).select("*", F.inline(F.array("_once"))).drop("_once")
    return df.select(*keep, row).select(*keep, F.inline(F.array("_once")))
