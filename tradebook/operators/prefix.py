"""Running folds and ranks that never put a whole key into one task.

A plain window over a key sends all its rows to one task, which is right for keys of few rows. The
keys with more rows than a chunk are found first by a count; their rows are sorted by range of key and
position, and cut into chunks along that order, so that a chunk's size does not depend on how far a
key's positions lie apart. A window runs inside each chunk, the chunk totals (one short row each) are
folded by a second, much smaller window, and that carry is joined back. The input is read more than
once, so one that is costly to make is stored first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

# Spark's increasing ids hold a row's place within its partition in their lower 33 bits.
PLACE_BITS = 33

# A chunk has at most 2 ** CHUNK_BITS rows.
CHUNK_BITS = 20


@dataclass(frozen=True)
class HotKeys:
    """The keys with more rows than a chunk (None: there are none), and whether there are no others."""

    keys: DataFrame | None
    alone: bool


NO_HOT_KEYS = HotKeys(None, False)


def hot_keys(df: DataFrame, keys: list[str], bits: int = CHUNK_BITS) -> HotKeys:
    """Counts the rows of each key; what holds for some rows holds for any part of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.col("_n") > 2**bits
    some, others = counts.agg(F.count_if(hot), F.count_if(~hot)).first()
    if not some:
        return NO_HOT_KEYS
    return HotKeys(stored(counts.filter(hot).drop("_n"), "hot"), not others)


def _parts(df: DataFrame, keys: list[str], hot: HotKeys) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the hot keys, and all others."""
    if hot.keys is None:
        return None, df
    if hot.alone:
        return df, None
    return df.join(hot.keys, keys, "left_semi"), df.join(hot.keys, keys, "left_anti")


def chunked(df: DataFrame, keys: list[str], position: str, bits: int = CHUNK_BITS) -> DataFrame:
    """The rows sorted by range of key and position and stored, with the number `_chunk` of their chunk."""
    by = [*keys, position]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(placed, "chunked").withColumn("_chunk", F.shiftright("_at", bits)).drop("_at")


def _fold(how: str, value: Column, position: Column) -> Column:
    if how == "last":
        return F.max_by(value, F.when(value.isNotNull(), position))
    return {"max": F.max, "sum": F.sum}[how](value)


def _running(how: str, value: Column) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True)
    return {"max": F.max, "sum": F.sum}[how](value)


def _combine(how: str, carried: Column, local: Column) -> Column:
    if how == "last":
        return F.coalesce(local, carried)
    if how == "max":
        return F.greatest(carried, local)
    return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))


def _whole(how: str, folded: Column) -> Column:
    """A fold over no rows is null, but a sum is 0."""
    return F.coalesce(folded, F.lit(0)) if how == "sum" else folded


def prefix_fold(
    df: DataFrame,
    keys: list[str],
    position: str,
    folds: dict[str, tuple[str, Column]],
    bits: int = CHUNK_BITS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add `{out: (how, value)}`: the fold of `value` over the rows of the key before this one.

    `how` is max, sum or last (last value that is not null). Keys must not be null and
    `position` must be a whole number, unique within a key. `hot` is given where it is known of the
    rows, or of others that these are part of; else the rows are counted.
    """
    hot = hot_keys(df, keys, bits) if hot is None else hot
    large, others = _parts(df, keys, hot)
    found = [] if large is None else [_fold_by_chunk(chunked(large, keys, position, bits), keys, position, folds)]
    if others is not None:
        whole = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
        found.append(others.select("*", *[_whole(how, _running(how, v).over(whole)).alias(o) for o, (how, v) in folds.items()]))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _fold_by_chunk(
    rows: DataFrame, keys: list[str], position: str, folds: dict[str, tuple[str, Column]]
) -> DataFrame:
    group = [*keys, "_chunk"]
    inside = W.partitionBy(*group).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    between = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)

    local = rows.select(
        "*", *[_running(how, v).over(inside).alias(f"_l_{o}") for o, (how, v) in folds.items()]
    )
    totals = rows.groupBy(*group).agg(
        *[_fold(how, v, F.col(position)).alias(f"_t_{o}") for o, (how, v) in folds.items()]
    )
    carry = totals.select(
        *group,
        *[_running(how, F.col(f"_t_{o}")).over(between).alias(f"_c_{o}")
          for o, (how, _) in folds.items()],
    )
    return local.join(carry, group, "left").select(
        *[F.col(c) for c in rows.columns if c != "_chunk"],
        *[_combine(how, F.col(f"_c_{o}"), F.col(f"_l_{o}")).alias(o)
          for o, (how, _) in folds.items()],
    )


def ranged_rank(
    df: DataFrame, keys: list[str], order: list[Column], out: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Add the row number within a key in the order of `order`, all terms ascending.

    Rows of keys that fit a chunk are numbered by a plain window; all others go by range. Keys must
    not be null.
    """
    terms = {f"_o{i}": term for i, term in enumerate(order)}
    hot = hot_keys(df, keys, bits) if keys else HotKeys(df, True)
    large, others = _parts(df, keys, hot)
    found = [] if large is None else [_rank_by_range(large, keys, terms, out)]
    if others is not None:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        found.append(others.withColumn(out, number.cast("long")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _rank_by_range(df: DataFrame, keys: list[str], terms: dict[str, Column], out: str) -> DataFrame:
    """The rows move once, by range of key and order, and are written sorted, so a row's place in its
    piece is its place in the file. Only the first place and the row count of each key in each piece
    are brought together by key, which are as few as there are pieces.
    """
    by = [*keys, *terms]
    placed = stored(
        df.withColumns(terms).repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id()).drop(*terms), "ranked",
    ).withColumn("_piece", F.shiftright("_at", PLACE_BITS))
    piece = [*keys, "_piece"]
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*piece).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(*piece, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return placed.join(starts, piece).select(
        *[F.col(c) for c in df.columns], (F.col("_at") + F.col("_shift") + 1).cast("long").alias(out)
    )
