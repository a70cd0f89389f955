"""Interleaving of sources to target weights by Pfair scheduling.

A source with `a` of `P` shares has the release time floor(i P / a) and the deadline
ceil((i + 1) P / a) for its block i; in every slot the released block with the earliest deadline goes
next. After any number of slots each source then has its weight's part of them to within less than
one block. The schedule repeats after P slots, so one period, which depends on the shares alone, is
worked out ahead and joined to the documents; which block a document is in is its rank within its
source, counted by ranges of doc_id. When a source runs dry, its later slots are left out and the
others keep their order: all documents are in the mix.

Rules: a source without a share, null included, is in the group `OTHER`; documents go by doc_id (null
first), then by the hash of their text, source and place in the input, so every row counts, also a repeated
one; further columns are ignored; no documents give no rows. Shares are whole numbers above 0, at most `MAX_PERIOD`
in all.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from .common import pin, small, written

BLOCK = 16
OTHER = "(other)"
MAX_PERIOD = 100_000
# Spark's increasing ids hold a row's place within its partition in their lower 33 bits.
PLACE_BITS = 33
# Documents per range.
RANGE_ROWS = 100_000


def period(shares: dict[str, int]) -> list[str]:
    """The source of every slot of one period."""
    total = sum(shares.values())
    if min(shares.values(), default=0) <= 0 or total > MAX_PERIOD:
        raise ValueError(f"shares must be above 0 and at most {MAX_PERIOD} in all")
    released: list[tuple[int, str, int]] = []
    coming = [(0, source, 0) for source in sorted(shares)]
    heapq.heapify(coming)
    slots = []
    for t in range(total):
        while coming and coming[0][0] <= t:
            _, source, i = heapq.heappop(coming)
            heapq.heappush(released, (-(-(i + 1) * total // shares[source]), source, i))
        _, source, i = heapq.heappop(released)
        slots.append(source)
        if i + 1 < shares[source]:
            heapq.heappush(coming, ((i + 1) * total // shares[source], source, i + 1))
    return slots


def schedule(docs: DataFrame, shares: dict[str, int], block: int = BLOCK, other_share: int = 1) -> DataFrame:
    """Per document: doc_id, text_hash, source, mix_group, block, slot, place (its row in the block)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source")
    return _places(rows, shares, block, other_share).select(
        "doc_id", "text_hash", "source", "mix_group", "block", "slot", "place"
    )


def _places(rows: DataFrame, shares: dict[str, int], block: int, other_share: int = 1) -> DataFrame:
    """The schedule of `(doc_id, text_hash, source)`, whose other columns are kept.

    The rows move once, by range of their order, and are written sorted by group, so a row's rank is its
    place in its file and the rows of its group in the files before.
    """
    spark = pin(rows.sparkSession)
    shares = {**shares, OTHER: other_share}
    slots = period(shares)
    seen: dict[str, int] = {}
    table = []
    for t, source in enumerate(slots):
        table.append((source, seen.setdefault(source, 0), t))
        seen[source] += 1
    lookup = F.broadcast(spark.createDataFrame(table, "mix_group string, nth long, at long"))  # one period
    size = F.broadcast(spark.createDataFrame(list(shares.items()), "mix_group string, share long"))

    named = F.when(F.col("source").isin([s for s in shares if s != OTHER]), F.col("source")).otherwise(F.lit(OTHER))
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    order = ["doc_id", "text_hash", "source", "tie"]
    tied = rows.withColumn("mix_group", named).withColumn("tie", F.monotonically_increasing_id())
    dealt = written(
        tied.repartitionByRange(n, *order).sortWithinPartitions("mix_group", *order)
        .withColumn("row_number", F.monotonically_increasing_id()), "ranges",
    ).withColumn("part", F.shiftright("row_number", PLACE_BITS))
    counts = dealt.groupBy("mix_group", "part").agg(F.min("row_number").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("mix_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("mix_group", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("offset")), "offsets")
    ranked = (
        dealt.join(small(offsets, offsets.count()), ["mix_group", "part"])
        .withColumn("rank", F.col("row_number") + F.col("offset")).join(size, "mix_group")
        .withColumn("block", F.floor(F.col("rank") / block)).withColumn("nth", F.col("block") % F.col("share"))
    )
    return ranked.join(lookup, ["mix_group", "nth"]).select(
        *rows.columns, "mix_group", "block",
        (F.floor(F.col("block") / F.col("share")) * len(slots) + F.col("at")).alias("slot"),
        (F.col("rank") % block).alias("place"),
    )


def mixed(docs: DataFrame, shares: dict[str, int], block: int = BLOCK) -> DataFrame:
    """The documents with all their columns, partitions and rows in the order of the mix."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # so that no name of theirs can clash
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", whole)
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // RANGE_ROWS))
    order = ["slot", "place"]
    return _places(rows, shares, block).repartitionByRange(n, *order).sortWithinPartitions(*order).select("row.*")
