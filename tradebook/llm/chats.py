"""Logged conversations collapsed to the maximal ones, then rendered; DataFrames only.

A log often holds a conversation again after every turn. Every turn gets a position in its
conversation and a rolling hash of all turns up to it: the exclusive or of two 64-bit hashes of
(position, role, text) over the turns so far. A conversation is a prefix of another just if its last
rolling hash occurs there at the same position. Per (position, rolling hash) the longest conversation
and the least id ending there are enough to tell which conversations are maximal; of equal ones the
one with the least conv_id stays. An anti-join drops all others' turns, and the rest is rendered.

Skew: turns are hashed by conversation *and* a range of turn numbers, and only one sum per range is
brought together by conversation; prefixes are reduced before they are shuffled.

Rules: rows equal in conv_id, turn, role and text are one turn; ties of a turn number go by role and text;
a null turn comes first, null role and text are values of their own and render as empty; rows with a
null conv_id belong to no conversation and are left out; further columns are ignored; no turns give no
rows. A conversation is rendered in parts of up to `PART` turns, so that no row grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pin, written

# Turn numbers per range, and turns per rendered part.
RANGE = 256
PART = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position in the conversation and the rolling hash up to them."""
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("span", F.floor(F.coalesce("turn", F.lit(-1)) / RANGE))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)

    counts = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select(
        "conv_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    counts = written(counts, "turn-counts")
    within = Window.partitionBy("conv_id", "span").orderBy(*order)
    placed = rows.withColumn("nth", F.row_number().over(within)).join(counts, ["conv_id", "span"])
    placed = placed.withColumn("position", F.col("nth") + F.col("ahead"))
    turn = [F.col("position"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    hashed = written(
        placed.withColumn("h1", F.xxhash64(F.lit(1), *turn)).withColumn("h2", F.xxhash64(F.lit(2), *turn))
        .select("conv_id", "span", "position", "role", "text", "h1", "h2"), "turns",
    )
    sums = hashed.groupBy("conv_id", "span").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = written(sums.select("conv_id", "span", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")]), "range-hashes")
    upto = Window.partitionBy("conv_id", "span").orderBy("position")
    return hashed.withColumn("r1", F.bit_xor("h1").over(upto)).withColumn("r2", F.bit_xor("h2").over(upto)).join(
        sums, ["conv_id", "span"]
    ).select("conv_id", "position", "role", "text", F.col("r1").bitwiseXOR(F.col("s1")).alias("h1"),
             F.col("r2").bitwiseXOR(F.col("s2")).alias("h2"))


def render(role: Column, text: Column) -> Column:
    """One turn in the chat markup."""
    empty = F.lit("")
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, empty), F.lit("\n"), F.coalesce(text, empty), F.lit("<|im_end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, position, role, text) of the maximal conversations."""
    pin(conversations.sparkSession)
    turns = written(_turns(conversations), "hashed-turns")
    lengths = written(turns.groupBy("conv_id").agg(F.max("position").alias("length")), "lengths")
    ends = turns.select("conv_id", "position", "h1", "h2").join(lengths, "conv_id")
    last = F.when(F.col("position") == F.col("length"), F.col("conv_id"))
    groups = ends.groupBy("position", "h1", "h2").agg(
        F.max("length").alias("longest"), F.min(last).alias("keeper")
    )
    maximal = groups.filter("keeper is not null and longest = position").select(F.col("keeper").alias("conv_id"))
    gone = written(lengths.select("conv_id").join(written(maximal, "maximal"), "conv_id", "left_anti"), "collapsed")
    return turns.join(gone, "conv_id", "left_anti").select("conv_id", "position", "role", "text")


def chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations in the chat markup: conv_id, part, n_turns, text."""
    turns = collapse(conversations).withColumn("part", F.floor((F.col("position") - 1) / PART))
    return turns.groupBy("conv_id", "part").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", render(F.col("role"), F.col("text")).alias("markup")))),
            lambda t: t["markup"],
        ), "").alias("text"),
    )
