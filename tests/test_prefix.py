"""Chunked folds and ranks against plain windows, with one key holding a third of the rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradebook.operators.prefix import chunked, hot_keys, prefix_fold, ranged_rank


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    value = F.when(F.hash("id") % 4 != 0, F.hash("id") % 100)
    return spark.range(-500, 2500).select(
        key.alias("key"), F.col("id").alias("pos"), value.alias("v")
    )


def same(left, right):
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))


@pytest.mark.parametrize("bits", [0, 3, 6, 16])
def test_folds_equal_windows(rows, bits):
    window = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    plain = rows.select(
        "key", "pos", F.coalesce(F.max("v").over(window), F.lit(-999)).alias("m"),
        F.sum(F.lit(1)).over(window).alias("n"),
        F.coalesce(F.last("v", ignorenulls=True).over(window), F.lit(-999)).alias("l"),
    ).fillna(0, ["n"])
    folded = prefix_fold(rows, ["key"], "pos", {
        "m": ("max", F.col("v")), "n": ("sum", F.lit(1)), "l": ("last", F.col("v")),
    }, bits).select(
        "key", "pos", F.coalesce("m", F.lit(-999)).alias("m"), "n",
        F.coalesce("l", F.lit(-999)).alias("l"),
    )
    same(folded, plain)


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_ranks_equal_windows(spark, rows, keys, partitions):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.floor(F.col("pos") / 500), -F.col("pos")]
        ranked = ranged_rank(rows, keys, order, "rank").select("key", "pos", "rank")
        assert ranged_rank(rows.limit(0), keys, order, "rank").isEmpty()
        ranked.collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    window = W.partitionBy(*keys).orderBy(F.floor(F.col("pos") / 500), -F.col("pos"))
    same(ranked, rows.select("key", "pos", F.row_number().over(window).alias("rank")))


def test_rows_move_by_key_and_chunk(rows):
    """Only the chunk totals, never the rows themselves, are brought together by key alone."""
    plan = prefix_fold(rows, ["key"], "pos", {"m": ("max", F.col("v"))}, 4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in text.splitlines() if "Exchange hashpartitioning(key" in x]
    by_key_alone = [x for x in exchanges if "_chunk" not in x]
    assert len(by_key_alone) == 1 and len(exchanges) >= 3
    below = text[text.index(by_key_alone[0]):].splitlines()[1:3]
    assert any("HashAggregate" in x or "ObjectHashAggregate" in x for x in below)


def test_sparse_positions_make_full_chunks(spark):
    """Chunks follow a key's own rows, however far apart its positions lie."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
        (F.pmod(F.hash("id"), F.lit(7)) + F.col("id") * 1_000_003).alias("pos"), (F.hash("id") % 100).alias("v"),
    )
    hot = hot_keys(rows, ["key"], 4)
    assert [r.key for r in hot.keys.collect()] == ["hot"] and not hot.alone
    large = rows.filter("key = 'hot'")
    sizes = [r["count"] for r in chunked(large, ["key"], "pos", 4).groupBy("key", "_chunk").count().collect()]
    assert max(sizes) <= 16 and len(sizes) <= 1000 // 16 + 16
    window = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    folds = {"m": ("max", F.col("v")), "n": ("sum", F.lit(1))}
    plain = rows.select("key", "pos", F.max("v").over(window).alias("m"), F.coalesce(F.sum(F.lit(1)).over(window), F.lit(0)).alias("n"))
    same(prefix_fold(rows, ["key"], "pos", folds, 4).select("key", "pos", "m", "n").fillna(-999), plain.fillna(-999))


def test_keys_of_few_rows_take_one_window(rows):
    plan = prefix_fold(rows, ["key"], "pos", {"m": ("max", F.col("v"))}, 12)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" not in plan and plan.count("Exchange hashpartitioning(key") == 1


@pytest.mark.parametrize("bits", [0, 5, 9])
def test_ranks_of_hot_and_other_keys(rows, bits):
    order = [F.floor(F.col("pos") / 500), -F.col("pos")]
    window = W.partitionBy("key").orderBy(*order)
    ranked = ranged_rank(rows, ["key"], order, "rank", bits).select("key", "pos", "rank")
    same(ranked, rows.select("key", "pos", F.row_number().over(window).alias("rank")))
