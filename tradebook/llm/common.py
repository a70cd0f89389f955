"""What the operators share: written tables, ordered shards, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir

# Arrow batches stay small whatever the length of a text.
PINNED = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# A side with at most this many rows of a few longs may be broadcast.
BROADCAST_ROWS = 1_000_000


def pin(spark: SparkSession) -> SparkSession:
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, kept as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Nodes of `edges` (a, b) with the smallest node reachable, as (node, label).

    Labels hook to smaller labels over edges and then jump to their label's label, so the number of
    rounds is about the logarithm of the longest path. Every round is a few joins on a node and a
    minimum per node, reduced before the shuffle.
    """
    spark = edges.sparkSession
    edges = written(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    ends = edges.select(F.col("a").alias("node"), F.col("a").alias("m")).union(edges.select("b", "a"))
    labels = written(
        ends.union(edges.select("a", "a")).groupBy("node").agg(F.min("m").alias("label")), "labels"
    )
    while True:
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_edges = written(edges.join(la, "a").join(lb, "b").filter("la <> lb"), "open")
        if open_edges.isEmpty():
            return labels
        hooks = (
            open_edges.select(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("label"))
            .union(labels)
            .groupBy("node").agg(F.min("label").alias("label"))
        )
        labels = _jumped(spark, written(hooks, "hooks"))


def _jumped(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """Every node's label followed to its end."""
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(
            labels.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("moved")),
            "jump",
        )
        moved = labels.filter("moved")
        labels = labels.drop("moved")
        if moved.isEmpty():
            return labels
