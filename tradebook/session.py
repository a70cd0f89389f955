"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Calendar arithmetic is done in UTC, a repeated JSON key keeps its last value, and a join
# partition holding a hot key is split even where that costs one more exchange.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def pin_session(spark: SparkSession) -> SparkSession:
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one in the warehouse, which they share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder path under the shared one."""
    return f"{shared_dir(spark)}/tradebook/{label}-{uuid.uuid4().hex}"
