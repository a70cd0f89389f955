"""Reading and writing tables as Parquet.

A table that changes batch by batch is kept as a base and one set of changed rows per batch, so a
batch writes what it changed and not the whole table. `current` lays the latest changed rows over
the base: where they are few that join is a broadcast and the base is not shuffled. `compact`
writes a new base from time to time. Folders without the writer's success mark are not read, and a
batch that is run again overwrites its own folder only.

Such a table may be laid out by a column, or by a hash of one in a fixed number of buckets. Base and
changes are then partitioned alike, and a reader that names the partitions it needs reads no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

FIRST = -1


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Cuts the lineage like a checkpoint, and later readers take only the columns they need and know
    the size, so that small tables are broadcast.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _complete(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Numbered sub-folders that were written to the end."""
    jvm = spark._jvm
    fs, path = _file_system(spark, folder)
    if not fs.exists(path):
        return {}
    found = {}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        mark = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(prefix) and fs.exists(mark):
            found[int(name[len(prefix):])] = f"{folder}/{name}"
    return found


def complete_batches(spark: SparkSession, folder: str) -> dict[int, str]:
    """Batches written to the end under a folder, with their paths."""
    return _complete(spark, folder, "batch=")


class ChangingTable:
    """A table with a base and changes per batch under one folder, with one row per key.

    `layout` names the column it is laid out by, with `buckets` that column's hash; both are fixed for
    the life of a table. A key's rows must have equal values there. `live` is what a row has to fulfil to
    be there at all, so that a change can take a row away.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: str, key: tuple[str, ...] = ("id",),
        layout: str | None = None, buckets: int = 0, live: str = "true",
    ):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.key, self.layout, self.buckets, self.live = key, layout, buckets, live
        self.partition = "_bucket" if buckets else layout

    def _place(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int") if self.buckets else F.col(column)

    def places(self, df: DataFrame, column: str | None = None) -> list:
        """The partitions that hold the values of a column; as many at most as there are partitions."""
        column = column or self.layout
        found = df.select(self._place(column).alias("_p")).filter("_p is not null").distinct()
        return sorted(r["_p"] for r in found.collect())

    def _write(self, df: DataFrame, path: str) -> None:
        if self.partition is None:
            write_table(df, path)
            return
        placed = df.withColumn("_bucket", self._place(self.layout)) if self.buckets else df
        # Small partitions share a task and large ones are split.
        write_table(placed.hint("rebalance", self.partition), path, (self.partition,))

    def _read(self, base_path: str, paths: list[str], places: list | None, more: str = "") -> DataFrame:
        schema = self.schema + (", _bucket int" if self.buckets else "") + more
        rows = self.spark.read.schema(schema).option("basePath", base_path).parquet(*paths)
        if places is not None:
            # Rows written before a table was laid out have no bucket.
            at = F.col(self.partition)
            rows = rows.filter(at.isin(places) | at.isNull())
        return rows.drop("_bucket")

    def start(self, df: DataFrame, through: int = FIRST) -> None:
        """A base that holds all batches through the given one."""
        self._write(df, f"{self.folder}/base/through={through}")

    def started(self, before: int | None = None) -> bool:
        """Whether there is a base for batch `before`, or any."""
        return any(before is None or n < before for n in _complete(self.spark, f"{self.folder}/base", "through="))

    def write_changes(self, df: DataFrame, batch_id: int) -> None:
        self._write(df, f"{self.folder}/changes/batch={batch_id}")

    def changes(self, batch_id: int) -> DataFrame:
        """The rows that a batch wrote."""
        path = f"{self.folder}/changes/batch={batch_id}"
        return self._read(path, [path], None)

    def current(self, before: int | None = None, places: list | None = None) -> DataFrame:
        """The table as it was when batch `before` began, or as it is now; with `places`, those partitions."""
        bases = _complete(self.spark, f"{self.folder}/base", "through=")
        usable = [n for n in bases if before is None or n < before]
        if not usable:
            raise FileNotFoundError(f"no base under {self.folder}")
        first = bases[max(usable)]
        base = self._read(first, [first], places)
        batches = _complete(self.spark, f"{self.folder}/changes", "batch=")
        later = {
            n: p for n, p in batches.items()
            if n > max(usable) and (before is None or n < before)
        }
        if not later:
            return base.filter(self.live)
        changes = self._read(f"{self.folder}/changes", [path for _, path in sorted(later.items())], places, ", batch int")
        latest = changes.groupBy(*self.key).agg(
            F.max_by(F.struct(*base.columns), "batch").alias("_row")
        ).select("_row.*")
        return base.join(latest.select(*self.key), list(self.key), "left_anti").unionByName(latest).filter(self.live)

    def compact(self, through: int | None = None) -> None:
        """Write a base that holds all complete batches, up to `through` if given, unless it is there.

        A batch that is run again reads the newest base before it, so that one stays with the batches
        after it; folders that are older than it are removed.
        """
        batches = _complete(self.spark, f"{self.folder}/changes", "batch=")
        last = max((n for n in batches if through is None or n <= through), default=FIRST)
        bases = _complete(self.spark, f"{self.folder}/base", "through=")
        if last not in bases:
            self.start(self.current(last + 1), last)
        earlier = max((n for n in bases if n < last), default=FIRST)
        self._remove("base", {n: p for n, p in bases.items() if n < earlier})
        self._remove("changes", {n: p for n, p in batches.items() if n <= earlier})

    def _remove(self, part: str, folders: dict[int, str]) -> None:
        fs, _ = _file_system(self.spark, f"{self.folder}/{part}")
        for path in folders.values():
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
