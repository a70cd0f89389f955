"""Streams: capture of deliveries, their application to the tables, and newly made bookings.

The tables of records are laid out by a hash of their ids. Beside them is a table of the keys that
records are found by (reference, e-mail, phone), each with the record's id, its customer and, for a
reference, the newest modification text applied; it is laid out by a hash of the key. A batch writes
the keys its changes bring and take away. So the next one reads the keys that its events name and the
buckets of the records these lead to, and a late event is refused by the text beside its reference
without a document being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bookings import new_bookings, parsed_pairs
from ..operators.deliveries import capture_raw_event, project_events
from ..operators.prefix import CHUNK_BITS, prefix_fold
from ..operators.matching import customer_keys, job_keys, key_rows
from ..operators.replay import Snapshot, replay_on
from ..schemas import CUSTOMERS, DELIVERIES, JOBS, LINK, LinkFields
from ..sources.tables import ChangingTable, complete_batches, write_table

CAPTURED = (
    "seq long, tenant_id long, received_at timestamp, content_type string, is_json boolean, "
    "payload string, raw_text string"
)
VERSIONS = "id long, customer_id long, version long, data_json string"
KEYS = "key string, is_customer boolean, id long, owner long, stored string, held boolean"

# Buckets of the tables, and of the keys; fixed for the life of a table. They set the least part of a
# table that a batch reads, so they are to grow with the tables.
BUCKETS = 64


def _trigger(writer, continuous: str | None):
    if continuous:
        return writer.trigger(processingTime=continuous)
    return writer.trigger(availableNow=True)


def stream_capture(
    spark: SparkSession, landing_dir: str, captured_dir: str, checkpoint: str,
    continuous: str | None = None, max_files: int = 1000,
) -> StreamingQuery:
    """Deliveries landed as JSON lines, appended to the capture table whatever their body is."""
    landed = (
        spark.readStream.schema(DELIVERIES).option("maxFilesPerTrigger", max_files)
        .json(landing_dir)
    )
    writer = capture_raw_event(landed).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    return _trigger(writer, continuous).start(captured_dir)


def crm_tables(
    spark: SparkSession, tables_dir: str, buckets: int = BUCKETS,
) -> tuple[ChangingTable, ChangingTable]:
    return (
        ChangingTable(spark, f"{tables_dir}/jobs", JOBS, layout="id", buckets=buckets),
        ChangingTable(spark, f"{tables_dir}/customers", CUSTOMERS, layout="id", buckets=buckets),
    )


def key_table(spark: SparkSession, tables_dir: str, buckets: int = BUCKETS) -> ChangingTable:
    """The keys that jobs and customers are found by; a key that a record lost is no longer held."""
    return ChangingTable(
        spark, f"{tables_dir}/keys", KEYS, ("key", "is_customer", "id"), "key", buckets, "held",
    )


def _keys_of(jobs: DataFrame, customers: DataFrame, link: LinkFields) -> DataFrame:
    return key_rows(job_keys(jobs, link), customer_keys(customers, link))


def published(spark: SparkSession, tables_dir: str) -> int | None:
    """The last batch whose tables, keys and actions are all written."""
    return max(complete_batches(spark, f"{tables_dir}/published"), default=None)


def published_tables(spark: SparkSession, tables_dir: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Jobs and customers as the last published batch left them, whatever a later one is writing."""
    last = published(spark, tables_dir)
    before = None if last is None else last + 1
    jobs, customers = crm_tables(spark, tables_dir, buckets)
    return jobs.current(before), customers.current(before)


def snapshot_before(
    spark: SparkSession, tables_dir: str, batch_id: int, link: LinkFields = LINK, buckets: int = BUCKETS,
) -> Snapshot:
    """The tables as they were before a batch, read by bucket; the keys are made from them the first time."""
    jobs, customers = crm_tables(spark, tables_dir, buckets)
    keys = key_table(spark, tables_dir, buckets)
    if not keys.started(batch_id):
        whole = _keys_of(jobs.current(batch_id), customers.current(batch_id), link)
        keys.start(whole.withColumn("held", F.lit(True)), batch_id - 1)
    marks = {n: path for n, path in complete_batches(spark, f"{tables_dir}/published").items() if n < batch_id}
    if marks:
        last_job, last_customer = spark.read.parquet(marks[max(marks)]).first()
    else:
        last_job, last_customer = (
            table.current(batch_id).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for table in (jobs, customers)
        )

    def by_id(table: ChangingTable):
        return lambda ids: table.current(batch_id, table.places(ids)).join(ids, "id", "left_semi")

    return Snapshot(
        keys=lambda asked: keys.current(batch_id, keys.places(asked)).drop("held").join(asked, "key", "left_semi"),
        jobs=by_id(jobs), customers=by_id(customers),
        last_job=F.lit(last_job), last_customer=F.lit(last_customer),
    )


def _key_changes(before: Snapshot, jobs: DataFrame, customers: DataFrame, link: LinkFields) -> DataFrame:
    """Keys that changed records have now, and those that they had and lost."""
    old = _keys_of(before.jobs(jobs.select("id")), before.customers(customers.select("id")), link)
    lost = old.withColumns({"owner": F.lit(None).cast("long"), "stored": F.lit(None).cast("string"), "held": F.lit(False)})
    new = _keys_of(jobs, customers, link).withColumn("held", F.lit(True))
    return new.unionByName(lost).groupBy("key", "is_customer", "id").agg(
        F.max("owner").alias("owner"), F.max("stored").alias("stored"), F.max("held").alias("held")
    )


def apply_batch(
    spark: SparkSession, captured: DataFrame, tables_dir: str, batch_id: int,
    link: LinkFields = LINK, bits: int = CHUNK_BITS, buckets: int = BUCKETS,
) -> None:
    """Apply captured deliveries as batch `batch_id`; running it again gives the same tables.

    The tables are read as they were before the batch, whatever an earlier attempt left behind. The
    batch is published by its last write, which holds the highest ids: `published_tables` reads no
    tables of which a part is missing.
    """
    jobs, customers = crm_tables(spark, tables_dir, buckets)
    before = snapshot_before(spark, tables_dir, batch_id, link, buckets)
    # The processing time is the latest receipt, so that a second attempt writes the same rows.
    now = F.coalesce(captured.agg(F.max("received_at")).scalar(), F.current_timestamp())
    done = replay_on(project_events(captured), before, now, link, bits)
    customers.write_changes(done.customers, batch_id)
    jobs.write_changes(done.jobs, batch_id)
    changed_jobs, changed_customers = jobs.changes(batch_id), customers.changes(batch_id)
    key_table(spark, tables_dir, buckets).write_changes(_key_changes(before, changed_jobs, changed_customers, link), batch_id)
    write_table(done.actions, f"{tables_dir}/actions/batch={batch_id}")

    none = F.lit(None).cast("long")
    made = changed_jobs.select(F.col("id").alias("job"), none.alias("customer")).unionByName(
        changed_customers.select(none.alias("job"), F.col("id").alias("customer")))
    mark = made.agg(*[
        F.greatest(last, F.coalesce(F.max(c), last)).cast("long").alias(f"last_{c}")
        for c, last in (("job", before.last_job), ("customer", before.last_customer))
    ])
    write_table(mark, f"{tables_dir}/published/batch={batch_id}")


def stream_apply(
    spark: SparkSession, captured_dir: str, tables_dir: str, checkpoint: str,
    continuous: str | None = None, max_files: int = 1000, link: LinkFields = LINK,
    bits: int = CHUNK_BITS, compact_every: int = 50, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Apply every captured project to the tables under `tables_dir`, batch by batch.

    Late and repeated deliveries are held against the modification text stored by earlier
    batches, so they never set a record back.
    """
    captured = (
        spark.readStream.schema(CAPTURED).option("maxFilesPerTrigger", max_files)
        .parquet(captured_dir)
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch.sparkSession, batch, tables_dir, batch_id, link, bits, buckets)
        if (batch_id + 1) % compact_every == 0:
            spark = batch.sparkSession
            for changing in (*crm_tables(spark, tables_dir, buckets), key_table(spark, tables_dir, buckets)):
                changing.compact(batch_id)

    writer = captured.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return _trigger(writer, continuous).start()


def version_state(spark: SparkSession, state_dir: str, buckets: int = BUCKETS) -> ChangingTable:
    """The last version of every job."""
    return ChangingTable(spark, state_dir, VERSIONS, layout="id", buckets=buckets)


def transitions_batch(
    spark: SparkSession, versions: DataFrame, state_dir: str, out_dir: str, batch_id: int,
    bits: int = CHUNK_BITS, buckets: int = BUCKETS,
) -> None:
    """Messages for the saves in a batch of job versions; the latest versions become state.

    The state is laid out by a hash of the job, and a batch reads the buckets of its own jobs.
    """
    state = version_state(spark, state_dir, buckets)
    # A batch is files already, so it is read again and not copied.
    ids = versions.select("id").distinct()
    known = state.current(batch_id, state.places(ids)).join(ids, "id", "left_semi").select(
        "id", F.col("data_json").alias("_stored"))
    chained = prefix_fold(
        versions, ["id"], "version", {"_previous": ("last", F.col("data_json"))}, bits
    ).join(known, "id", "left")
    before = F.coalesce("_previous", "_stored")
    saves = chained.withColumn("_before", before).filter(F.col("_before").isNotNull())
    pairs = parsed_pairs(saves, "data_json", "_before")
    write_table(new_bookings(pairs), f"{out_dir}/batch={batch_id}")
    latest = versions.groupBy("id").agg(
        F.max_by(F.struct("customer_id", "version", "data_json"), "version").alias("_v")
    ).select("id", "_v.*")
    state.write_changes(latest, batch_id)


def stream_booking_transitions(
    spark: SparkSession, versions_dir: str, state_dir: str, out_dir: str, checkpoint: str,
    continuous: str | None = None, max_files: int = 1000, bits: int = CHUNK_BITS,
    compact_every: int = 50, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Messages for newly made bookings from a stream of saved job versions."""
    versions = (
        spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", max_files)
        .parquet(versions_dir)
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        transitions_batch(batch.sparkSession, batch, state_dir, out_dir, batch_id, bits, buckets)
        if (batch_id + 1) % compact_every == 0:
            version_state(batch.sparkSession, state_dir, buckets).compact(batch_id)

    writer = versions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return _trigger(writer, continuous).start()
