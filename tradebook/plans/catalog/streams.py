"""Streams over the whole tables, run until the input is used up.

The input arrives in two parts, so that state has to be carried from one batch to the next.
"""

from pyspark.sql import functions as F

from ...operators import deliveries as D
from ...operators.bookings import BOOKED_KINDS
from ...schemas import JOBS
from ...session import scratch_dir
from ...sources.tables import ChangingTable
from ...streaming import jobs as ST
from .. import standins as S
from ..registry import query
from .events import DEALS, GUARD, deals
from .messages import BOOKED



# The test tables are small.
FEW_BUCKETS = 8


def halves(df):
    """The deliveries of the first half of the month, then the others."""
    early = F.col("received_at") < F.lit("2024-01-16").cast("timestamp")
    return df.filter(early), df.filter(~early)


@query("stream_capture", """
select seq, tenant_id, epoch_us(received_at) as received_us, body <> 'text' as is_json from ev
""")
def stream_capture(spark, sf):
    folder = scratch_dir(spark, "capture")
    for part in halves(S.deliveries(spark, sf)):
        part.write.mode("append").option(
            "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
        ).json(f"{folder}/landing")
        ST.stream_capture(
            spark, f"{folder}/landing", f"{folder}/captured", f"{folder}/checkpoint"
        ).awaitTermination()
    return spark.read.schema(ST.CAPTURED).parquet(f"{folder}/captured").select(
        "seq", "tenant_id", F.unix_micros("received_at").alias("received_us"), "is_json"
    )


def applied(spark, sf):
    """Folder of the captured deliveries and of the tables to which all of them were applied in two batches."""
    folder = scratch_dir(spark, "apply")
    jobs, customers = ST.crm_tables(spark, f"{folder}/tables", FEW_BUCKETS)
    jobs.start(S.jobs(spark, sf))
    customers.start(S.customers(spark, sf))
    for part in halves(D.capture_raw_event(S.deliveries(spark, sf))):
        part.write.mode("append").parquet(f"{folder}/captured")
        ST.stream_apply(
            spark, f"{folder}/captured", f"{folder}/tables", f"{folder}/checkpoint", buckets=FEW_BUCKETS
        ).awaitTermination()
    return folder


@query("stream_apply", DEALS)
def stream_apply(spark, sf):
    folder = applied(spark, sf)
    # What was captured, and the tables as the first batch found them, are there and not made again.
    captured = spark.read.schema(ST.CAPTURED).parquet(f"{folder}/captured")
    before = [table.current(0) for table in ST.crm_tables(spark, f"{folder}/tables", FEW_BUCKETS)]
    after = ST.published_tables(spark, f"{folder}/tables", FEW_BUCKETS)
    return deals(D.project_events(captured), *before, *after)


@query("stream_staleness", GUARD + "select seq, not applied as stale from marked")
def stream_staleness(spark, sf):
    actions = spark.read.parquet(f"{applied(spark, sf)}/tables/actions")
    return actions.filter(F.col("action") != "skipped").select(
        "seq", (F.col("action") == "skipped-stale").alias("stale")
    )


@query("stream_booking_transitions", BOOKED + """
select job_id, booking_id, kind, customer_id, message_date, message_fitters from booked
""")
def stream_booking_transitions(spark, sf):
    folder = scratch_dir(spark, "versions")
    ST.version_state(spark, f"{folder}/state", FEW_BUCKETS).start(spark.createDataFrame([], ST.VERSIONS))
    for version, before in enumerate((True, False)):
        saved = S.jobs(spark, sf, before=before).select(
            "id", "customer_id", F.lit(version).cast("long").alias("version"), "data_json"
        )
        saved.write.mode("append").parquet(f"{folder}/versions")
        ST.stream_booking_transitions(
            spark, f"{folder}/versions", f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", buckets=FEW_BUCKETS
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").filter(
        F.col("kind").isin(list(BOOKED_KINDS))
    ).select("job_id", "booking_id", "kind", "customer_id", "message_date", "message_fitters")


@query("compacted_table", "select id, title, status from job")
def compacted_table(spark, sf):
    """Jobs kept as a base and two batches of changes, folded into a new base."""
    table = ChangingTable(spark, f"{scratch_dir(spark, 'compact')}/jobs", JOBS)
    now, before = S.jobs(spark, sf), S.jobs(spark, sf, before=True)
    table.start(before.withColumn("title", F.lit("old")))
    table.write_changes(before.filter(F.col("status") == "Job Completed"), 0)
    table.write_changes(now, 1)
    table.compact()
    return table.current().select("id", "title", "status")


