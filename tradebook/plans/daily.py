"""Runs put together from the operators: the daily reminders and the saving of jobs.

The reminders still open can be kept as a schedule, laid out by the month they fall in. What saves or
marks jobs, or inserts them, writes the months of these jobs that change; so the daily run reads one or two
months and parses no documents. Deal values that events bring do not touch the schedule.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots as W
from ..operators.bookings import booking_transitions
from ..operators.joins import document_join
from ..operators.outbox import DEFAULT_COMPANY, build_outbox, default_templates, reconcile_send_results
from ..operators.reminders import DUE_DAYS, due_from_schedule, due_reminders, reminder_schedule
from ..sources.tables import ChangingTable, stored, write_table

# A job's open reminders of a month; none is a change that takes them away.
SCHEDULE = (
    "job_id long, event_month string, reminders array<struct<booking_id: string, kind: string, "
    "event_date: string, customer_id: long, message_date: string, message_fitters: string, event_day: date>>"
)


def write_schedule(jobs: DataFrame, folder: str) -> None:
    """The reminder schedule by month; small months share a task and large ones are split."""
    schedule = reminder_schedule(jobs).hint("rebalance", "event_month")
    write_table(schedule.sortWithinPartitions("event_month", "event_day"), folder, ("event_month",))


def schedule_table(spark: SparkSession, folder: str) -> ChangingTable:
    """A schedule that is kept up to date by `record_schedule`, with a row for each job and month."""
    return ChangingTable(
        spark, folder, SCHEDULE, ("job_id", "event_month"), "event_month", live="size(reminders) > 0",
    )


def monthly_schedule(jobs: DataFrame) -> DataFrame:
    """The open reminders of jobs, by job and month."""
    schedule = reminder_schedule(jobs)
    each = [c for c in ("booking_id", "kind", "event_date", "customer_id", "message_date", "message_fitters", "event_day")]
    return schedule.groupBy("job_id", "event_month").agg(F.sort_array(F.collect_list(F.struct(*each))).alias("reminders"))


def record_schedule(
    schedule: ChangingTable, before: DataFrame | None, after: DataFrame, batch_id: int
) -> None:
    """Write what a save changes: `before` and `after` are the rows of the jobs saved, marked or inserted
    (None: they are new). Of a job that is not in `after` all reminders go."""
    new = stored(monthly_schedule(after), "schedule-after")
    if before is None:
        schedule.write_changes(new, batch_id)
        return
    old = stored(monthly_schedule(before), "schedule-before")
    key = ["job_id", "event_month"]
    lost = old.join(new.select(*key), key, "left_anti").withColumn("reminders", F.filter("reminders", lambda _: F.lit(False)))
    schedule.write_changes(new.exceptAll(old).unionByName(lost), batch_id)


def scheduled_due(schedule: ChangingTable, run_date: str, before: int | None = None) -> DataFrame:
    """Due reminders from the months concerned, as they are or as they were before a batch."""
    day = date.fromisoformat(run_date)
    days = [day + timedelta(days=n) for window in DUE_DAYS.values() for n in window]
    rows = schedule.current(before, sorted({f"{d:%Y-%m}" for d in days}))
    return due_from_schedule(rows.select("job_id", "event_month", F.inline("reminders")), run_date)


def daily_reminder_run(
    spark: SparkSession, jobs: DataFrame, customers: DataFrame, settings: DataFrame, run_date: str,
    out_dir: str, default_company: str = DEFAULT_COMPANY, schedule: ChangingTable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write due reminders, messages and rejects of a day; running it again rewrites the same day.

    With a `schedule` the due reminders come from its months, and the jobs are not read. The due rows
    are written first: they are read three times and are far fewer than the jobs, whose documents are
    thus scanned once.
    """
    folder = f"{out_dir}/run_date={run_date}"
    write_table(due_reminders(jobs, run_date) if schedule is None else scheduled_due(schedule, run_date), f"{folder}/due")
    due = spark.read.parquet(f"{folder}/due")
    outbox, rejects = build_outbox(
        due, customers, settings, default_templates(spark), default_company=default_company,
    )
    write_table(outbox, f"{folder}/outbox")
    write_table(rejects, f"{folder}/rejects")
    return spark.read.parquet(f"{folder}/outbox"), spark.read.parquet(f"{folder}/rejects")


def close_daily_run(
    jobs: DataFrame, outbox: DataFrame, results: DataFrame, sent_on: Column,
    now: Column | None = None, schedule: ChangingTable | None = None, batch_id: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Jobs with the marks of what was sent, and the messages that stay due.

    With a `schedule` the reminders that were sent are taken from it, as its batch `batch_id`.
    """
    sent, failed = reconcile_send_results(outbox, results)
    if schedule is not None:
        sent = stored(sent, "sent")
        before = stored(jobs.join(sent.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi"), "before")
        record_schedule(schedule, before, W.mark_sent(before, sent, sent_on, now), batch_id)
    return W.mark_sent(jobs, sent, sent_on, now), failed


def save_jobs(
    spark: SparkSession, jobs: DataFrame, customers: DataFrame, settings: DataFrame,
    changes: DataFrame, now: Column, schedule: ChangingTable | None = None, batch_id: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Replace job documents and build the messages for newly made bookings.

    Gives the new snapshot, the changes that found no job, the messages and their rejects. What
    becomes of the messages has no bearing on the save. With a `schedule` the open reminders of the
    saved jobs are renewed in it, as its batch `batch_id`.
    """
    after, not_found = W.replace_entities(jobs, changes, "job", now)
    key = ["id", "tenant_id"]
    saved = document_join(after, changes.select(*key), key, "left_semi")
    if schedule is not None:
        before = document_join(jobs, changes.select(*key), key, "left_semi")
        record_schedule(schedule, before, saved, batch_id)
    outbox, rejects = build_outbox(
        booking_transitions(jobs, saved), customers, settings, default_templates(spark)
    )
    return after, not_found, outbox, rejects


def messages_as_text(outbox: DataFrame) -> DataFrame:
    """Messages with the recipients as one text."""
    return outbox.withColumn("to", F.array_join("to", ", "))
