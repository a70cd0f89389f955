"""Selection of due reminders from job documents, in one pass over the jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, days_until
from ..functions.documents import default_on_flag, is_booked, is_sent
from ..functions.text import join_names
from ..schemas import TABS

# Message kinds and the days before the event on which a reminder is due.
INSTALL_WEEK, INSTALL_DAY = "install_week", "install_day"
SURVEY_DAY, SERVICE_DAY = "survey_day", "service_day"
INSTALL_BOOKED, SURVEY_BOOKED, SERVICE_BOOKED = "install_booked", "survey_booked", "service_booked"
DUE_DAYS = {INSTALL_WEEK: (1, 7), INSTALL_DAY: (0, 1), SURVEY_DAY: (0, 1), SERVICE_DAY: (0, 1)}
REMINDERS = tuple(DUE_DAYS)
SERVICE_KINDS = (SERVICE_BOOKED, SERVICE_DAY)
REQUEST_KINDS = {"week": INSTALL_WEEK, "day": INSTALL_DAY}
MONTH = "yyyy-MM"


def job_tabs(tabs: str = TABS) -> Column:
    """The tabs of the document alone; promoted columns play no part in messages."""
    return F.from_json("data_json", f"tabs {tabs}")["tabs"]


def same_id(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def first_booking(bookings: Column, booking_id: Column) -> Column:
    """The first booking of that id; messages are always about this one."""
    return F.try_element_at(F.filter(bookings, lambda b: same_id(b["id"], booking_id)), F.lit(1))


def _reminder(kind: str, date: Column, booking: Column, at: Column, by: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), booking.alias("booking_id"), date.alias("event_date"),
        at.alias("message_date"), by.alias("message_fitters"),
    )


def _open_reminders(
    jobs: DataFrame, kinds: tuple[str, ...], in_time: Callable[[str, Column], Column]
) -> DataFrame:
    """One row per reminder not yet sent whose date passes `in_time(kind, date)`."""
    tabs = F.col("_tabs")
    install, survey, service = tabs["installation"], tabs["survey"], tabs["serviceCall"]
    no_booking = F.lit(None).cast("string")
    parts: list[Column] = []

    for kind, mark in ((INSTALL_WEEK, "week"), (INSTALL_DAY, "day")):
        if kind in kinds:
            wanted = in_time(kind, install["date"]) & ~is_sent(install["emailReminders"][mark])
            parts.append(F.array(F.when(wanted, _reminder(
                kind, install["date"], no_booking, install["date"], join_names(install["fitters"]),
            ))))
    if SURVEY_DAY in kinds:
        wanted = (
            in_time(SURVEY_DAY, survey["date"])
            & is_booked(survey["date"], survey["fitter"])
            & default_on_flag(survey["notifyEnabled"])
            & ~is_sent(survey["reminderSent"])
        )
        parts.append(F.array(F.when(wanted, _reminder(
            SURVEY_DAY, survey["date"], no_booking, survey["date"], survey["fitter"],
        ))))
    if SERVICE_DAY in kinds:
        bookings = service["bookings"]
        wanted_bookings = F.filter(bookings, lambda b: (
            in_time(SERVICE_DAY, b["date"])
            & is_booked(b["date"], b["fitter"])
            & default_on_flag(service["notifyEnabled"])
            & ~is_sent(b["reminderSent"])
        ))
        parts.append(F.coalesce(F.transform(wanted_bookings, lambda b: _reminder(
            SERVICE_DAY, b["date"], b["id"],
            first_booking(bookings, b["id"])["date"], first_booking(bookings, b["id"])["fitter"],
        )), F.array()))

    found = parts[0] if len(parts) == 1 else F.concat(*parts)
    return (
        jobs.select(F.col("id").alias("job_id"), "customer_id", job_tabs().alias("_tabs"))
        .select("job_id", "customer_id", F.explode(F.array_compact(found)).alias("_r"))
        .select(
            "job_id", "_r.booking_id", "_r.kind", "_r.event_date", "customer_id",
            "_r.message_date", "_r.message_fitters",
        )
    )


def due_reminders(jobs: DataFrame, run_date: str, kinds: tuple[str, ...] = REMINDERS) -> DataFrame:
    """One row per reminder due on the run date and not yet sent, in one pass over the documents.

    A missed day is made up on the next run, since a window of days is tested and not one day.
    """
    def in_time(kind: str, date: Column) -> Column:
        return F.coalesce(days_until(date, run_date).between(*DUE_DAYS[kind]), F.lit(False))

    return _open_reminders(jobs, kinds, in_time).withColumn(
        "days_until", days_until(F.col("event_date"), run_date)
    )


def reminder_schedule(jobs: DataFrame) -> DataFrame:
    """All reminders not yet sent, whenever they fall due, with the date as a real column.

    Written by `event_month` this spares the daily run from parsing every document: see
    `due_from_schedule`. It is to be renewed for the jobs that were saved.
    """
    def dated(_: str, date: Column) -> Column:
        return as_date(date).isNotNull()

    day = as_date(F.col("event_date"))
    return _open_reminders(jobs, REMINDERS, dated).withColumns(
        {"event_day": day, "event_month": F.date_format(day, MONTH)}
    )


def due_from_schedule(
    schedule: DataFrame, run_date: str, kinds: tuple[str, ...] = REMINDERS
) -> DataFrame:
    """Due reminders from a written schedule; only the one or two months concerned are read."""
    day = F.lit(run_date).cast("date")
    first = F.date_add(day, min(d for d, _ in DUE_DAYS.values()))
    last = F.date_add(day, max(d for _, d in DUE_DAYS.values()))
    left = F.datediff("event_day", day)
    due = F.lit(False)
    for kind in kinds:
        due = due | ((F.col("kind") == kind) & left.between(*DUE_DAYS[kind]))
    return (
        schedule.filter(F.col("event_month").between(
            F.date_format(first, MONTH), F.date_format(last, MONTH)))
        .filter(F.col("event_day").between(first, last))
        .filter(due)
        .withColumn("days_until", left)
        .drop("event_day", "event_month")
    )


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual send requests `(job_id, reminder_key)`: the usable ones, and those refused."""
    usable = F.coalesce(
        F.col("job_id").isNotNull() & (F.col("job_id") != 0)
        & F.col("reminder_key").isin(list(REQUEST_KINDS)),
        F.lit(False),
    )
    refused = requests.filter(~usable).withColumn(
        "reason", F.lit("job id and a reminder key of week or day are required")
    )
    return requests.filter(usable), refused


def forced_reminders(requests: DataFrame) -> DataFrame:
    """Requests as messages to build, whatever the dates and marks say."""
    kinds = F.create_map(*[F.lit(x) for pair in REQUEST_KINDS.items() for x in pair])
    return requests.select(
        "job_id", F.lit(None).cast("string").alias("booking_id"),
        kinds[F.col("reminder_key")].alias("kind"),
    )


def attach_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add to `(job_id, booking_id, kind)` what the message needs from the job.

    `reason` tells a missing job or booking. Only the jobs asked for go through the join: the
    semi join is turned into a broadcast at run time where the requests are few.
    """
    asked = jobs.join(requests.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
    context = asked.select(
        F.col("id").alias("job_id"), "customer_id", job_tabs().alias("_tabs"),
        F.lit(True).alias("_job"),
    )
    tabs = F.col("_tabs")
    booking = first_booking(tabs["serviceCall"]["bookings"], F.col("booking_id"))
    service = F.col("kind").isin(list(SERVICE_KINDS))
    survey = F.col("kind").isin([SURVEY_BOOKED, SURVEY_DAY])

    def by_kind(of_booking: Column, of_survey: Column, of_install: Column) -> Column:
        return F.when(service, of_booking).when(survey, of_survey).otherwise(of_install)

    install = tabs["installation"]
    return (
        requests.join(context, "job_id", "left")
        .withColumn("_booking", booking)
        .select(
            *requests.columns,
            "customer_id",
            by_kind(F.col("_booking.date"), tabs["survey"]["date"], install["date"])
            .alias("message_date"),
            by_kind(F.col("_booking.fitter"), tabs["survey"]["fitter"],
                    join_names(install["fitters"])).alias("message_fitters"),
            F.when(F.col("_job").isNull(), "job not found")
            .when(service & F.col("_booking").isNull(), "booking not found").alias("reason"),
        )
    )


def booking_lookup(requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The booking asked for by `(job_id, booking_id)`, and the requests that name none."""
    looked = attach_jobs(requests.withColumn("kind", F.lit(SERVICE_BOOKED)), jobs).select(
        *requests.columns, F.col("message_date").alias("date"),
        F.col("message_fitters").alias("fitter"), "reason",
    )
    return (
        looked.filter(F.col("reason").isNull()).drop("reason"),
        looked.filter(F.col("reason").isNotNull()).drop("date", "fitter"),
    )

