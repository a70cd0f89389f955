"""Writes as table transitions: a snapshot and a change set give the next snapshot.

Plain files have no row-level update, so every function here returns new rows and leaves the
input alone. Change sets are the right side of the joins: where one is small the run-time size
check turns the join into a broadcast and the snapshot is not shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import short_date
from ..functions.documents import (
    parsed, text_of, with_fields, with_marked_paths, with_nonempty_fields,
)
from ..functions.text import blank_to_null, first_nonempty
from ..schemas import DEFAULT_STAGE, DEFAULT_STATUS, EMPTY_TABS
from . import reminders as R
from .joins import document_join
from .once import once
from .prefix import ranged_rank

# Where the sent mark of a kind lives; service kinds mark bookings instead.
MARK_PATHS = {
    R.INSTALL_WEEK: ["tabs", "installation", "emailReminders", "week"],
    R.INSTALL_DAY: ["tabs", "installation", "emailReminders", "day"],
    R.INSTALL_BOOKED: ["tabs", "installation", "bookedEmailSent"],
    R.SURVEY_BOOKED: ["tabs", "survey", "emailSent"],
    R.SURVEY_DAY: ["tabs", "survey", "reminderSent"],
}
BOOKING_MARKS = {R.SERVICE_BOOKED: "emailSent", R.SERVICE_DAY: "reminderSent"}


def empty_tabs() -> Column:
    """Tabs of a new record, as JSON text."""
    return F.to_json(F.parse_json(F.lit(EMPTY_TABS)))


# ---- promoted columns ------------------------------------------------------------------------

def _promoted(entity: str) -> dict[str, Column]:
    """Table columns taken from the document, with their defaults."""
    doc = F.from_json("data_json", "name string, stage string, title string, status string")
    if entity == "customer":
        return {
            "name": first_nonempty(doc["name"]),
            "stage": first_nonempty(doc["stage"], F.lit(DEFAULT_STAGE)),
        }
    return {
        "title": first_nonempty(doc["title"]),
        "status": first_nonempty(doc["status"], F.lit(DEFAULT_STATUS)),
    }


def encode_entity(df: DataFrame, fields: list[str], entity: str, raw: str | None = None) -> DataFrame:
    """Fold the given columns into `data_json` and refresh the promoted columns from them.

    With `raw`, the earlier document, its other fields are kept.
    """
    if raw is None:
        text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    else:
        text = F.to_json(with_fields(
            parsed(F.col(raw)), {f: F.col(f).cast("variant") for f in fields}
        ))
    return df.withColumn("data_json", text).withColumns(_promoted(entity))


# ---- inserts, replacements, deletions --------------------------------------------------------

def ordinal(df: DataFrame, position: str, out: str) -> DataFrame:
    """Number the rows 1, 2, ... by `position` without gathering them in one task."""
    return ranged_rank(df, [], [F.col(position)], out)


def insert_entities(
    snapshot: DataFrame, new: DataFrame, entity: str, position: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """The snapshot with the new documents appended, and the inserted rows.

    Ids continue after the highest one in the order of `position` (whole, unique numbers).
    """
    last = F.coalesce(snapshot.agg(F.max("id")).scalar(), F.lit(0))
    inserted = (
        ordinal(new, position, "_n")
        .withColumns(_promoted(entity))
        .withColumns({"id": (last + F.col("_n")).cast("long"), "created_at": now, "updated_at": now})
        .select(*snapshot.columns)
    )
    return snapshot.unionByName(inserted), inserted


def apply_changes(
    snapshot: DataFrame, changes: DataFrame, key: list[str], sparse: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Rows of the snapshot overwritten by the change of the same key, and the unmatched changes.

    Columns in `sparse` are overwritten only by a non-empty text, the others as they come.
    There must be one change per key.
    """
    values = [c for c in changes.columns if c not in key]
    incoming = changes.select(*key, F.struct(*values).alias("_new"))
    joined = document_join(snapshot, incoming, key, "left")

    def column(name: str) -> Column:
        if name not in values:
            return F.col(name)
        new = F.col(f"_new.{name}")
        if name in sparse:
            return F.coalesce(blank_to_null(new), F.col(name)).alias(name)
        return F.when(F.col("_new").isNotNull(), new).otherwise(F.col(name)).alias(name)

    not_found = changes.join(snapshot.select(*key), key, "left_anti")
    return joined.select(*[column(c) for c in snapshot.columns]), not_found


def replace_entities(
    snapshot: DataFrame, changes: DataFrame, entity: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Whole-document updates by id and tenant; ids that do not exist are returned unwritten."""
    filled = changes.withColumns(_promoted(entity)).withColumn("updated_at", now)
    return apply_changes(snapshot, filled, ["id", "tenant_id"])


def delete_customers_restrict(
    customers: DataFrame, jobs: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Customers left after deleting those asked for, and the requests blocked by jobs.

    A request that names no customer of its tenant does nothing and is not blocked.
    """
    named = requests.join(customers.select("id", "tenant_id"), ["id", "tenant_id"], "left_semi")
    in_use = jobs.select(F.col("customer_id").alias("id")).distinct()
    blocked = named.join(in_use, "id", "left_semi")
    free = named.join(in_use, "id", "left_anti")
    return customers.join(free, ["id", "tenant_id"], "left_anti"), blocked


def delete_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    return jobs.join(requests, ["id", "tenant_id"], "left_anti")


def fk_check_jobs(jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """Jobs that refer to no customer."""
    return jobs.join(
        customers.select(F.col("id").alias("customer_id")), "customer_id", "left_anti"
    )


def upsert_singleton(current: DataFrame, changes: DataFrame, position: str, now: Column) -> DataFrame:
    """Tenant documents after the changes; of several for a tenant the latest wins."""
    latest = changes.groupBy("tenant_id").agg(F.max_by("data_json", position).alias("_doc"))
    return current.join(latest, "tenant_id", "full_outer").select(
        "tenant_id", F.coalesce("_doc", "data_json").alias("data_json"),
        F.when(F.col("_doc").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def sparse_patch(
    snapshot: DataFrame, patches: DataFrame, key: str, fields: list[str], now: Column | None = None
) -> DataFrame:
    """Documents with the given text fields overwritten where the patch has a non-empty value.

    Table columns of the same names go with the document, and rows that have a patch are updated
    at `now` (the current time).
    """
    incoming = patches.select(key, F.struct(*fields).alias("_p"))
    patched = F.to_json(with_nonempty_fields(
        parsed(F.col("data_json")), {f: F.col(f"_p.{f}") for f in fields}
    ))
    touched = F.col("_p").isNotNull()
    moment = F.current_timestamp() if now is None else now
    return snapshot.join(incoming, key, "left").withColumns({
        "data_json": F.when(touched, patched).otherwise(F.col("data_json")),
        "updated_at": F.when(touched, moment).otherwise(F.col("updated_at")),
        **{f: F.coalesce(blank_to_null(F.col(f"_p.{f}")), F.col(f))
           for f in fields if f in snapshot.columns},
    }).select(*snapshot.columns)


# ---- sent marks ------------------------------------------------------------------------------

def _sent_mark(day: Column) -> Column:
    return F.to_variant_object(F.struct(F.lit("sent").alias("status"),
                                        short_date(day).alias("sentAt")))


def mark_sent(
    jobs: DataFrame, sent: DataFrame, sent_on: Column, now: Column | None = None
) -> DataFrame:
    """Jobs with a sent mark for every `(job_id, booking_id, kind)` of `sent`.

    Only jobs in `sent` are parsed and rewritten, updated at `now` (the current time); the rest of
    each document is kept, and promoted columns are left alone. A service mark goes on all
    bookings of that id.
    """
    flags = [
        F.max(F.col("kind") == kind).alias(f"_{kind}") for kind in MARK_PATHS
    ] + [
        F.collect_set(F.when(F.col("kind") == kind, F.coalesce("booking_id", F.lit("")))
                      ).alias(f"_{kind}") for kind in BOOKING_MARKS
    ]
    # Both kinds of aggregate drop repeats before the shuffle: what is left of a job is at most its kinds
    # and the bookings named for it.
    per_job = sent.groupBy(F.col("job_id").alias("id")).agg(*flags, F.lit(True).alias("_hit"))
    mark = _sent_mark(sent_on)
    doc = F.col("_doc")
    kept = [*jobs.columns, "_hit", *[f"_{k}" for k in (*MARK_PATHS, *BOOKING_MARKS)]]
    # The jobs move once, and a job without marks passes as it is.
    joined = once(jobs.join(per_job, "id", "left"), {"_doc": parsed(F.when(F.col("_hit"), F.col("data_json")))}, kept)

    def marked(booking: Column) -> Column:
        booking_id = F.coalesce(text_of(F.try_variant_get(booking, "$.id", "variant")), F.lit(""))
        for kind, field in BOOKING_MARKS.items():
            booking = F.when(
                F.array_contains(F.col(f"_{kind}"), booking_id), with_fields(booking, {field: mark})
            ).otherwise(booking)
        return booking

    listed = once(joined, {
        "_bookings": F.try_variant_get(doc, "$.tabs.serviceCall.bookings", "array<variant>")
    })
    touched = F.lit(False)
    for kind in BOOKING_MARKS:
        touched = touched | (F.coalesce(F.size(F.col(f"_{kind}")), F.lit(0)) > 0)
    changes = [
        (path, F.coalesce(F.col(f"_{kind}"), F.lit(False)), mark) for kind, path in MARK_PATHS.items()
    ] + [(
        ["tabs", "serviceCall", "bookings"], touched & F.col("_bookings").isNotNull(),
        F.to_variant_object(F.transform("_bookings", marked)),
    )]
    some = reduce(or_, [flag for _, flag, _ in changes])
    rewritten = F.when(some, with_marked_paths(doc, changes)).otherwise(doc)
    moment = F.current_timestamp() if now is None else now
    return once(listed, {"_text": F.to_json(rewritten)}, [*jobs.columns, "_hit"]).withColumns({
        "data_json": F.coalesce("_text", "data_json"),
        "updated_at": F.when(F.col("_hit"), moment).otherwise(F.col("updated_at")),
    }).select(*jobs.columns)
