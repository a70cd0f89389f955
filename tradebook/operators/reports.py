"""Reports over customers, jobs and deliveries.

Every count is reduced on the map side; joins to customers come after the jobs have been summed
up per customer, so a customer with very many jobs costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, day_minute, is_working_day, month_start, start_hour, week_start
from ..functions.documents import is_booked, is_sent
from ..functions.text import blank_to_null, norm_key, tenant_key
from ..schemas import CALENDAR_TABS, LINK, MANUAL_ORDERS_DOC, SECTORS, LinkFields
from ..sources.tables import stored
from . import reminders as R
from .once import once
from .prefix import ranged_rank

# The status that ends a job, and the hours shown on a calendar day.
COMPLETED = "Job Completed"
FIRST_HOUR, LAST_HOUR = 7, 19


def _count() -> Column:
    return F.count(F.lit(1))


def _sector() -> Column:
    return F.from_json("data_json", "sector string")["sector"]


def _sector_list(df: DataFrame) -> DataFrame:
    """The three sectors in their order."""
    return df.sparkSession.createDataFrame(
        list(enumerate(SECTORS, start=1)), "ordinal int, sector string"
    )


# ---- customers -------------------------------------------------------------------------------

def customers_by_sector(customers: DataFrame) -> DataFrame:
    """A count per sector, zeros included."""
    counts = customers.groupBy(_sector().alias("sector")).agg(_count().alias("_n"))
    return F.broadcast(_sector_list(customers)).join(counts, "sector", "left").select(
        "ordinal", "sector", F.coalesce("_n", F.lit(0)).alias("customers")
    )


def deals_won_by_sector(
    jobs: DataFrame, customers: DataFrame, sectors: tuple[str, ...] | None = None
) -> DataFrame:
    """Jobs and the sum of their quotes per sector of the customer."""
    quote = F.from_json("data_json", "quoteValue string")["quoteValue"].try_cast("decimal(18,2)")
    per_customer = jobs.groupBy(F.col("customer_id").alias("id")).agg(
        _count().alias("_n"), F.sum(quote).alias("_q")
    )
    people = customers.select("id", _sector().alias("sector"))
    if sectors is not None:
        people = people.filter(F.col("sector").isin(list(sectors)))
    return per_customer.join(people, "id").groupBy("sector").agg(
        F.sum("_n").alias("deals"), F.sum("_q").alias("quoted")
    )


def customer_job_counts(jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """Jobs, active and completed ones, for every customer."""
    done = F.count_if(F.col("status") == COMPLETED)
    per_customer = jobs.groupBy(F.col("customer_id").alias("id")).agg(
        _count().alias("jobs"), done.alias("completed")
    )
    zero = F.lit(0)
    return customers.select("id", "name").join(per_customer, "id", "left").select(
        "id", "name", F.coalesce("jobs", zero).alias("jobs"),
        (F.coalesce("jobs", zero) - F.coalesce("completed", zero)).alias("active"),
        F.coalesce("completed", zero).alias("completed"),
    )


def duplicate_customers(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of records with the same name and phone, and the records in them.

    Members come as rows, not as a list, so a group may be of any size.
    """
    keyed = customers.select(
        "id", "stage", norm_key(F.col("name")).alias("name_key"),
        norm_key(F.from_json("data_json", "phone string")["phone"]).alias("phone_key"),
    ).filter(F.col("name_key").isNotNull() & F.col("phone_key").isNotNull())
    groups = keyed.groupBy("name_key", "phone_key").agg(
        _count().alias("records"), F.min("id").alias("first_id"),
        F.countDistinct("stage").alias("stages"),
    ).filter(F.col("records") > 1)
    members = keyed.join(groups, ["name_key", "phone_key"]).select("id", "stage", "first_id", "records")
    return groups, members


def cards_by_stage(df: DataFrame, column: str) -> DataFrame:
    """Cards per stage of a customer board or status of a job board."""
    return df.groupBy("tenant_id", column).agg(_count().alias("cards"))


# ---- calendar --------------------------------------------------------------------------------

def calendar_entries(jobs: DataFrame) -> DataFrame:
    """One row per fitter and booked survey, installation or service call."""
    tabs = F.col("_t")
    survey, install, service = tabs["survey"], tabs["installation"], tabs["serviceCall"]
    none = F.lit(None).cast("string")

    def entry(kind: str, fitter: Column, date: Column, start: Column, booking: Column, pos: Column) -> Column:
        return F.struct(
            fitter.alias("fitter"), date.alias("event_date"), start.alias("start"),
            F.lit(kind).alias("kind"), booking.alias("booking_id"), pos.cast("int").alias("pos"),
        )

    # Every visit becomes a row and is judged there, by compiled code; a list's lambdas are interpreted.
    # The list is never empty; the outer form keeps it from being made a second time to see that.
    empty, zero = F.lit(""), F.lit(0)
    parts = F.concat(
        F.array(entry("survey", survey["fitter"], survey["date"], empty, none, zero)),
        F.coalesce(F.transform(install["fitters"], lambda f, i: entry(
            "installation", f, install["date"], F.coalesce(install["startTime"], empty), none, i)), F.array()),
        F.coalesce(F.transform(service["bookings"], lambda b, i: entry(
            "service call", b["fitter"], b["date"], empty, b["id"], i)), F.array()),
    )
    wanted = F.when(
        F.col("kind") == "installation", blank_to_null(F.col("event_date")).isNotNull()
    ).otherwise(is_booked(F.col("event_date"), F.col("fitter")))
    named = jobs.select(F.col("id").alias("job_id"), "customer_id", "data_json")
    return once(named, {"_t": R.job_tabs(CALENDAR_TABS)}, ["job_id", "customer_id"]).select(
        "job_id", "customer_id", parts.alias("_p")
    ).select("job_id", "customer_id", F.inline_outer("_p")).filter(
        wanted & as_date(F.col("event_date")).isNotNull()
    )


def booking_calendar(jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """The fitters' calendar with the place of each entry in its fitter's day, by time of day."""
    people = customers.select(
        F.col("id").alias("customer_id"), F.from_json("data_json", "name string, address string")
        .alias("_c"),
    )
    # Counted by key and then ranked, so documents are parsed and entries written once before that.
    entries = stored(calendar_entries(jobs).withColumn("_day", as_date(F.col("event_date"))), "calendar")
    # The day comes first, since rows sort by the first key's leading bytes, which fitters' names may share.
    ranked = ranged_rank(
        entries, ["_day", "fitter"],
        [day_minute(F.col("start")), F.col("kind"), F.col("job_id"), F.col("pos")], "seq_in_day",
    )
    return ranked.join(people, "customer_id", "left").select(
        "fitter", "event_date", "start", "kind", "job_id", "booking_id", "pos",
        F.col("_c.name").alias("customer"), F.col("_c.address").alias("address"), "seq_in_day",
    )


def calendar_buckets(entries: DataFrame) -> DataFrame:
    """Entries with the week, month and hour row they are shown in."""
    date, hour = F.col("event_date"), start_hour(F.col("start"))
    return entries.select(
        "*", week_start(date).alias("week"), month_start(date).alias("month"),
        is_working_day(date).alias("working_week"),
        F.when(hour.between(FIRST_HOUR, LAST_HOUR), hour).alias("hour"),
    )


def calendar_view(entries: DataFrame, view: str, day: str) -> DataFrame:
    """Entries shown in the `working week`, `week` or `month` that holds the day."""
    shown = calendar_buckets(entries)
    at = F.lit(day)
    if view == "month":
        return shown.filter(F.col("month") == month_start(at))
    in_week = shown.filter(F.col("week") == week_start(at))
    return in_week.filter("working_week") if view == "working week" else in_week


def site_visits_by_fitter_month(entries: DataFrame) -> DataFrame:
    return entries.groupBy("fitter", month_start(F.col("event_date")).alias("month")).agg(
        _count().alias("visits")
    )


# ---- deliveries ------------------------------------------------------------------------------

def all_deliveries(jobs: DataFrame, manual_orders: DataFrame) -> DataFrame:
    """Deliveries noted on jobs together with those entered by hand."""
    on_jobs = jobs.select(
        F.explode(R.job_tabs()["installation"]["deliveries"]).alias("_d")
    ).select(
        F.lit("job").alias("source"), F.col("_d.supplier").alias("supplier"),
        F.col("_d.date").alias("date"),
    )
    by_hand = manual_orders.select(
        F.explode(F.from_json("data_json", MANUAL_ORDERS_DOC)).alias("_d")
    ).select(
        F.lit("manual").alias("source"), F.col("_d.supplier").alias("supplier"),
        F.col("_d.date").alias("date"),
    )
    return on_jobs.unionByName(by_hand).withColumn("day", as_date(F.col("date"))).filter(
        F.col("day").isNotNull()
    ).drop("date")


def delivery_calendar(deliveries: DataFrame, totals: bool = False) -> DataFrame:
    """Deliveries per day and source, with sums per day and overall if asked for."""
    grouped = deliveries.rollup("day", "source") if totals else deliveries.groupBy("day", "source")
    return grouped.agg(_count().alias("deliveries"))


def upcoming_deliveries(deliveries: DataFrame, suppliers: DataFrame, run_date: str) -> DataFrame:
    """Deliveries from the run date on per supplier and day; `suppliers` is one row per name."""
    return (
        deliveries.filter(F.col("day") >= F.lit(run_date).cast("date"))
        .groupBy("supplier", "day").agg(_count().alias("deliveries"))
        .join(suppliers, "supplier", "left")
        .orderBy("day", "supplier")
    )


# ---- messages --------------------------------------------------------------------------------

def email_status_report(jobs: DataFrame) -> DataFrame:
    """Sent and pending messages per kind."""
    tabs = F.col("_t")
    survey, install = tabs["survey"], tabs["installation"]

    def state(kind: str, mark: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.when(is_sent(mark), "sent").otherwise("pending").alias("status"),
        )

    marks = F.array(
        state(R.SURVEY_BOOKED, survey["emailSent"]), state(R.SURVEY_DAY, survey["reminderSent"]),
        state(R.INSTALL_BOOKED, install["bookedEmailSent"]),
        state(R.INSTALL_WEEK, install["emailReminders"]["week"]),
        state(R.INSTALL_DAY, install["emailReminders"]["day"]),
    )
    bookings = tabs["serviceCall"]["bookings"]
    service = F.concat(
        F.transform(bookings, lambda b: state(R.SERVICE_BOOKED, b["emailSent"])),
        F.transform(bookings, lambda b: state(R.SERVICE_DAY, b["reminderSent"])),
    )
    states = F.concat(marks, F.coalesce(service, F.array()))
    return jobs.select(R.job_tabs().alias("_t")).select(F.explode(states).alias("_s")).groupBy(
        "_s.kind", "_s.status"
    ).agg(_count().alias("messages"))


def linked_records(df: DataFrame, link: LinkFields = LINK) -> DataFrame:
    """Records tied to the quoting system with the deal fields it keeps up to date."""
    doc = F.from_json(
        "data_json", f"quoteValue string, installationValue string, {link.ref} string, "
                     f"{link.status} string, {link.modified} string"
    )
    return df.select("id", "tenant_id", doc.alias("_d")).select(
        "id", tenant_key(F.col("tenant_id"), F.col(f"_d.{link.ref}")).alias("ref_key"),
        F.col("_d.quoteValue").alias("quote_value"),
        F.col("_d.installationValue").alias("installation_value"),
        F.col(f"_d.{link.status}").alias("ext_status"),
        F.col(f"_d.{link.modified}").alias("modified"),
    ).filter(F.col("ref_key").isNotNull())
