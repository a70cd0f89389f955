"""Matching of project events to jobs and customers, and the rules for late events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, tenant_key
from ..schemas import LINK, LinkFields
from ..sources import tables
from .prefix import CHUNK_BITS, prefix_fold

# A key of the look-up table starts with its field's mark.
REF_MARK, EMAIL_MARK, PHONE_MARK = "r:", "e:", "p:"
MARKED = {REF_MARK: "ref_key", EMAIL_MARK: "email_key", PHONE_MARK: "phone_key"}


def job_keys(jobs: DataFrame, link: LinkFields = LINK) -> DataFrame:
    """What matching needs from a job: link key, customer and the stored modification text.

    The keys hold the tenant, so records of different tenants never match.
    """
    doc = F.from_json("data_json", f"{link.ref} string, {link.modified} string")
    return jobs.select("id", "tenant_id", "customer_id", doc.alias("_d")).select(
        F.col("id").alias("job_id"), "customer_id",
        tenant_key(F.col("tenant_id"), F.col(f"_d.{link.ref}")).alias("ref_key"),
        blank_to_null(F.col(f"_d.{link.modified}")).alias("stored"),
    )


def customer_keys(customers: DataFrame, link: LinkFields = LINK) -> DataFrame:
    """What matching needs from a customer; the name is the column's."""
    doc = F.from_json(
        "data_json", f"email string, phone string, {link.ref} string, {link.modified} string"
    )
    return customers.select("id", "tenant_id", "name", doc.alias("_d")).select(
        F.col("id").alias("customer_id"), "name",
        tenant_key(F.col("tenant_id"), F.col("_d.email")).alias("email_key"),
        tenant_key(F.col("tenant_id"), F.col("_d.phone")).alias("phone_key"),
        tenant_key(F.col("tenant_id"), F.col(f"_d.{link.ref}")).alias("ref_key"),
        blank_to_null(F.col(f"_d.{link.modified}")).alias("stored"),
    )


def first_match(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: the fields of the row with the lowest `order`."""
    keyed = df.filter(F.col(key).isNotNull()).groupBy(key)
    if fields == [order]:
        return keyed.agg(F.min(order).alias(order))
    return keyed.agg(F.min_by(F.struct(*fields), order).alias("_first")).select(key, "_first.*")


def links_by_reference(jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """For each linked reference the job that holds it, else the customer."""
    job_links = jobs.select(
        "ref_key", F.struct(
            F.lit(0).alias("rank"), F.col("job_id").alias("id"), "job_id", "customer_id", "stored"
        ).alias("_t"),
    )
    customer_links = customers.select(
        "ref_key", F.struct(
            F.lit(1).alias("rank"), F.col("customer_id").alias("id"),
            F.lit(None).cast("long").alias("job_id"), "customer_id", "stored",
        ).alias("_t"),
    )
    both = job_links.unionByName(customer_links).filter(F.col("ref_key").isNotNull())
    return both.groupBy("ref_key").agg(
        F.min_by("_t", F.struct("_t.rank", "_t.id")).alias("_t")
    ).select(
        "ref_key", F.when(F.col("_t.rank") == 0, "job").otherwise("customer").alias("linked"),
        F.col("_t.job_id").alias("linked_job"), F.col("_t.customer_id").alias("linked_customer"),
        F.col("_t.stored").alias("stored"),
    )


def spread_null(key: Column, position: Column) -> Column:
    """The key, or a text that matches nothing and differs by row, so nulls do not pile up."""
    return F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("~"), position.cast("string")))


def _lookup(events: DataFrame, key: Column, side: DataFrame, side_key: str, column: str) -> DataFrame:
    """Left join to a side with one row per key."""
    right = side.select(
        F.concat(F.lit("="), F.col(side_key)).alias("_k"), F.col("customer_id").alias(column)
    )
    return events.withColumn("_k", spread_null(key, F.col("seq"))).join(right, "_k", "left").drop("_k")


def link_event_to_job(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events with the first job holding their reference."""
    first = first_match(jobs, "ref_key", "job_id", ["job_id", "customer_id"])
    return events.join(first, "ref_key")


def link_event_to_customer(events: DataFrame, jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """Events with the first customer holding their reference, where no job holds it."""
    first = first_match(customers, "ref_key", "customer_id", ["customer_id"])
    taken = jobs.select("ref_key").filter(F.col("ref_key").isNotNull()).distinct()
    return events.join(first.join(taken, "ref_key", "left_anti"), "ref_key")


def identity_match(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Add the first customer with the event's e-mail, else the one with its phone."""
    by_email = first_match(customers, "email_key", "customer_id", ["customer_id"])
    by_phone = first_match(customers, "phone_key", "customer_id", ["customer_id"])
    looked = _lookup(events, F.col("email_key"), by_email, "email_key", "_by_email")
    looked = _lookup(
        looked, F.when(F.col("_by_email").isNull(), F.col("phone_key")), by_phone, "phone_key",
        "_by_phone",
    )
    return looked.select(
        *events.columns,
        F.coalesce("_by_email", "_by_phone").alias("matched_customer"),
        F.when(F.col("_by_email").isNotNull(), "email")
        .when(F.col("_by_phone").isNotNull(), "phone").alias("matched_by"),
    )


def is_stale(incoming: Column, stored: Column) -> Column:
    """Both known and the incoming one not newer, compared as text."""
    return F.coalesce(blank_to_null(incoming) <= blank_to_null(stored), F.lit(False))


def key_rows(jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per key a record is found by: (key, is_customer, id, owner, stored).

    A key starts with the mark of its field. Jobs are found by reference, customers by reference,
    e-mail and phone; `owner` is the customer, `stored` the modification text held beside a reference.
    """
    def found(*keys: Column) -> Column:
        return F.explode(F.array_compact(F.array(*keys)))

    no_text = F.lit(None).cast("string")
    of_jobs = jobs.select(
        found(F.concat(F.lit(REF_MARK), "ref_key")).alias("key"), F.lit(False).alias("is_customer"),
        F.col("job_id").alias("id"), F.col("customer_id").alias("owner"), "stored",
    )
    of_customers = customers.select(
        found(*[F.concat(F.lit(mark), column) for mark, column in MARKED.items()]).alias("key"),
        F.lit(True).alias("is_customer"), F.col("customer_id").alias("id"), F.col("customer_id").alias("owner"),
        "stored",
    )
    by_reference = F.col("key").startswith(REF_MARK)
    return of_jobs.unionByName(of_customers).withColumn("stored", F.when(by_reference, F.col("stored")).otherwise(no_text))


def holders(keys: DataFrame) -> DataFrame:
    """The first holder of each key of `key_rows`, a job before a customer: (key, is_customer, id, owner, stored)."""
    return keys.groupBy("key").agg(
        F.min(F.struct("is_customer", "id", "owner", "stored")).alias("_first")
    ).select("key", "_first.*")


def event_keys(events: DataFrame) -> Column:
    """The marked keys of an event that are known."""
    return F.array_compact(F.array(*[F.concat(F.lit(mark), events[column]) for mark, column in MARKED.items()]))


def classify_event(events: DataFrame, jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """What each event would do to the given tables, taken by itself.

    For a batch whose events build on one another see `replay`. Inputs are `project_events`,
    `job_keys` and `customer_keys`; ids of records yet to be created are null. All three look-ups of
    an event go to one table of first holders, which reads each input once.
    """
    first = holders(key_rows(jobs, customers))
    asked = events.select("seq", F.explode(event_keys(events)).alias("key"))

    def by(mark: str, column: str) -> Column:
        return F.min(F.when(F.col("key").startswith(mark), F.col(column))).alias(f"_{column}_{mark[0]}")

    # At most one holder for each of the three keys, so an event's few rows fold to one.
    looked = asked.join(first, "key").groupBy("seq").agg(
        by(REF_MARK, "is_customer"), by(REF_MARK, "id"), by(REF_MARK, "stored"),
        by(EMAIL_MARK, "id"), by(PHONE_MARK, "id"),
    )
    return _classified(events.select("seq", "reference", "ref_key", "modified").join(looked, "seq", "left"))


def _classified(looked: DataFrame) -> DataFrame:
    held, stale = F.col("_id_r").isNotNull(), is_stale(F.col("modified"), F.col("_stored_r"))
    by_job, by_customer = held & ~F.col("_is_customer_r"), held & F.col("_is_customer_r")
    found = F.coalesce("_id_e", "_id_p")
    action = (
        F.when(F.col("ref_key").isNull(), "skipped")
        .when(held & stale, "skipped-stale")
        .when(by_job, "updated-job")
        .when(by_customer, "updated-customer")
        .when(found.isNotNull(), "created-job")
        .otherwise("created-customer")
    )
    return looked.withColumn("action", action).select(
        "seq", "reference", "action",
        F.when(F.col("action") == "skipped", "no reference on project").alias("reason"),
        F.when(by_job, F.col("_id_r")).alias("job_id"),
        F.when(by_customer, F.col("_id_r")).when(F.col("action") == "created-job", found).alias("customer_id"),
        F.when(held, "reference").when(F.col("ref_key").isNull(), None)
        .when(F.col("_id_e").isNotNull(), "email").when(F.col("_id_p").isNotNull(), "phone").alias("matched_by"),
    )


def unmatched_events(events: DataFrame, jobs: DataFrame, customers: DataFrame) -> DataFrame:
    """Events that would open a new lead."""
    return classify_event(events, jobs, customers).filter(F.col("action") == "created-customer")


# ---- late events -----------------------------------------------------------------------------

def staleness_guard(
    events: DataFrame, key: str, order: str, modified: str, stored: str | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add `prev_modified`, the newest modification text seen before, and `applied`.

    An event is applied unless both texts are known and its own is not greater. `stored` is the
    column that holds the key's text as it was before the first event. Keys must not be null.
    The events are stored first, so what made them runs once.
    """
    folded = prefix_fold(
        tables.stored(events, "guarded"), [key], order, {"_seen": ("max", blank_to_null(F.col(modified)))}, bits
    )
    previous = F.col("_seen")
    if stored is not None:
        previous = F.greatest(previous, blank_to_null(F.col(stored)))
    return folded.withColumn("prev_modified", previous).select(
        *events.columns, "prev_modified",
        (~is_stale(F.col(modified), F.col("prev_modified"))).alias("applied"),
    )


def fold_sparse_updates(
    events: DataFrame, key: str, order: str, fields: list[str], applied: str = "applied",
    is_stored: bool = False,
) -> DataFrame:
    """Per key the last non-empty value of each field among the applied events.

    Two steps: a hash aggregate finds the greatest position of each field, and the events at these
    positions, at most one for each field of a key, are joined to it for the values. So all that is
    aggregated by key is numbers, and hot keys are reduced before the shuffle. The events are stored
    first unless they are; keys must not be null, and positions are unique within a key.
    """
    given = events.select(
        key, F.col(order).alias("_at"), *[F.when(F.col(applied), blank_to_null(F.col(f))).alias(f) for f in fields]
    )
    given = given if is_stored else tables.stored(given, "folded")
    places = {f: f"_at_{i}" for i, f in enumerate(fields)}
    last = given.groupBy(key).agg(*[
        F.max(F.when(F.col(f).isNotNull(), F.col("_at"))).alias(at) for f, at in places.items()
    ])
    winners = last.select(key, *places.values(), F.explode(F.array_distinct(F.array_compact(F.array(*places.values())))).alias("_at"))
    # A winner's values, each where it is the last one of its field.
    values = F.filter(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(F.col("_at") == F.col(at), F.col(f)).alias("value"))
        for i, (f, at) in enumerate(places.items())
    ]), lambda x: x["value"].isNotNull())
    found = winners.join(given, [key, "_at"]).groupBy(key).agg(
        F.map_from_entries(F.flatten(F.collect_list(values))).alias("_values")
    )
    return last.select(key).join(found, key, "left").select(
        key, *[F.col("_values")[i].alias(f) for i, f in enumerate(fields)]
    )


def apply_action_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("action").agg(F.count(F.lit(1)).alias("events"))
