"""Snapshot transitions."""

from pyspark.sql import functions as F

from ...functions.documents import parsed
from ...operators import entities as E, reminders as R, snapshots as W

from .. import standins as S
from ..registry import query



def now():
    return F.lit(S.NOW).cast("timestamp")


# New customers made of parts, with and without a name and a stage of their own.
NEW_CUSTOMERS = """
select p_partkey as position, cast(p_size as bigint) as tenant_id,
  case when p_size > 40 then '' else p_name end as name,
  case when p_size > 10 then p_type else '' end as stage
from part
"""
NEW_JOBS = """
select event_id as position, user_id as customer_id, cast(1 as bigint) as tenant_id,
  case when event_type = 'view' then '' else concat('Visit ', event_id) end as title,
  case when event_type = 'error' then '' else event_type end as status
from events
"""


@query("insert_entities", f"""
, fresh as ({NEW_CUSTOMERS})
select (select max(id) from cust) + row_number() over (order by position) as id, tenant_id, name,
  case when stage = '' then 'New Enquiry' else stage end as stage from fresh
""")
def insert_entities(spark, sf):
    new = S._flat(spark, sf, "part", NEW_CUSTOMERS).select(
        "position", "tenant_id", F.to_json(F.struct("name", "stage")).alias("data_json")
    )
    _, inserted = W.insert_entities(S.customers(spark, sf), new, "customer", "position", now())
    return inserted.select("id", "tenant_id", "name", "stage")


@query("insert_entities_jobs", f"""
, fresh as ({NEW_JOBS})
select id, customer_id, title, status from job union all
select (select max(id) from job) + row_number() over (order by position), customer_id, title,
  case when status = '' then 'Book Survey' else status end from fresh
""")
def insert_jobs(spark, sf):
    new = S._flat(spark, sf, "events", NEW_JOBS).select(
        "position", "tenant_id", "customer_id",
        F.to_json(F.struct("title", "status")).alias("data_json"),
    )
    snapshot, _ = W.insert_entities(S.jobs(spark, sf), new, "job", "position", now())
    return snapshot.select("id", "customer_id", "title", "status")


# Furniture customers are saved with a new name and no stage; some name the wrong tenant.
REPLACEMENTS = """
select c_custkey as id,
  case when c_acctbal < 0 then cast(99 as bigint) else cast(c_nationkey as bigint) end as tenant_id,
  concat('New ', c_name) as name
from customer
where c_mktsegment = 'FURNITURE'
"""


def replacements(spark, sf):
    return S._flat(spark, sf, "customer", REPLACEMENTS).select(
        "id", "tenant_id", F.to_json(F.struct("name")).alias("data_json")
    )


@query("replace_entities", f"""
, ch as ({REPLACEMENTS})
select cust.id, coalesce(ch.name, cust.name) as name,
  case when ch.id is null then cust.stage else 'New Enquiry' end as stage,
  ch.id is not null as rewritten
from cust left join ch on ch.id = cust.id and ch.tenant_id = cust.tenant_id
""")
def replace_entities(spark, sf):
    after, _ = W.replace_entities(S.customers(spark, sf), replacements(spark, sf), "customer", now())
    return after.select(
        "id", "name", "stage", (F.col("updated_at") != F.col("created_at")).alias("rewritten")
    )


@query("replace_entities_not_found", f"""
, ch as ({REPLACEMENTS})
select ch.id, ch.tenant_id from ch where not exists (
  select 1 from cust where cust.id = ch.id and cust.tenant_id = ch.tenant_id)
""")
def replace_not_found(spark, sf):
    _, missing = W.replace_entities(
        S.customers(spark, sf), replacements(spark, sf), "customer", now()
    )
    return missing.select("id", "tenant_id")


def grouped_jobs(spark, sf):
    """Jobs held by the first of every three customers, so that the others are free to go."""
    holder = F.col("customer_id") - F.col("customer_id") % 3
    return S.bare_jobs(spark, sf).withColumn("customer_id", holder)


HELD = "select distinct customer_id - customer_id % 3 from job"


@query("delete_customers_restrict", f"select id, name from cust where id in ({HELD})")
def delete_customers_restrict(spark, sf):
    customers = S.bare_customers(spark, sf)
    left, _ = W.delete_customers_restrict(
        customers, grouped_jobs(spark, sf), customers.select("id", "tenant_id")
    )
    return left.select("id", "name")


@query("delete_customers_restrict_blocked", f"select id, tenant_id from cust where id in ({HELD})")
def delete_customers_blocked(spark, sf):
    customers = S.bare_customers(spark, sf)
    _, blocked = W.delete_customers_restrict(
        customers, grouped_jobs(spark, sf), customers.select("id", "tenant_id")
    )
    return blocked


@query("delete_jobs", "select id, status from job where status <> 'Job Completed'")
def delete_jobs(spark, sf):
    jobs = S.bare_jobs(spark, sf)
    asked = E.filter_by(jobs, "status", ["Job Completed"]).select("id", "tenant_id")
    unknown = asked.select((-F.col("id") - 1).alias("id"), "tenant_id")
    return W.delete_jobs(jobs, asked.unionByName(unknown)).select("id", "status")


@query("fk_check_jobs", "select id, customer_id from job where customer_id < 0")
def fk_check_jobs(spark, sf):
    return W.fk_check_jobs(S.bare_jobs(spark, sf), S.bare_customers(spark, sf)).select("id", "customer_id")


@query("upsert_singleton", """
, ch as (select tenant_id, arg_max(name, id) as name from cust group by tenant_id)
select coalesce(s.tenant_id, ch.tenant_id) as tenant_id,
  coalesce(ch.name, s.company_name) as company_name, ch.tenant_id is not null as rewritten
from sett s full join ch on ch.tenant_id = s.tenant_id
""")
def upsert_singleton(spark, sf):
    changes = S.customers(spark, sf).select(
        "tenant_id", F.col("id").alias("position"),
        F.to_json(F.struct(F.col("name").alias("companyName"))).alias("data_json"),
    )
    at = F.lit("2024-03-01").cast("timestamp")
    after = W.upsert_singleton(S.settings(spark, sf), changes, "position", at)
    return after.select(
        "tenant_id", F.get_json_object("data_json", "$.companyName").alias("company_name"),
        (F.col("updated_at") == at).alias("rewritten"),
    )


@query("sparse_patch", """
select id, case when email2 <> '' then concat('new', id) else email end as email, phone,
  'kept' as unmodelled from cust
""")
def sparse_patch(spark, sf):
    customers = S.customers(spark, sf)
    patches = S.flat_customers(spark, sf).select(
        "id", F.when(F.col("email2") != "", F.concat(F.lit("new"), "id")).otherwise("").alias("email"),
        F.lit(None).cast("string").alias("phone"),
    )
    after = W.sparse_patch(customers, patches, "id", ["email", "phone"])
    doc = F.from_json("data_json", "email string, phone string, unmodelled string")
    return after.select("id", doc.alias("_d")).select("id", "_d.*")


@query("encode_entity", """
select id, concat(name, ' & Co') as name, case when sector = '' then 'New Enquiry' else sector end
  as stage, email, 'kept' as unmodelled from cust
""")
def encode_entity(spark, sf):
    changed = S.customers(spark, sf).select(
        "id", F.concat("name", F.lit(" & Co")).alias("name"),
        F.get_json_object("data_json", "$.sector").alias("stage"), F.col("data_json").alias("raw"),
    )
    encoded = W.encode_entity(changed, ["name", "stage"], "customer", raw="raw")
    doc = F.from_json("data_json", "email string, unmodelled string")
    return encoded.select("id", "name", "stage", doc.alias("_d")).select(
        "id", "name", "stage", "_d.*"
    )


# Every job got one message; its kind goes by the priority of the order.
SENT_KINDS = {
    "1-URGENT": R.INSTALL_WEEK, "2-HIGH": R.INSTALL_DAY, "3-MEDIUM": R.INSTALL_BOOKED,
    "4-NOT SPECIFIED": R.SURVEY_BOOKED, "5-LOW": R.SURVEY_DAY,
}


@query("mark_sent_nested", """
select id, case when tenant_id = 1 then 'sent' else week_mark end as week,
  case when tenant_id = 2 then 'sent' else day_mark end as day,
  case when tenant_id = 3 then 'sent' else install_booked end as booked,
  case when tenant_id = 4 then 'sent' else survey_sent end as survey,
  case when tenant_id = 5 then 'sent' else survey_reminder end as survey_reminder,
  case when tenant_id = 3 then '24/06/1999' when install_booked is not null then '' end as booked_on,
  survey_date, 'kept' as unmodelled
from job
""")
def mark_sent_nested(spark, sf):
    kinds = F.create_map(*[F.lit(x) for p in SENT_KINDS.items() for x in (int(p[0][0]), p[1])])
    jobs = S.jobs(spark, sf)
    sent = S.bare_jobs(spark, sf).select(
        F.col("id").alias("job_id"), F.lit(None).cast("string").alias("booking_id"),
        kinds[F.col("tenant_id").cast("int")].alias("kind"),
    )
    after = W.mark_sent(jobs, sent, F.lit(S.RUN_DATE).cast("date"))
    tabs = after.select("id", R.job_tabs().alias("t"), F.get_json_object("data_json", "$.unmodelled")
                        .alias("unmodelled"))
    return tabs.select(
        "id", F.col("t.installation.emailReminders.week.status").alias("week"),
        F.col("t.installation.emailReminders.day.status").alias("day"),
        F.col("t.installation.bookedEmailSent.status").alias("booked"),
        F.col("t.survey.emailSent.status").alias("survey"),
        F.col("t.survey.reminderSent.status").alias("survey_reminder"),
        F.col("t.installation.bookedEmailSent.sentAt").alias("booked_on"),
        F.col("t.survey.date").alias("survey_date"), "unmodelled",
    )


@query("mark_sent_array", """
select job_id, cast(pos as int) as pos, booking_id, date,
  case when booking_id = 'b0' then 'sent' else booked_mark end as booked,
  case when booking_id = 'b0' then '24/06/1999' when booked_mark is not null then '' end as booked_on,
  case when booking_id = 'b1' then 'sent' else reminder_mark end as reminded
from booking
""")
def mark_sent_array(spark, sf):
    jobs = S.jobs(spark, sf)
    about = F.explode(F.array(
        F.struct(F.lit("b0").alias("booking_id"), F.lit(R.SERVICE_BOOKED).alias("kind")),
        F.struct(F.lit("b1").alias("booking_id"), F.lit(R.SERVICE_DAY).alias("kind")),
    ))
    sent = S.bare_jobs(spark, sf).select(F.col("id").alias("job_id"), about.alias("_a")).select("job_id", "_a.*")
    after = W.mark_sent(jobs, sent, F.lit(S.RUN_DATE).cast("date"))
    return after.select(
        F.col("id").alias("job_id"), F.posexplode(R.job_tabs()["serviceCall"]["bookings"])
        .alias("pos", "_b"),
    ).select(
        "job_id", "pos", F.col("_b.id").alias("booking_id"), F.col("_b.date").alias("date"),
        F.col("_b.emailSent.status").alias("booked"),
        F.col("_b.emailSent.sentAt").alias("booked_on"),
        F.col("_b.reminderSent.status").alias("reminded"),
    )


@query("empty_tabs", """
select id, 'pending' as week, '' as survey_date, cast(0 as int) as bookings, 10 as tabs from cust
""")
def empty_tabs(spark, sf):
    doc = parsed(W.empty_tabs())
    return S.customers(spark, sf).withColumn("_t", doc).select(
        "id",
        F.try_variant_get("_t", "$.installation.emailReminders.week.status", "string").alias("week"),
        F.try_variant_get("_t", "$.survey.date", "string").alias("survey_date"),
        F.size(F.try_variant_get("_t", "$.serviceCall.bookings", "array<variant>")).alias("bookings"),
        F.size(F.col("_t").cast("map<string,variant>")).alias("tabs"),
    )


@query("apply_changes", """
select id, case when quote_value <> '' then concat('Job of ', quote_value) else title end as title,
  status from job
""")
def apply_changes(spark, sf):
    jobs = S.jobs(spark, sf)
    quote = F.get_json_object("data_json", "$.quoteValue")
    changes = jobs.select("id", F.concat(F.lit("Job of "), quote).alias("title"),
                          F.lit("").alias("status"))
    after, _ = W.apply_changes(jobs, changes, ["id"], sparse=("title", "status"))
    return after.select("id", "title", "status")


