"""Reports."""

from pyspark.sql import functions as F

from ...operators import reports as REP
from .. import standins as S
from ..registry import query

ENTRIES = """
, entry as (
  select id as job_id, customer_id, survey_fitter as fitter, survey_date as event_date, '' as start,
    'survey' as kind, cast(null as varchar) as booking_id, 0 as pos
  from job where survey_date <> '' and survey_fitter <> ''
  union all
  select id, customer_id, f.fitter, install_date, install_start, 'installation', null, f.pos
  from (select *, unnest([{'fitter': fitter_a, 'pos': 0}, {'fitter': fitter_b, 'pos': 1}]) as f
    from job) where install_date <> '' and f.pos < n_fitters
  union all
  select b.job_id, j.customer_id, b.fitter, b.date, '', 'service call', b.booking_id, b.pos
  from booking b join job j on j.id = b.job_id where b.date <> '' and b.fitter <> '')
, cal as (select * from entry where try_cast(event_date as date) is not null)
, dl as (
  select 'job' as source, delivery_supplier as supplier, try_cast(delivery_date as date) as day
  from job where n_deliveries > 0
  union all select 'manual', supplier, try_cast(date as date) from morder)
"""


def entries(spark, sf):
    return REP.calendar_entries(S.jobs(spark, sf))


def deliveries(spark, sf):
    return REP.all_deliveries(S.jobs(spark, sf), S.manual_orders(spark, sf))


@query("customers_by_sector", """
select cast(o as int) as ordinal, s as sector, count(id) as customers
from (values (1, 'Retail'), (2, 'Trade'), (3, 'Commercial')) v(o, s)
  left join cust on cust.sector = v.s group by 1, 2
""")
def customers_by_sector(spark, sf):
    return REP.customers_by_sector(S.customers(spark, sf))


DEALS = """
select sector, cast(count(*) as bigint) as deals,
  cast(sum(cast(quote_value as decimal(18,2))) as varchar) as quoted
from job join cust on cust.id = job.customer_id {} group by sector
"""


def _quoted_text(df):
    return df.withColumn("quoted", F.col("quoted").cast("string"))


@query("deals_won_by_sector", DEALS.format(""))
def deals_won_by_sector(spark, sf):
    return _quoted_text(REP.deals_won_by_sector(S.jobs(spark, sf), S.customers(spark, sf)))


@query("deals_won_by_sector_filtered", DEALS.format("where sector in ('Trade')"))
def deals_won_filtered(spark, sf):
    return _quoted_text(
        REP.deals_won_by_sector(S.jobs(spark, sf), S.customers(spark, sf), ("Trade",))
    )


@query("customer_job_counts", """
select c.id, c.name, count(j.id) as jobs, count(j.id) filter (where j.status <> 'Job Completed')
  as active, count(j.id) filter (where j.status = 'Job Completed') as completed
from cust c left join job j on j.customer_id = c.id group by 1, 2
""")
def customer_job_counts(spark, sf):
    return REP.customer_job_counts(S.bare_jobs(spark, sf), S.bare_customers(spark, sf))


def traders(spark, sf):
    """Customers under the name of the trader they buy for: two out of every four ids."""
    trader = F.concat(F.lit(" Trader "), F.floor(F.col("id") / 4).cast("string"))
    return S.customers(spark, sf).withColumn("name", trader)


TRADERS = """
, tr as (select id, stage, concat('trader ', cast(floor(id / 4) as bigint)) as name_key,
  phone as phone_key from cust)
, grp as (select name_key, phone_key, count(*) as records, min(id) as first_id,
    count(distinct stage) as stages from tr group by 1, 2 having count(*) > 1)
"""


@query("duplicate_customers", TRADERS + "select * from grp")
def duplicate_customers(spark, sf):
    return REP.duplicate_customers(traders(spark, sf))[0]


@query("duplicate_customers_members", TRADERS + """
select tr.id, tr.stage, grp.first_id, grp.records from tr join grp using (name_key, phone_key)
""")
def duplicate_members(spark, sf):
    return REP.duplicate_customers(traders(spark, sf))[1]


@query("booking_calendar", ENTRIES + """
select fitter, event_date, start, kind, job_id, booking_id, cast(pos as int) as pos,
  c.doc_name as customer, c.address, row_number() over (partition by fitter, event_date
    order by start, kind, job_id, pos) as seq_in_day
from cal left join cust c on c.id = cal.customer_id
""")
def booking_calendar(spark, sf):
    return REP.booking_calendar(S.jobs(spark, sf), S.customers(spark, sf))


@query("calendar_buckets", ENTRIES + """
select cast(cast(date_trunc('week', cast(event_date as date)) as date) as varchar) as week,
  cast(cast(date_trunc('month', cast(event_date as date)) as date) as varchar) as month,
  isodow(cast(event_date as date)) < 6 as working_week,
  cast(case when start <> '' and cast(substr(start, 1, 2) as int) between 7 and 19
    then cast(substr(start, 1, 2) as int) end as int) as hour, count(*) as entries
from cal group by all
""")
def calendar_buckets(spark, sf):
    return REP.calendar_buckets(entries(spark, sf)).groupBy(
        F.col("week").cast("string").alias("week"), F.col("month").cast("string").alias("month"),
        "working_week", "hour",
    ).agg(F.count(F.lit(1)).alias("entries"))


@query("calendar_view", ENTRIES + f"""
select fitter, event_date, kind, job_id, cast(pos as int) as pos from cal
where date_trunc('week', cast(event_date as date)) = date_trunc('week', date '{S.RUN_DATE}')
  and isodow(cast(event_date as date)) < 6
""")
def calendar_view(spark, sf):
    return REP.calendar_view(entries(spark, sf), "working week", S.RUN_DATE).select(
        "fitter", "event_date", "kind", "job_id", "pos"
    )


@query("delivery_calendar", ENTRIES + """
select cast(day as varchar) as day, source, count(*) as deliveries from dl
where day is not null group by 1, 2
""")
def delivery_calendar(spark, sf):
    return REP.delivery_calendar(deliveries(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("delivery_calendar_totals", ENTRIES + """
select cast(day as varchar) as day, source, count(*) as deliveries from dl
where day is not null group by rollup (day, source)
""")
def delivery_totals(spark, sf):
    return REP.delivery_calendar(deliveries(spark, sf), totals=True).withColumn(
        "day", F.col("day").cast("string")
    )


@query("upcoming_deliveries", ENTRIES + f"""
select dl.supplier, cast(day as varchar) as day, count(*) as deliveries,
  any_value(s.s_nationkey) as nation
from dl left join supplier s on s.s_name = dl.supplier
where day >= date '{S.RUN_DATE}' group by 1, 2
""")
def upcoming_deliveries(spark, sf):
    suppliers = S.table(spark, sf, "supplier").select(
        F.col("s_name").alias("supplier"), F.col("s_nationkey").alias("nation")
    )
    return REP.upcoming_deliveries(deliveries(spark, sf), suppliers, S.RUN_DATE).withColumn(
        "day", F.col("day").cast("string")
    )


@query("site_visits_by_fitter_month", ENTRIES + """
select fitter, cast(cast(date_trunc('month', cast(event_date as date)) as date) as varchar) as month,
  count(*) as visits from cal group by 1, 2
""")
def site_visits(spark, sf):
    return REP.site_visits_by_fitter_month(entries(spark, sf)).withColumn(
        "month", F.col("month").cast("string")
    )


@query("cards_by_stage", "select tenant_id, stage, count(*) as cards from cust group by 1, 2")
def cards_by_stage(spark, sf):
    return REP.cards_by_stage(S.bare_customers(spark, sf), "stage")


@query("cards_by_status", "select tenant_id, status, count(*) as cards from job group by 1, 2")
def cards_by_status(spark, sf):
    return REP.cards_by_stage(S.bare_jobs(spark, sf), "status")


@query("email_status_report", """
, marks as (
  select 'survey_booked' as kind, survey_sent as mark from job
  union all select 'survey_day', survey_reminder from job
  union all select 'install_booked', install_booked from job
  union all select 'install_week', week_mark from job
  union all select 'install_day', day_mark from job
  union all select 'service_booked', booked_mark from booking
  union all select 'service_day', reminder_mark from booking)
select kind, case when mark = 'sent' then 'sent' else 'pending' end as status, count(*) as messages
from marks group by 1, 2
""")
def email_status_report(spark, sf):
    return REP.email_status_report(S.jobs(spark, sf))
