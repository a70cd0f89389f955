"""Due reminders, new bookings, the outbox and send results."""

from pyspark.sql import functions as F

from ...operators import bookings as B, outbox as O, reminders as R
from ...session import scratch_dir
from ...sources.tables import stored
from .. import daily, standins as S
from ..registry import query
from .functions import REQUEST_SQL, send_requests

_FITTERS = "case n_fitters when 0 then '' when 1 then fitter_a else concat(fitter_a, ', ', fitter_b) end"
_DAYS = f"cast(try_cast({{}} as date) - date '{S.RUN_DATE}' as int)"

FIRST_BOOKING = """
, fb as (select job_id, booking_id, arg_min(date, pos) as date, arg_min(fitter, pos) as fitter
  from booking group by 1, 2)
"""
DUE = FIRST_BOOKING + f"""
, due as (
  select id as job_id, cast(null as varchar) as booking_id, 'install_week' as kind,
    install_date as event_date, {_DAYS.format('install_date')} as days_until, customer_id,
    install_date as message_date, {_FITTERS} as message_fitters
  from job where {_DAYS.format('install_date')} between 1 and 7 and week_mark <> 'sent'
  union all
  select id, null, 'install_day', install_date, {_DAYS.format('install_date')}, customer_id,
    install_date, {_FITTERS}
  from job where {_DAYS.format('install_date')} between 0 and 1 and day_mark <> 'sent'
  union all
  select id, null, 'survey_day', survey_date, {_DAYS.format('survey_date')}, customer_id,
    survey_date, survey_fitter
  from job where {_DAYS.format('survey_date')} between 0 and 1 and survey_fitter <> ''
    and coalesce(survey_notify, true) and survey_reminder is null
  union all
  select b.job_id, b.booking_id, 'service_day', b.date, {_DAYS.format('b.date')}, job.customer_id,
    fb.date, fb.fitter
  from booking b join job on job.id = b.job_id
    join fb on fb.job_id = b.job_id and fb.booking_id = b.booking_id
  where {_DAYS.format('b.date')} between 0 and 1 and b.fitter <> ''
    and coalesce(service_notify, true) and b.reminder_mark is null)
"""

BOOKED = FIRST_BOOKING + """
, prior as (
  select job_id, booking_id, arg_max(case when pos < j.bookings_were_set then date else '' end, pos)
      as date, arg_max(fitter, pos) as fitter
  from booking join job j on j.id = booking.job_id group by 1, 2)
, booked as (
  select id as job_id, cast(null as varchar) as booking_id, 'survey_booked' as kind, customer_id,
    survey_date as message_date, survey_fitter as message_fitters from job
  where not survey_was_set and survey_date <> '' and survey_fitter <> ''
    and coalesce(survey_notify, true) and survey_sent is null
  union all
  select id, null, 'install_booked', customer_id, install_date, """ + _FITTERS + """ from job
  where not install_was_set and install_date <> '' and n_fitters > 0
    and coalesce(install_notify, true) and install_booked is null
  union all
  select b.job_id, b.booking_id, 'service_booked', j.customer_id, fb.date, fb.fitter
  from booking b join job j on j.id = b.job_id
    join fb on fb.job_id = b.job_id and fb.booking_id = b.booking_id
    join prior p on p.job_id = b.job_id and p.booking_id = b.booking_id
  where coalesce(service_notify, true) and b.date <> '' and b.fitter <> ''
    and b.booked_mark is null and not (p.date <> '' and p.fitter <> ''))
"""


def _quoted(text):
    return "'" + text.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


TEMPLATES = ", templ(ordinal, kind, booking_type, template_key, date_name, who_name, subject, body) as (values " + ", ".join(
    f"({n}, '{kind}', '{group}', '{key}', '{date}', '{who}', "
    f"{_quoted(O._SUBJECTS[kind])}, {_quoted(O._BODY % (date, who))})"
    for n, (kind, group, key, date, who) in enumerate(O.CATALOG, start=1)
) + ")"


def rendered(source):
    """CTE `msg`: the messages of the rows of `source`."""
    def fill(text):
        chain = text
        for name, value in (
            ("'{{customerName}}'", "c.doc_name"), ("'{{address}}'", "c.address"),
            ("concat('{{', date_name, '}}')",
             "coalesce(strftime(try_cast(message_date as date), '%A %-d %B %Y'), '')"),
            ("concat('{{', who_name, '}}')", "coalesce(message_fitters, '')"),
            ("'{{companyName}}'", f"coalesce(nullif(s.company_name, ''), '{O.DEFAULT_COMPANY}')"),
            ("'{{companyPhone}}'", "coalesce(s.company_phone, '')"),
        ):
            chain = f"replace({chain}, {name}, {value})"
        return chain

    own = "(d.kind = 'install_day' and coalesce(s.has_day_template, false))"
    subject = f"case when {own} then 'Tomorrow: {{{{customerName}}}}' else t.subject end"
    body = (
        f"case when {own} then '{{{{installDate}}}} with {{{{fitterNames}}}} at {{{{address}}}} "
        f"from {{{{companyName}}}}, {{{{other}}}}' else t.body end"
    )
    return TEMPLATES + f"""
, msg as (
  select d.job_id, d.booking_id, d.kind, concat_ws(', ', nullif(c.email, ''), nullif(c.email2, ''))
      as "to", case when {own} then 'copies@mail.test' end as bcc,
    {fill(subject)} as subject, {fill(body)} as body, false as is_test
  from {source} d join cust c on c.id = d.customer_id
    left join sett s on s.tenant_id = c.tenant_id join templ t on t.kind = d.kind
  where c.email <> '' or c.email2 <> '')
"""


def due(spark, sf, *kinds):
    return R.due_reminders(S.jobs(spark, sf), S.RUN_DATE, kinds or R.REMINDERS)


def parts(spark, sf):
    return S.customers(spark, sf), S.settings(spark, sf), O.default_templates(spark)


def _register_due():
    shown = "job_id, booking_id, kind, event_date, days_until"
    for name, kinds in (
        ("due_install_week", (R.INSTALL_WEEK,)), ("due_install_day", (R.INSTALL_DAY,)),
        ("due_survey_day", (R.SURVEY_DAY,)), ("due_service_call_day", (R.SERVICE_DAY,)),
        ("due_reminders", R.REMINDERS),
    ):
        listed = ", ".join(f"'{k}'" for k in kinds)

        @query(name, DUE + f"select {shown} from due where kind in ({listed})")
        def run(spark, sf, kinds=kinds):
            return due(spark, sf, *kinds).select(*shown.split(", "))


def _register_booked():
    shown = "job_id, booking_id, kind, customer_id, message_date, message_fitters"
    for name, kinds in (
        ("survey_booked_transition", (R.SURVEY_BOOKED,)),
        ("install_booked_transition", (R.INSTALL_BOOKED,)),
        ("service_booking_transition", (R.SERVICE_BOOKED,)),
        ("booking_transitions", B.BOOKED_KINDS),
    ):
        listed = ", ".join(f"'{k}'" for k in kinds)

        @query(name, BOOKED + f"select {shown} from booked where kind in ({listed})")
        def run(spark, sf, kinds=kinds):
            return B.booking_transitions(
                S.jobs(spark, sf, before=True), S.jobs(spark, sf), kinds
            ).select(*shown.split(", "))


@query("due_from_schedule", DUE + "select job_id, booking_id, kind, event_date, days_until from due")
def due_from_schedule(spark, sf):
    """The same reminders from a schedule written by day."""
    folder = scratch_dir(spark, "schedule")
    daily.write_schedule(S.jobs(spark, sf), folder)
    return R.due_from_schedule(spark.read.parquet(folder), S.RUN_DATE).select(
        "job_id", "booking_id", "kind", "event_date", "days_until"
    )


def kept_schedule(spark, sf, now=None):
    """A schedule of the jobs as they were before the last save, renewed by two batches of saves."""
    schedule = daily.schedule_table(spark, f"{scratch_dir(spark, 'kept')}/schedule")
    # Read by the start and by each batch, so that their documents are made once.
    before = stored(S.jobs(spark, sf, before=True), "jobs-before")
    now = S.jobs(spark, sf) if now is None else now
    schedule.start(daily.monthly_schedule(before))
    for batch_id in (0, 1):
        mine = F.col("id") % 2 == batch_id
        daily.record_schedule(schedule, before.filter(mine), now.filter(mine), batch_id)
    return schedule


@query("maintained_schedule", DUE + "select job_id, booking_id, kind, event_date, days_until from due")
def maintained_schedule(spark, sf):
    """The same reminders from a schedule that was kept up to date, not from the documents."""
    return daily.scheduled_due(kept_schedule(spark, sf), S.RUN_DATE).select(
        "job_id", "booking_id", "kind", "event_date", "days_until"
    )


_register_due()
_register_booked()


@query("build_outbox", DUE + rendered("due") + "select * from msg")
def build_outbox(spark, sf):
    outbox, _ = O.build_outbox(due(spark, sf), *parts(spark, sf))
    return daily.messages_as_text(outbox)


@query("test_override_mode", DUE + rendered("due") + """
select d.job_id, d.booking_id, d.kind, 'try@mail.test' as "to", true as is_test
from due d join cust c on c.id = d.customer_id
""")
def test_override_mode(spark, sf):
    outbox, _ = O.build_outbox(due(spark, sf), *parts(spark, sf), test_email="try@mail.test")
    return daily.messages_as_text(outbox).select("job_id", "booking_id", "kind", "to", "is_test")


# One request per order: unknown jobs, unknown bookings, missing customers, no address.
MESSAGE_REQUESTS = """
select case when o_orderpriority = '2-HIGH' then -1 - o_orderkey else o_orderkey end as job_id,
  case o_orderstatus when 'P' then concat('b', o_orderkey % 3) end as booking_id,
  case o_orderstatus when 'P' then 'service_booked' when 'O' then 'install_week'
    else 'survey_booked' end as kind
from orders
"""


def message_requests(spark, sf):
    return S._flat(spark, sf, "orders", MESSAGE_REQUESTS)


@query("outbox_rejects", FIRST_BOOKING + f"""
, req as ({MESSAGE_REQUESTS})
, why as (
  select req.*, case when job.id is null then 'job not found'
    when req.kind = 'service_booked' and fb.job_id is null then 'booking not found'
    when c.id is null then 'customer not found'
    when c.email = '' and c.email2 = '' then 'no recipient' end as reason
  from req left join job on job.id = req.job_id
    left join fb on fb.job_id = req.job_id and fb.booking_id = req.booking_id
    left join cust c on c.id = job.customer_id)
select * from why where reason is not null
""")
def outbox_rejects(spark, sf):
    asked = R.attach_jobs(message_requests(spark, sf), S.jobs(spark, sf))
    return O.build_outbox(asked, *parts(spark, sf))[1]


@query("outbox_of_requests", FIRST_BOOKING + f"""
, req as ({MESSAGE_REQUESTS})
, asked as (
  select req.*, job.customer_id, case req.kind when 'service_booked' then fb.date
      when 'install_week' then install_date else survey_date end as message_date,
    case req.kind when 'service_booked' then fb.fitter when 'install_week' then {_FITTERS}
      else survey_fitter end as message_fitters
  from req join job on job.id = req.job_id
    left join fb on fb.job_id = req.job_id and fb.booking_id = req.booking_id
  where req.kind <> 'service_booked' or fb.job_id is not null)
""" + rendered("asked") + "select * from msg")
def outbox_of_requests(spark, sf):
    asked = R.attach_jobs(message_requests(spark, sf), S.jobs(spark, sf))
    return daily.messages_as_text(O.build_outbox(asked, *parts(spark, sf))[0])


@query("forced_reminder", f"""
, req as ({REQUEST_SQL})
, asked as (
  select job.id as job_id, cast(null as varchar) as booking_id,
    case reminder_key when 'week' then 'install_week' else 'install_day' end as kind,
    customer_id, install_date as message_date, {_FITTERS} as message_fitters
  from req join job on job.id = req.job_id where reminder_key in ('week', 'day') and job_id <> 0)
""" + rendered("asked") + "select job_id, kind, \"to\", subject, body from msg")
def forced_reminder(spark, sf):
    usable, _ = R.valid_requests(send_requests(spark, sf))
    asked = R.attach_jobs(R.forced_reminders(usable), S.jobs(spark, sf))
    outbox, _ = O.build_outbox(asked, *parts(spark, sf))
    return daily.messages_as_text(outbox).select("job_id", "kind", "to", "subject", "body")


@query("template_lookup", DUE + TEMPLATES + """
select d.job_id, d.booking_id, d.kind,
  case when d.kind = 'install_day' and coalesce(s.has_day_template, false)
    then 'Tomorrow: {{customerName}}' else t.subject end as subject
from due d join cust c on c.id = d.customer_id left join sett s on s.tenant_id = c.tenant_id
  join templ t on t.kind = d.kind
""")
def template_lookup(spark, sf):
    customers, settings, templates = parts(spark, sf)
    owned = due(spark, sf).join(
        customers.select(F.col("id").alias("customer_id"), "tenant_id"), "customer_id"
    )
    return O.template_lookup(O.settings_join(owned, settings), templates).select(
        "job_id", "booking_id", "kind", "subject"
    )


@query("default_templates", DUE + TEMPLATES + """
select t.kind, t.template_key, t.subject, md5(t.body) as body_md5, count(d.kind) as due
from templ t left join due d on t.kind = d.kind group by all
""")
def default_templates(spark, sf):
    counts = due(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("due"))
    return O.default_templates(spark).join(counts, "kind", "left").select(
        "kind", "template_key", F.col("default_subject").alias("subject"),
        F.md5(F.col("default_body").cast("binary")).alias("body_md5"),
        F.coalesce("due", F.lit(0)).alias("due"),
    )


@query("template_catalog", TEMPLATES + """
select s.tenant_id, cast(t.ordinal as int) as ordinal, t.booking_type, t.template_key,
  t.kind = 'install_day' and s.has_day_template as is_custom,
  case when t.kind = 'install_day' and s.has_day_template then 'Tomorrow: {{customerName}}'
    else t.subject end as subject
from sett s, templ t
""")
def template_catalog(spark, sf):
    return O.template_catalog(spark, S.settings(spark, sf))


# Results came in for the messages about whole jobs; the tenant of the job stands for the outcome.
RESULTS_SQL = """
, res as (select id as job_id, k.kind, case tenant_id when 1 then 'Failed' when 2 then 'Throttled'
    else 'Succeeded' end as status
  from job, (values ('install_week'), ('install_day'), ('survey_day')) k(kind))
"""


def send_results(spark, sf):
    status = F.when(F.col("tenant_id") == 1, "Failed").when(F.col("tenant_id") == 2, "Throttled")
    return S.bare_jobs(spark, sf).select(
        F.col("id").alias("job_id"), F.lit(None).cast("string").alias("booking_id"),
        F.explode(F.array(*[F.lit(k) for k in (R.INSTALL_WEEK, R.INSTALL_DAY, R.SURVEY_DAY)]))
        .alias("kind"), status.otherwise("Succeeded").alias("status"),
        F.when(status.isNotNull(), F.concat(F.lit("error: "), status)).alias("error"),
    )


@query("reconcile_send_results", DUE + rendered("due") + RESULTS_SQL + """
select msg.job_id, msg.booking_id, msg.kind from msg join res on res.job_id = msg.job_id
  and res.kind = msg.kind where msg.booking_id is null and res.status = 'Succeeded'
""")
def reconcile_send_results(spark, sf):
    outbox, _ = O.build_outbox(due(spark, sf), *parts(spark, sf))
    return O.reconcile_send_results(outbox, send_results(spark, sf))[0]


@query("reconcile_send_results_failed", DUE + rendered("due") + RESULTS_SQL + """
select distinct msg.job_id, msg.booking_id, msg.kind, coalesce(res.status, 'no result') as status,
  concat('error: ', res.status) as error
from msg left join res on res.job_id = msg.job_id and res.kind = msg.kind
  and msg.booking_id is null
where coalesce(res.status, '') <> 'Succeeded'
""".replace("concat('error: ', res.status)", "'error: ' || res.status"))
def reconcile_failed(spark, sf):
    outbox, _ = O.build_outbox(due(spark, sf), *parts(spark, sf))
    return O.reconcile_send_results(outbox, send_results(spark, sf))[1]


@query("close_daily_run", DUE + rendered("due") + RESULTS_SQL + """
, done as (select distinct msg.job_id, msg.kind from msg join res on res.job_id = msg.job_id
    and res.kind = msg.kind where msg.booking_id is null and res.status = 'Succeeded')
select id, case when exists (select 1 from done where job_id = id and kind = 'install_week')
    then 'sent' else week_mark end as week,
  case when exists (select 1 from done where job_id = id and kind = 'install_day')
    then 'sent' else day_mark end as day,
  case when exists (select 1 from done where job_id = id and kind = 'survey_day')
    then 'sent' else survey_reminder end as survey
from job
""")
def close_daily_run(spark, sf):
    outbox, _ = O.build_outbox(due(spark, sf), *parts(spark, sf))
    after, _ = daily.close_daily_run(
        S.jobs(spark, sf), outbox, send_results(spark, sf), F.lit(S.RUN_DATE).cast("date")
    )
    tabs = after.select("id", R.job_tabs().alias("t"))
    reminders = F.col("t.installation.emailReminders")
    return tabs.select("id", reminders["week"]["status"].alias("week"),
                       reminders["day"]["status"].alias("day"),
                       F.col("t.survey.reminderSent.status").alias("survey"))


@query("daily_reminder_run", DUE + rendered("due") + "select * from msg")
def daily_reminder_run(spark, sf):
    outbox, _ = daily.daily_reminder_run(
        spark, S.jobs(spark, sf), S.customers(spark, sf), S.settings(spark, sf), S.RUN_DATE,
        scratch_dir(spark, "daily"),
    )
    return daily.messages_as_text(outbox)


@query("scheduled_reminder_run", DUE + rendered("due") + RESULTS_SQL + """
select due.job_id, due.booking_id, due.kind, due.event_date, due.days_until from due
where not exists (
  select 1 from msg join res on res.job_id = msg.job_id and res.kind = msg.kind
  where msg.booking_id is null and res.status = 'Succeeded' and msg.job_id = due.job_id and msg.kind = due.kind)
""")
def scheduled_reminder_run(spark, sf):
    """What stays due of the day after its run from the schedule, whose results were marked."""
    jobs = stored(S.jobs(spark, sf), "jobs")
    schedule = kept_schedule(spark, sf, jobs)
    outbox, _ = daily.daily_reminder_run(
        spark, jobs, S.customers(spark, sf), S.settings(spark, sf), S.RUN_DATE,
        scratch_dir(spark, "daily"), schedule=schedule,
    )
    daily.close_daily_run(
        jobs, outbox, send_results(spark, sf), F.lit(S.RUN_DATE).cast("date"), schedule=schedule, batch_id=2
    )
    return daily.scheduled_due(schedule, S.RUN_DATE).select(
        "job_id", "booking_id", "kind", "event_date", "days_until"
    )


@query("save_jobs", BOOKED + rendered("booked") + "select * from msg")
def save_jobs(spark, sf):
    changes = S.jobs(spark, sf).select("id", "tenant_id", "customer_id", "data_json")
    _, _, outbox, _ = daily.save_jobs(
        spark, S.jobs(spark, sf, before=True), S.customers(spark, sf), S.settings(spark, sf),
        changes, F.lit(S.NOW).cast("timestamp"),
    )
    return daily.messages_as_text(outbox)


# ---- joins -----------------------------------------------------------------------------------

@query("job_customer_join", """
select job.id, job.customer_id, c.doc_name as customer from job join cust c on c.id = job.customer_id
""")
def job_customer_join(spark, sf):
    joined, _ = O.job_customer_join(S.jobs(spark, sf), S.customers(spark, sf))
    return joined.select(
        "id", "customer_id", F.get_json_object("customer_json", "$.name").alias("customer")
    )


@query("job_customer_join_missing", "select id, customer_id from job where customer_id < 0")
def job_customer_missing(spark, sf):
    return O.job_customer_join(S.jobs(spark, sf), S.customers(spark, sf))[1].select("id", "customer_id")


@query("settings_join", """
select c.id, s.company_name, s.company_phone from cust c left join sett s on s.tenant_id = c.tenant_id
""")
def settings_join(spark, sf):
    return O.settings_join(S.customers(spark, sf), S.settings(spark, sf)).select(
        "id", F.col("settings.companyName").alias("company_name"),
        F.col("settings.companyPhone").alias("company_phone"),
    )


@query("booking_before_after", """
, prior as (
  select job_id, booking_id, arg_max(case when pos < j.bookings_were_set then date else '' end, pos)
      as date, arg_max(fitter, pos) as fitter
  from booking join job j on j.id = booking.job_id group by 1, 2)
select b.job_id, b.booking_id, cast(b.pos as int) as pos, b.date, b.fitter, true as existed,
  p.date as date_before, p.fitter as fitter_before
from booking b join prior p on p.job_id = b.job_id and p.booking_id = b.booking_id
""")
def booking_before_after(spark, sf):
    return B.booking_before_after(S.jobs(spark, sf, before=True), S.jobs(spark, sf))


BOOKING_REQUESTS = """
select case when o_orderpriority = '2-HIGH' then -1 - o_orderkey else o_orderkey end as job_id,
  concat('b', o_custkey % 3) as booking_id from orders
"""


@query("booking_lookup", FIRST_BOOKING + f"""
, req as ({BOOKING_REQUESTS})
select req.job_id, req.booking_id, fb.date, fb.fitter from req join fb on fb.job_id = req.job_id
  and fb.booking_id = req.booking_id
""")
def booking_lookup(spark, sf):
    requests = S._flat(spark, sf, "orders", BOOKING_REQUESTS.replace("from orders", "\nfrom orders"))
    return R.booking_lookup(requests, S.jobs(spark, sf))[0]


@query("booking_lookup_missing", FIRST_BOOKING + f"""
, req as ({BOOKING_REQUESTS})
select req.job_id, req.booking_id,
  case when job.id is null then 'job not found' else 'booking not found' end as reason
from req left join job on job.id = req.job_id
  left join fb on fb.job_id = req.job_id and fb.booking_id = req.booking_id
where fb.job_id is null
""")
def booking_lookup_missing(spark, sf):
    requests = S._flat(spark, sf, "orders", BOOKING_REQUESTS.replace("from orders", "\nfrom orders"))
    return R.booking_lookup(requests, S.jobs(spark, sf))[1]


