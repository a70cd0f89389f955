"""Scalar functions, each on a whole table."""

from pyspark.sql import functions as F

from ...functions import dates as DT
from ...functions import documents as DOC
from ...functions import text as T
from ...operators import deliveries as D, entities as E, reminders as R
from ...schemas import LINK, SETTINGS_DOC
from .. import standins as S
from ..registry import query

PROJECT_EVENTS = """
, pe as (
  select seq, trim(raw_reference) as reference, trim(raw_name) as name, trim(raw_email) as email,
    trim(raw_phone) as phone,
    case when raw_postcode = '' then raw_address else concat(raw_address, ', ', raw_postcode) end
      as address,
    case when price_quoted or price <= 0 then ''
      else regexp_replace(cast(price as varchar), '[.]0$', '') end as quote_value,
    replace(regexp_extract(raw_fee, '£\\s*([0-9,]+(?:[.][0-9]+)?)', 1), ',', '')
      as installation_value,
    raw_status as ext_status, raw_modified as modified,
    tenant_id || ':' || nullif(lower(trim(raw_reference)), '') as ref_key,
    tenant_id || ':' || nullif(lower(trim(raw_email)), '') as email_key,
    tenant_id || ':' || nullif(lower(trim(raw_phone)), '') as phone_key, received_at, tenant_id
  from ev where body = 'project')
"""


def captured(spark, sf):
    return D.capture_raw_event(S.deliveries(spark, sf))


def job_docs(spark, sf):
    return S.jobs(spark, sf).select("id", R.job_tabs().alias("tabs"))


def flat_events(spark, sf):
    return S._flat(spark, sf, "events", S.EVENT_SQL.format(**S.SPARK_TERMS, src="{src}"))


def flat_customers(spark, sf):
    return S.flat_customers(spark, sf)


@query("norm_text", "select seq, lower(trim(raw_reference)) as ref, lower(trim(raw_name)) as name from ev")
def norm_text(spark, sf):
    return flat_events(spark, sf).select(
        "seq", T.norm_text(F.col("raw_reference")).alias("ref"),
        T.norm_text(F.col("raw_name")).alias("name"),
    )


@query("kv_pivot", """
select seq, case body when 'project' then raw_reference else cast(user_id + 1 as varchar) end as ref,
  case body when 'project' then raw_phone end as phone
from ev where body in ('project', 'numeric')
""")
def kv_pivot(spark, sf):
    pairs = F.from_json(
        "payload", "json struct<infoProperties: array<struct<name: string, value: string>>>"
    )["json"]
    props = F.col("_p.infoProperties")
    return D.project_payload_gate(captured(spark, sf)).withColumn("_p", pairs).select(
        "seq", DOC.kv_pivot(props, "Reference").alias("ref"),
        DOC.kv_pivot(props, "Phone").alias("phone"),
    )


@query("extract_project_fields", PROJECT_EVENTS + """
select seq, reference, name, email, phone, address, quote_value, installation_value, ext_status,
  modified, null as error from pe
union all
select seq, '', '', '', '', '', '', '', '', '', 'Reference is a number' from ev where body = 'numeric'
""")
def extract_project_fields(spark, sf):
    return D.extract_project_fields(captured(spark, sf), keep=("seq",))


@query("parse_fee", """
select seq, replace(regexp_extract(raw_fee, '£\\s*([0-9,]+(?:[.][0-9]+)?)', 1), ',', '') as fee from ev
""")
def parse_fee(spark, sf):
    return flat_events(spark, sf).select("seq", T.parse_fee(F.col("raw_fee")).alias("fee"))


@query("positive_price_text", PROJECT_EVENTS + """
select seq, coalesce(quote_value, '') as price from ev left join pe using (seq)
""")
def positive_price_text(spark, sf):
    price = F.try_variant_get(DOC.parsed(F.col("payload")), "$.json.price", "variant")
    return captured(spark, sf).withColumn("_price", price).select(
        "seq", DOC.positive_price_text(F.col("_price")).alias("price")
    )


@query("join_nonempty", """
select seq, case when raw_postcode = '' then raw_address
  else concat(raw_address, ', ', raw_postcode) end as address from ev
""")
def join_nonempty(spark, sf):
    return flat_events(spark, sf).select(
        "seq", T.join_nonempty(", ", F.col("raw_address"), F.col("raw_postcode")).alias("address")
    )


@query("first_nonempty", """
select id, case when email2 <> '' then email2 when email <> '' then email else phone end as contact
from cust
""")
def first_nonempty(spark, sf):
    return flat_customers(spark, sf).select(
        "id", T.first_nonempty(F.col("email2"), F.col("email"), F.col("phone")).alias("contact")
    )


@query("derive_stage", PROJECT_EVENTS + """
select seq, case when quote_value <> '' then 'Quoted' else 'New Enquiry' end as stage from pe
""")
def derive_stage(spark, sf):
    return D.project_events(captured(spark, sf)).select(
        "seq", DOC.derive_stage(F.col("quote_value")).alias("stage")
    )


@query("default_on_flag", """
select id, coalesce(survey_notify, true) as survey_on, coalesce(install_notify, true) as install_on,
  coalesce(service_notify, true) as service_on from job
""")
def default_on_flag(spark, sf):
    return job_docs(spark, sf).select(
        "id", *[DOC.default_on_flag(F.col(f"tabs.{tab}.notifyEnabled")).alias(name)
                for tab, name in (("survey", "survey_on"), ("installation", "install_on"),
                                  ("serviceCall", "service_on"))]
    )


@query("is_booked", """
select id, survey_date <> '' and survey_fitter <> '' as survey_booked,
  install_date <> '' and n_fitters > 0 as install_booked from job
""")
def is_booked(spark, sf):
    return job_docs(spark, sf).select(
        "id",
        DOC.is_booked(F.col("tabs.survey.date"), F.col("tabs.survey.fitter")).alias("survey_booked"),
        DOC.is_install_booked(F.col("tabs.installation.date"), F.col("tabs.installation.fitters"))
        .alias("install_booked"),
    )


@query("days_until", f"""
select id, cast(try_cast(survey_date as date) - date '{S.RUN_DATE}' as int) as survey_days,
  cast(try_cast(install_date as date) - date '{S.RUN_DATE}' as int) as install_days from job
""")
def days_until(spark, sf):
    return job_docs(spark, sf).select(
        "id", DT.days_until(F.col("tabs.survey.date"), S.RUN_DATE).alias("survey_days"),
        DT.days_until(F.col("tabs.installation.date"), S.RUN_DATE).alias("install_days"),
    )


@query("long_date", """
select id, coalesce(strftime(try_cast(survey_date as date), '%A %-d %B %Y'), '') as day from job
""")
def long_date(spark, sf):
    return job_docs(spark, sf).select("id", DT.long_date(F.col("tabs.survey.date")).alias("day"))


@query("short_date", "select id, strftime(created_at, '%d/%m/%Y') as day from job")
def short_date(spark, sf):
    return S.flat_jobs(spark, sf).select(
        "id", DT.short_date(F.col("created_at").cast("date")).alias("day")
    )


@query("join_names", """
select id, case n_fitters when 0 then '' when 1 then fitter_a
  else concat(fitter_a, ', ', fitter_b) end as fitters from job
""")
def join_names(spark, sf):
    return job_docs(spark, sf).select(
        "id", T.join_names(F.col("tabs.installation.fitters")).alias("fitters")
    )


TEMPLATE = "{{name}} in {{sector}} ({{sector}}): {{unknown}}{{name}}"


@query("fill_template", f"""
select id, replace(replace('{TEMPLATE}', '{{{{name}}}}', concat('[{{{{sector}}}}] ', name)),
  '{{{{sector}}}}', sector) as text from cust
""")
def fill_template(spark, sf):
    # The first value brings in a later key, which is filled too.
    return flat_customers(spark, sf).select("id", T.fill_template(F.lit(TEMPLATE), {
        "name": F.concat(F.lit("[{{sector}}] "), "name"), "sector": F.col("sector"),
    }).alias("text"))


@query("recipient_list", """
select id, concat_ws('; ', nullif(email, ''), nullif(email2, '')) as recipients from cust
""")
def recipient_list(spark, sf):
    return flat_customers(spark, sf).select(
        "id", F.array_join(T.recipient_list(F.col("email"), F.col("email2")), "; ").alias("recipients")
    )


@query("bcc_of_template", """
select tenant_id, case when has_day_template then 'copies@mail.test' end as bcc from sett
""")
def bcc_of_template(spark, sf):
    doc = F.from_json("data_json", SETTINGS_DOC)
    bcc = F.try_element_at(doc["emailTemplates"], F.lit("installReminderDay"))["bcc"]
    return S.settings(spark, sf).select("tenant_id", T.bcc_of_template(bcc).alias("bcc"))


@query("redact_map", """
select tenant_id, viewer, case viewer when 'office' then n_name else 'true' end as ann, '' as bob
from sett, (values ('office'), ('fitter'), (null)) as v(viewer)
""")
def redact_map(spark, sf):
    doc = F.from_json("data_json", SETTINGS_DOC)
    viewers = F.array(F.lit("office"), F.lit("fitter"), F.lit(None).cast("string"))
    seen = S.settings(spark, sf).select(
        "tenant_id", doc["fitterPasswords"].alias("_m"), F.explode(viewers).alias("viewer")
    ).withColumn("_r", DOC.redact_map(F.col("_m"), F.col("viewer")))
    return seen.select("tenant_id", "viewer", F.col("_r")["Ann"].alias("ann"),
                       F.col("_r")["Bob"].alias("bob"))


@query("text_excerpt", """
select doc_id, md5(left(text, 2000)) as captured, md5(left(text, 5000)) as logged from documents
""")
def text_excerpt(spark, sf):
    return S.table(spark, sf, "documents").select(
        "doc_id", F.md5(T.text_excerpt(F.col("text")).cast("binary")).alias("captured"),
        F.md5(T.text_excerpt(F.col("text"), 5000).cast("binary")).alias("logged"),
    )


# Requests made of orders: the status stands for the reminder asked for.
REQUEST_SQL = """
select case when o_orderpriority = '5-LOW' then null
  when o_orderpriority = '2-HIGH' then -1 - o_orderkey else o_orderkey end as job_id,
  case o_orderstatus when 'P' then 'week' when 'O' then 'day' else 'month' end as reminder_key,
  o_orderkey as request_id
from orders
"""


def send_requests(spark, sf):
    return S._flat(spark, sf, "orders", REQUEST_SQL)


@query("validate_send_request", f"""
, req as ({REQUEST_SQL}) select request_id, job_id, reminder_key from req
where job_id is not null and job_id <> 0 and reminder_key in ('week', 'day')
""")
def validate_send_request(spark, sf):
    return R.valid_requests(send_requests(spark, sf))[0].select("request_id", "job_id", "reminder_key")


@query("validate_send_request_refused", f"""
, req as ({REQUEST_SQL}) select request_id, reminder_key from req
where job_id is null or job_id = 0 or reminder_key not in ('week', 'day')
""")
def validate_send_request_refused(spark, sf):
    return R.valid_requests(send_requests(spark, sf))[1].select("request_id", "reminder_key")


@query("filter_by_stage_status", """
select id, stage from cust where stage in ('Quoted', 'Deal Won')
""")
def filter_by_stage(spark, sf):
    return E.filter_by(S.bare_customers(spark, sf), "stage", ["Quoted", "Deal Won"]).select("id", "stage")


@query("filter_by_stage_status_jobs", "select id, status from job where status = 'Book Survey'")
def filter_by_status(spark, sf):
    return E.filter_by(S.bare_jobs(spark, sf), "status", ["Book Survey"]).select("id", "status")


@query("link_fields", "select id, link_ref as ref, link_modified as modified from job")
def link_fields(spark, sf):
    return E.decode_entity(S.jobs(spark, sf), LINK.job_doc(), keep=("id",)).select(
        "id", F.col(LINK.ref).alias("ref"), F.col(LINK.modified).alias("modified")
    )
