"""Scans, lookups, decoding, blobs, payloads and uploads."""

from pyspark.sql import functions as F

from ...functions.documents import parsed
from ...operators import attachments, deliveries as D, entities as E
from ...schemas import LINK, MANUAL_ORDERS_DOC, SETTINGS_DOC
from .. import standins as S
from ..registry import query

GET_REQUESTS = """
select c_custkey as id, case when c_acctbal < 0 then cast(99 as bigint)
  else cast(c_nationkey as bigint) end as tenant_id from customer
"""


@query("list_entities", """
select tenant_id, id, row_number() over (partition by tenant_id order by created_at desc, id desc)
  as position from cust
""")
def list_entities(spark, sf):
    return E.rank_entities(S.bare_customers(spark, sf)).select("tenant_id", "id", "position")


@query("list_entities_jobs", """
select tenant_id, id, row_number() over (partition by tenant_id order by created_at desc, id desc)
  as position from job
""")
def list_jobs(spark, sf):
    return E.rank_entities(S.bare_jobs(spark, sf)).select("tenant_id", "id", "position")


@query("list_entities_of_tenant", "select id, title, status from job where tenant_id = 2")
def list_of_tenant(spark, sf):
    return E.list_entities(S.bare_jobs(spark, sf), 2).select("id", "title", "status")


@query("get_entity", f"""
, req as ({GET_REQUESTS})
select req.id, req.tenant_id, cust.name, cust.id is not null as found
from req left join cust on cust.id = req.id and cust.tenant_id = req.tenant_id
""")
def get_entity(spark, sf):
    requests = S._flat(spark, sf, "customer", GET_REQUESTS.replace("from customer", "\nfrom customer"))
    return E.get_entities(S.bare_customers(spark, sf), requests).select(
        "id", "tenant_id", "name", "found"
    )


@query("decode_entity", """
select id, doc_name as name, doc_stage as stage, email, email2, phone, address, sector,
  link_ref as ref from cust
""")
def decode_entity(spark, sf):
    return E.decode_entity(S.customers(spark, sf), LINK.customer_doc(), keep=("id",)).select(
        "id", "name", "stage", "email", "email2", "phone", "address", "sector",
        F.col(LINK.ref).alias("ref"),
    )


@query("decode_entity_jobs", """
select id, title, quote_value, survey_date, survey_fitter, survey_notify, survey_sent, install_date,
  cast(least(n_fitters, 2) as int) as n_fitters, install_start, week_mark, day_mark, n_bookings
from job
""")
def decode_jobs(spark, sf):
    doc = E.decode_entity(S.jobs(spark, sf), LINK.job_doc(), keep=("id",))
    return doc.select(
        "id", "title", F.col("quoteValue").alias("quote_value"),
        F.col("tabs.survey.date").alias("survey_date"),
        F.col("tabs.survey.fitter").alias("survey_fitter"),
        F.col("tabs.survey.notifyEnabled").alias("survey_notify"),
        F.col("tabs.survey.emailSent.status").alias("survey_sent"),
        F.col("tabs.installation.date").alias("install_date"),
        F.size("tabs.installation.fitters").alias("n_fitters"),
        F.col("tabs.installation.startTime").alias("install_start"),
        F.col("tabs.installation.emailReminders.week.status").alias("week_mark"),
        F.col("tabs.installation.emailReminders.day.status").alias("day_mark"),
        F.size("tabs.serviceCall.bookings").alias("n_bookings"),
    )


@query("overlay_columns", """
select id, name, stage, email, epoch_us(created_at) as created_us from cust
""")
def overlay_columns(spark, sf):
    return E.decode_entity(
        S.customers(spark, sf), LINK.customer_doc(), columns=E.CUSTOMER_COLUMNS
    ).select("id", "name", "stage", "email", F.unix_micros("createdAt").alias("created_us"))


@query("overlay_columns_jobs", """
select id, customer_id, title, status, installation_value, epoch_us(created_at) as created_us
from job
""")
def overlay_jobs(spark, sf):
    return E.decode_entity(S.jobs(spark, sf), LINK.job_doc(), columns=E.JOB_COLUMNS).select(
        "id", F.col("customerId").alias("customer_id"), "title", "status",
        F.col("installationValue").alias("installation_value"),
        F.unix_micros("createdAt").alias("created_us"),
    )


@query("get_singleton", """
select t.tenant_id, s.tenant_id is not null as has_settings, s.company_name
from (select distinct tenant_id from cust) t left join sett s on s.tenant_id = t.tenant_id
""")
def get_singleton(spark, sf):
    tenants = S.bare_customers(spark, sf).select("tenant_id").distinct()
    doc = F.from_json("doc", SETTINGS_DOC)
    return E.get_singleton(tenants, S.settings(spark, sf), None).select(
        "tenant_id", F.col("doc").isNotNull().alias("has_settings"),
        doc["companyName"].alias("company_name"),
    )


@query("get_singleton_list", """
select c.id as tenant_id, count(m.id) as entries from cust c left join morder m
  on m.tenant_id = c.id group by c.id
""")
def get_singleton_list(spark, sf):
    tenants = S.bare_customers(spark, sf).select(F.col("id").alias("tenant_id"))
    return E.get_singleton(tenants, S.manual_orders(spark, sf), "[]").select(
        "tenant_id", F.size(F.from_json("doc", MANUAL_ORDERS_DOC)).cast("long").alias("entries")
    )


@query("explode_blob_array", """
select tenant_id, cast(pos as int) as pos, id, supplier, date, reference from morder
""")
def explode_blob_array(spark, sf):
    return E.explode_blob_array(S.manual_orders(spark, sf), MANUAL_ORDERS_DOC).drop("updated_at")


@query("explode_blob_array_outer", """
select s.s_suppkey as tenant_id, cast(m.pos as int) as pos, m.id, m.date
from supplier s left join morder m on m.tenant_id = s.s_suppkey
""")
def explode_blob_array_outer(spark, sf):
    return E.explode_blob_array(S.manual_orders(spark, sf), MANUAL_ORDERS_DOC, outer=True).select(
        "tenant_id", "pos", "id", "date"
    )


@query("scan_jobs_pruned", "select id, quote_value from job")
def scan_jobs_pruned(spark, sf):
    return E.scan_jobs_pruned(S.jobs(spark, sf)).select(
        "id", F.get_json_object("data_json", "$.quoteValue").alias("quote_value")
    )


@query("bad_json_quarantine", """
select seq, case body when 'text' then 'not json' else 'json null' end as reason,
  case body when 'text' then concat('ERR ', seq) else 'null' end as excerpt
from ev where body in ('text', 'null')
""")
def bad_json_quarantine(spark, sf):
    return E.split_json(S.deliveries(spark, sf), "raw_text")[1].select("seq", "reason", "excerpt")


@query("bad_json_quarantine_good", "select seq from ev where body not in ('text', 'null')")
def bad_json_good(spark, sf):
    return E.split_json(S.deliveries(spark, sf), "raw_text")[0].select("seq")


@query("lenient_payload_parse", """
select seq, body <> 'text' as is_json, case body when 'text' then content_type end as wrapped_type,
  case body when 'text' then concat('ERR ', seq) end as wrapped_text from ev
""")
def lenient_payload_parse(spark, sf):
    payload = parsed(F.col("payload"))
    return D.lenient_payload_parse(S.deliveries(spark, sf)).select(
        "seq", "is_json",
        F.try_variant_get(payload, "$.contentType", "string").alias("wrapped_type"),
        F.try_variant_get(payload, "$.rawText", "string").alias("wrapped_text"),
    )


@query("project_payload_gate", "select seq from ev where body in ('project', 'numeric')")
def project_payload_gate(spark, sf):
    return D.project_payload_gate(D.capture_raw_event(S.deliveries(spark, sf))).select("seq")


@query("capture_raw_event", """
select seq, tenant_id, epoch_us(received_at) as received_us, body <> 'text' as is_json from ev
""")
def capture_raw_event(spark, sf):
    return D.capture_raw_event(S.deliveries(spark, sf)).select(
        "seq", "tenant_id", F.unix_micros("received_at").alias("received_us"), "is_json"
    )


RECENT = """
select tenant_id, seq, position from (
  select tenant_id, seq, cast(row_number() over (
    partition by tenant_id order by received_at desc, seq desc) as int) as position from ev)
where position <= {}
"""


@query("recent_events", RECENT.format(50))
def recent_events(spark, sf):
    return D.recent_events(D.capture_raw_event(S.deliveries(spark, sf))).select(
        "tenant_id", "seq", "position"
    )


@query("topk_recent", RECENT.format(10))
def topk_recent(spark, sf):
    return D.recent_events(D.capture_raw_event(S.deliveries(spark, sf)), keep=10).select(
        "tenant_id", "seq", "position"
    )


@query("attachment_manifest", """
select page_id, case when page_id % 3 = 0 then 'photos' else 'documents' end as container,
  concat(1700000000000 + page_id * 1000, '-', case when page_id % 10 = 0 then 'file'
    else regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') end) as blob_name,
  case when page_id % 4 = 0 then 'application/octet-stream' else 'text/html' end as content_type,
  cast(strlen(html) as bigint) as size
from pages
""")
def attachment_manifest(spark, sf):
    return attachments.attachment_manifest(S.uploads(spark, sf), keep=("page_id",))
