"""The given tables seen as CRM tables.

The flat columns are written once, as SQL both engines read; Spark packs them into JSON documents
row by row (nothing is collected across rows), and the check reads them as they are. The documents
are made by `once`, so that an operator sees them as it would see scanned columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.once import once
from ..schemas import LINK

# Run date on which every kind of reminder is due for some job at every scale.
RUN_DATE = "1999-06-24"
NOW = "2024-02-01 00:00:00"

# Pieces that rows are dealt into before documents are made of them.
TASKS_PER_CORE = 4

CUSTOMER_SQL = """
select c_custkey as id, cast(c_nationkey as bigint) as tenant_id, c_name as name,
  case when c_acctbal < 0 then 'New Enquiry' when c_acctbal < 2500 then 'Quoted'
       when c_acctbal < 6000 then 'Followed Up' else 'Deal Won' end as stage,
  lower(c_name) as doc_name, 'Imported' as doc_stage,
  case when c_mktsegment = 'BUILDING' then ''
       else concat('U', cast(floor(c_custkey / 2) as bigint), '@Mail.test') end as email,
  case when c_acctbal > 5000 then concat('office', c_custkey, '@mail.test') else '' end as email2,
  concat('07', lpad(cast(cast(floor(c_custkey / 3) as bigint) as string), 9, '0')) as phone,
  concat(c_custkey, ' Test Road') as address,
  case c_mktsegment when 'HOUSEHOLD' then 'Retail' when 'BUILDING' then 'Trade'
       when 'FURNITURE' then 'Trade' when 'MACHINERY' then 'Commercial' else '' end as sector,
  case when c_mktsegment = 'MACHINERY' then concat('R-', c_custkey) else '' end as link_ref,
  case when c_mktsegment = 'MACHINERY' and c_acctbal > 4000 then '001704600000' else ''
       end as link_modified,
  cast(cast('2020-01-01' as date) + cast(floor(c_custkey / 7) % 900 as int) as timestamp)
       as created_at
from customer
"""

JOB_SQL = """
select o_orderkey as id, cast(substr(o_orderpriority, 1, 1) as bigint) as tenant_id,
  case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then -1 - o_custkey
       else o_custkey end as customer_id,
  concat('Job ', o_orderkey) as title,
  case o_orderstatus when 'P' then 'Book Survey' when 'O' then 'Installation Booked'
       else 'Job Completed' end as status,
  case when o_orderpriority = '1-URGENT' then concat('R-', o_orderkey) else '' end as link_ref,
  case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then '001704600000' else ''
       end as link_modified,
  cast(cast(o_totalprice as decimal(18,2)) as string) as quote_value,
  case when o_orderstatus = 'F' then ''
       else cast(cast(floor(o_totalprice / 10) as bigint) as string) end as installation_value,
  case when o_totalprice < 5000 then 'not a date'
       else cast(cast(o_orderdate as date) as string) end as survey_date,
  case when o_orderpriority = '4-NOT SPECIFIED' then ''
       else concat('Fitter ', o_custkey % 40) end as survey_fitter,
  case when o_totalprice < 50000 then false when o_totalprice < 250000 then true end
       as survey_notify,
  case o_orderstatus when 'F' then 'sent' when 'O' then 'pending' end as survey_sent,
  case when o_orderkey % 5 = 0 then 'sent' end as survey_reminder,
  case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P' then ''
       else cast(cast(o_orderdate as date) + cast(30 + o_orderkey % 60 as int) as string) end
       as install_date,
  cast(o_custkey % 3 as int) as n_fitters,
  concat('Fitter ', o_custkey % 40) as fitter_a, concat('Fitter ', (o_custkey + 1) % 40) as fitter_b,
  case when o_orderkey % 2 = 0 then concat(lpad(cast(7 + o_orderkey % 13 as string), 2, '0'), ':30')
       else '' end as install_start,
  case when o_totalprice > 400000 then false end as install_notify,
  case when o_orderstatus = 'F' then 'sent' end as install_booked,
  case when o_orderkey % 4 = 0 then 'sent' else 'pending' end as week_mark,
  case when o_orderkey % 7 = 0 then 'sent' else 'pending' end as day_mark,
  case when o_totalprice > 450000 then false end as service_notify,
  cast(o_orderkey % 4 as int) as n_bookings,
  cast(o_custkey % 2 as int) as n_deliveries,
  concat('Supplier ', o_custkey % 10) as delivery_supplier,
  case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P' then ''
       else cast(cast(o_orderdate as date) + cast(27 + o_orderkey % 60 as int) as string) end
       as delivery_date,
  o_orderkey % 3 <> 0 as survey_was_set, o_orderkey % 3 <> 1 as install_was_set,
  cast(o_orderkey % 2 as int) as bookings_were_set,
  cast(o_orderdate as timestamp) as created_at, o_orderkey, o_custkey, o_orderdate
from orders
"""

# Bookings of a job, i = 0 .. n_bookings - 1; the third may repeat the first one's id.
BOOKING_COLUMNS = {
    "booking_id": "concat('b', case when i = 2 and o_orderkey % 3 = 0 then 0 else i end)",
    "date": "case when i = 1 and o_orderkey % 5 = 1 then '' "
            "else cast(cast(o_orderdate as date) + cast(60 + 7 * i as int) as string) end",
    "fitter": "case when (o_orderkey + i) % 6 = 0 then '' "
              "else concat('Fitter ', (o_custkey + i) % 40) end",
    "booked_mark": "case when (o_orderkey + i) % 4 = 0 then 'sent' end",
    "reminder_mark": "case when (o_orderkey + i) % 9 = 0 then 'sent' end",
}

EVENT_SQL = """
select event_id as seq, cast(ts as timestamp) as received_at,
  case when event_type = 'view' then 'text/plain' else 'application/json' end as content_type,
  case when event_type = 'error' and value > 60 then 'text'
       when event_type = 'error' and value > 50 then 'null'
       when event_type = 'signup' and value > 40 and value < 60 then 'other'
       when event_type = 'click' and value > 100 then 'numeric'
       else 'project' end as body,
  case when event_type = 'error' and value < 5 then '  '
       when event_type = 'click' then concat(' r-', {k} * 10 + user_id % 10, ' ')
       else concat('R-', {k} * 10 + user_id % 10) end as raw_reference,
  concat('  Person ', user_id) as raw_name,
  case when event_type = 'view' then '' else concat('u', user_id * 7, '@mail.test ') end
       as raw_email,
  case when event_type = 'signup' then ''
       else concat('07', lpad(cast(user_id * 5 as string), 9, '0')) end as raw_phone,
  concat(user_id, ' New Road') as raw_address,
  case when event_type = 'click' then '' else concat('ZZ', {k}) end as raw_postcode,
  case when event_type = 'purchase' then concat('Fee £ 1,', lpad(cast({k} as string), 3, '0'), '.50')
       else 'to be agreed' end as raw_fee,
  case when value < 10 then 0.0 else value end as price,
  event_type = 'view' as price_quoted,
  event_type as raw_status,
  case when event_type = 'error' then ''
       else lpad(cast({epoch} - cast(floor(value * 3600) as bigint) as string), 12, '0') end
       as raw_modified,
  user_id, ({k} + user_id) % 5 as tenant_id
from events
"""
SPARK_TERMS = {
    "k": "cast(get_json_object(props, '$.k') as bigint)", "epoch": "unix_seconds(cast(ts as timestamp))",
}
CHECK_TERMS = {
    "k": "cast(json_extract_string(props, '$.k') as bigint)",
    "epoch": "cast(floor(epoch(ts)) as bigint)",
}

# The first two tenants of the jobs have no settings row.
SETTINGS_SQL = """
select cast(n_nationkey + 3 as bigint) as tenant_id,
  case when n_regionkey = 1 then '' else concat('Works ', n_name) end as company_name,
  concat('0800 ', n_nationkey) as company_phone,
  n_regionkey in (0, 2) as has_day_template,
  n_name
from nation
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it is; a small file is read by one task up to the first shuffle."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly to all cores: a file's row groups are fewer, and documents are costly to make."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def _flat(spark: SparkSession, sf_dir: str, name: str, sql: str, even: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, name)
    return spark.sql(sql.replace(f"from {name}\n", "from {src}\n"), src=spread(rows) if even else rows)


def flat_customers(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    return _flat(spark, sf_dir, "customer", CUSTOMER_SQL, even)


def flat_jobs(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    return _flat(spark, sf_dir, "orders", JOB_SQL, even)


def bare_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without their documents, for what reads the table columns only."""
    return flat_customers(spark, sf_dir).select("id", "tenant_id", "name", "stage", "created_at")


def bare_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_jobs(spark, sf_dir).select(
        "id", "tenant_id", "customer_id", "title", "status", "created_at"
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(
        F.col("doc_name").alias("name"), F.col("doc_stage").alias("stage"), "email", "email2",
        "phone", "address", "sector", F.col("link_ref").alias(LINK.ref),
        F.col("link_modified").alias(LINK.modified), F.lit("kept").alias("unmodelled"),
    )
    return once(flat_customers(spark, sf_dir, True), {"data_json": F.to_json(doc)}).select(
        "id", "tenant_id", "name", "stage", "data_json", "created_at",
        F.col("created_at").alias("updated_at"),
    )


def _mark(status: Column) -> Column:
    return F.when(status.isNotNull(), F.struct(status.alias("status"), F.lit("").alias("sentAt")))


def _bookings(count: str, keep: str = "true") -> Column:
    c = BOOKING_COLUMNS
    mark = "case when {0} is not null then named_struct('status', {0}, 'sentAt', '') end"
    return F.expr(
        f"transform(case when {count} > 0 then sequence(0, {count} - 1) else "
        f"array() end, i -> named_struct('id', {c['booking_id']}, "
        f"'date', case when {keep} then {c['date']} else '' end, 'fitter', {c['fitter']}, "
        f"'emailSent', {mark.format(c['booked_mark'])}, "
        f"'reminderSent', {mark.format(c['reminder_mark'])}))"
    )


def _job_tabs(before: bool) -> Column:
    col = F.col

    def was(flag: str, text: Column) -> Column:
        return F.when(col(flag), text).otherwise(F.lit("")) if before else text

    fitters = F.slice(F.array("fitter_a", "fitter_b"), F.lit(1), col("n_fitters"))
    if before:
        fitters = F.when(col("install_was_set"), fitters).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.struct(
            col("survey_date").alias("date"),
            was("survey_was_set", col("survey_fitter")).alias("fitter"),
            col("survey_notify").alias("notifyEnabled"),
            _mark(col("survey_sent")).alias("emailSent"),
            _mark(col("survey_reminder")).alias("reminderSent"),
        ).alias("survey"),
        F.struct(
            col("install_date").alias("date"),
            fitters.alias("fitters"),
            col("install_start").alias("startTime"),
            col("install_notify").alias("notifyEnabled"),
            _mark(col("install_booked")).alias("bookedEmailSent"),
            F.struct(
                _mark(col("week_mark")).alias("week"), _mark(col("day_mark")).alias("day")
            ).alias("emailReminders"),
            F.expr(
                "case when n_deliveries > 0 then array(named_struct('id', 'd1', 'supplier', "
                "delivery_supplier, 'date', delivery_date)) else array() end"
            ).alias("deliveries"),
        ).alias("installation"),
        F.struct(
            col("service_notify").alias("notifyEnabled"),
            (_bookings("n_bookings", "i < bookings_were_set") if before
             else _bookings("n_bookings")).alias("bookings"),
        ).alias("serviceCall"),
    )


def jobs(spark: SparkSession, sf_dir: str, before: bool = False) -> DataFrame:
    """Jobs as they are now, or as they were before the last save."""
    doc = F.struct(
        "title", "status", F.col("quote_value").alias("quoteValue"),
        F.col("installation_value").alias("installationValue"),
        F.col("link_ref").alias(LINK.ref), F.col("link_modified").alias(LINK.modified),
        F.lit("kept").alias("unmodelled"), _job_tabs(before).alias("tabs"),
    )
    return once(flat_jobs(spark, sf_dir, True), {"data_json": F.to_json(doc)}).select(
        "id", "tenant_id", "customer_id", "title", "status", "data_json", "created_at",
        F.col("created_at").alias("updated_at"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw webhook deliveries: projects, other JSON, JSON null, plain text, mistyped values."""
    flat = _flat(spark, sf_dir, "events", EVENT_SQL.format(
        **SPARK_TERMS, src="{src}"
    ), True)

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    info = F.array(
        pair("Reference", F.lit("overruled by the last one")),
        pair("Reference", F.col("raw_reference")), pair("Name", F.col("raw_name")),
        pair("Email", F.col("raw_email")), pair("Phone", F.col("raw_phone")),
        pair("Address", F.col("raw_address")), pair("Postcode", F.col("raw_postcode")),
        pair("Installation Fee", F.col("raw_fee")),
    )

    def project(price: Column) -> Column:
        return F.to_json(F.struct(F.struct(
            info.alias("infoProperties"), price.alias("price"),
            F.col("raw_status").alias("statusName"), F.col("raw_modified").alias("modifiedDate"),
        ).alias("json")))

    raw = (
        F.when(F.col("body") == "text", F.concat(F.lit("ERR "), F.col("seq")))
        .when(F.col("body") == "null", "null")
        .when(F.col("body") == "other", F.concat(F.lit('{"ping":'), F.col("seq"), F.lit("}")))
        .when(F.col("body") == "numeric", F.concat(
            F.lit('{"json":{"infoProperties":[{"name":"Reference","value":'),
            F.col("user_id") + 1, F.lit("}]}}")))
        .when(F.col("price_quoted"), project(F.col("price").cast("string")))
        .otherwise(project(F.col("price")))
    )
    return once(flat, {"raw_text": raw}, ["seq", "tenant_id", "received_at", "content_type"])


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir, "nation", SETTINGS_SQL)
    template = F.struct(
        F.lit("Tomorrow: {{customerName}}").alias("subject"),
        F.lit("{{installDate}} with {{fitterNames}} at {{address}} from {{companyName}}, {{other}}")
        .alias("body"),
        F.lit(" copies@mail.test ").alias("bcc"),
    )
    doc = F.struct(
        F.col("company_name").alias("companyName"), F.col("company_phone").alias("companyPhone"),
        F.when(F.col("has_day_template"), F.create_map(F.lit("installReminderDay"), template))
        .alias("emailTemplates"),
        F.create_map(F.lit("Ann"), F.col("n_name"), F.lit("Bob"), F.lit("")).alias("fitterPasswords"),
    )
    return flat.select("tenant_id", F.to_json(doc).alias("data_json"),
                       F.lit(NOW).cast("timestamp").alias("updated_at"))


def manual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array document per tenant; every supplier stands for a tenant."""
    entry = (
        "named_struct('id', concat('m', i), 'supplier', s_name, 'date', "
        "cast(date'1999-06-15' + cast((s_suppkey + 5 * i) % 30 as int) as string), "
        "'reference', concat('PO-', s_suppkey, '-', i))"
    )
    count = "cast(s_suppkey % 4 as int)"
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("tenant_id"),
        F.to_json(F.expr(
            f"transform(case when {count} > 0 then sequence(0, {count} - 1) else array() end, "
            f"i -> {entry})"
        )).alias("data_json"),
        F.lit(NOW).cast("timestamp").alias("updated_at"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as uploaded files."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr("case page_id % 3 when 0 then 'photos' when 1 then 'documents' else 'other' end")
        .alias("container"),
        F.expr("case when page_id % 10 = 0 then '' else url end").alias("filename"),
        F.expr("case when page_id % 4 = 0 then null else 'text/html' end").alias("content_type"),
        F.base64(F.encode("html", "UTF-8")).alias("data_base64"),
        F.expr("timestamp_seconds(1700000000 + page_id)").alias("received_at"),
    )


# ---- the same tables for the check -----------------------------------------------------------

def check_ctes() -> str:
    """WITH clause giving the flat tables by name: cust, job, booking, ev, sett, morder."""
    columns = ", ".join(f"{sql} as {name}" for name, sql in BOOKING_COLUMNS.items())
    return f"""with cust as ({CUSTOMER_SQL}), job as ({JOB_SQL}),
booking as (select id as job_id, cast(i as bigint) as pos, {columns}
  from (select *, unnest(range(n_bookings)) as i from job)),
ev as ({EVENT_SQL.format(**CHECK_TERMS)}), sett as ({SETTINGS_SQL}),
morder as (select s_suppkey as tenant_id, i as pos, concat('m', i) as id, s_name as supplier,
    cast(date '1999-06-15' + cast((s_suppkey + 5 * i) % 30 as int) as string) as date,
    concat('PO-', s_suppkey, '-', i) as reference
  from (select *, unnest(range(s_suppkey % 4)) as i from supplier))
"""
