"""Messages: templates, recipients, rendering, and what became of them after sending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import long_date
from ..functions.text import bcc_of_template, fill_template, first_nonempty, recipient_list
from ..schemas import SETTINGS_DOC
from ..sources.tables import stored
from . import reminders as R
from .joins import document_join
from .once import once

# Kinds in the order they are listed, their group, the key of the template in the
# settings document, and the names the template uses for the date and for who comes.
CATALOG = (
    (R.SURVEY_BOOKED, "Survey", "surveyBooked", "surveyDate", "fitterName"),
    (R.SURVEY_DAY, "Survey", "surveyReminderDay", "surveyDate", "fitterName"),
    (R.INSTALL_BOOKED, "Installation", "installBooked", "installDate", "fitterNames"),
    (R.INSTALL_WEEK, "Installation", "installReminderWeek", "installDate", "fitterNames"),
    (R.INSTALL_DAY, "Installation", "installReminderDay", "installDate", "fitterNames"),
    (R.SERVICE_BOOKED, "Service call", "serviceCallBooked", "serviceCallDate", "fitterName"),
    (R.SERVICE_DAY, "Service call", "serviceCallReminderDay", "serviceCallDate", "fitterName"),
)

_SUBJECTS = {
    R.SURVEY_BOOKED: "Survey date confirmed for {{customerName}}",
    R.SURVEY_DAY: "Survey tomorrow for {{customerName}}",
    R.INSTALL_BOOKED: "Installation date confirmed for {{customerName}}",
    R.INSTALL_WEEK: "Installation within a week for {{customerName}}",
    R.INSTALL_DAY: "Installation tomorrow for {{customerName}}",
    R.SERVICE_BOOKED: "Service visit confirmed for {{customerName}}",
    R.SERVICE_DAY: "Service visit tomorrow for {{customerName}}",
}
_BODY = (
    "Hello {{customerName}},\n\nWhen: {{%s}}\nWho: {{%s}}\nWhere: {{address}}\n\n"
    "{{companyName}}\n{{companyPhone}}"
)
DEFAULT_COMPANY = "Our company"


def default_templates(spark: SparkSession) -> DataFrame:
    """One row per kind (seven, a fixed number, so it may be broadcast)."""
    rows = [
        (n, kind, group, key, _SUBJECTS[kind], _BODY % (date, who))
        for n, (kind, group, key, date, who) in enumerate(CATALOG, start=1)
    ]
    return spark.createDataFrame(
        rows, "ordinal int, kind string, booking_type string, template_key string, "
              "default_subject string, default_body string",
    )


def job_customer_join(jobs: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with the document of their customer, and the jobs whose customer is missing."""
    people = customers.select(
        F.col("id").alias("customer_id"), F.col("data_json").alias("customer_json")
    )
    return jobs.join(people, "customer_id"), jobs.join(people, "customer_id", "left_anti")


def settings_join(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Add the tenant's settings document (null fields where there is none).

    There is one settings row per tenant; how it is joined is left to the run-time size check.
    """
    doc = settings.select(
        "tenant_id", F.from_json("data_json", SETTINGS_DOC).alias("settings")
    )
    return df.join(doc, "tenant_id", "left")


def template_lookup(df: DataFrame, templates: DataFrame) -> DataFrame:
    """Add subject, body and bcc by kind: the tenant's own template, else the whole default one."""
    own = F.try_element_at(F.col("settings.emailTemplates"), F.col("template_key"))
    return df.join(F.broadcast(templates), "kind").select(
        *df.columns,
        F.when(own.isNotNull(), own["subject"]).otherwise(F.col("default_subject")).alias("subject"),
        F.when(own.isNotNull(), own["body"]).otherwise(F.col("default_body")).alias("body"),
        own["bcc"].alias("bcc"),
    )


def _values(date: Column, who: Column, default_company: str) -> dict[str, Column]:
    values = {"customerName": F.col("_c.name"), "address": F.col("_c.address")}
    kind = F.col("kind")
    for name, column in (("installDate", date), ("surveyDate", date), ("serviceCallDate", date),
                         ("fitterNames", who), ("fitterName", who)):
        fitting = [k for k, _, _, date_name, who_name in CATALOG if name in (date_name, who_name)]
        # A name the kind does not know stays in the text: it is replaced by itself.
        values[name] = F.when(kind.isin(fitting), F.coalesce(column, F.lit(""))).otherwise(
            F.lit("{{" + name + "}}")
        )
    values["companyName"] = first_nonempty(F.col("settings.companyName"), F.lit(default_company))
    values["companyPhone"] = F.col("settings.companyPhone")
    return values


def _with_customers(
    due: DataFrame, customers: DataFrame, tenant_id: int | None, test_email: str | None,
) -> DataFrame:
    """Due rows with customer, recipients and the reason why no message is possible."""
    if "reason" not in due.columns:
        due = due.withColumn("reason", F.lit(None).cast("string"))
    people = customers.select(
        F.col("id").alias("customer_id"),
        F.lit(True).alias("_found"),
        (F.col("tenant_id") if tenant_id is None else F.lit(tenant_id).cast("long"))
        .alias("tenant_id"),
        F.col("data_json").alias("_json"),
    )
    to = recipient_list(F.col("_c.email"), F.col("_c.email2"), test_email)
    # Parsed after the join, so that only customers asked for are.
    found = document_join(due, people, "customer_id", "left")
    document = F.from_json("_json", "name string, email string, email2 string, address string")
    joined = once(found, {"_c": document}, [c for c in found.columns if c != "_json"]).withColumn("to", to)
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("_found").isNull(), "customer not found")
        .when(F.size("to") == 0, "no recipient")
    )
    return joined.withColumn("reason", reason)


def build_outbox(
    due: DataFrame,
    customers: DataFrame,
    settings: DataFrame,
    templates: DataFrame,
    tenant_id: int | None = None,
    test_email: str | None = None,
    default_company: str = DEFAULT_COMPANY,
) -> tuple[DataFrame, DataFrame]:
    """Messages to send, and the requests that cannot be sent with the first reason.

    `due` comes from `due_reminders` or `attach_jobs`. With `tenant_id` that tenant's settings
    serve all messages, without it each message takes those of the customer's tenant. A test
    address replaces the recipients.
    """
    joined = template_lookup(
        settings_join(
            _with_customers(due, customers, tenant_id, test_email), settings
        ), templates,
    ).withColumn("reason", F.coalesce("reason", F.when(
        F.col("subject").isNull() | F.col("body").isNull(), "template incomplete"
    )))
    values = _values(long_date(F.col("message_date")), F.col("message_fitters"), default_company)
    outbox = joined.filter(F.col("reason").isNull()).select(
        "job_id", "booking_id", "kind", "to", bcc_of_template(F.col("bcc")).alias("bcc"),
        fill_template(F.col("subject"), values).alias("subject"),
        fill_template(F.col("body"), values).alias("body"),
        F.lit(test_email is not None).alias("is_test"),
    )
    rejects = joined.filter(F.col("reason").isNotNull()).select(
        "job_id", "booking_id", "kind", "reason"
    )
    return outbox, rejects


def _message_key() -> list[Column]:
    return [F.col("job_id"), F.coalesce("booking_id", F.lit("")).alias("_booking"), F.col("kind")]


def reconcile_send_results(
    outbox: DataFrame, results: DataFrame, position: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Messages that count as sent, and those that stay due with what went wrong.

    Only the status `Succeeded` counts; test messages are never marked. Of several failures the
    latest by the `position` column is shown, without one the greatest (status, error).
    """
    key = ["job_id", "_booking", "kind"]
    at = F.lit(0) if position is None else F.col(position)
    succeeded = F.coalesce(F.col("status") == "Succeeded", F.lit(False))
    result = F.struct(succeeded.alias("ok"), at.alias("at"), "status", "error")
    # The messages are asked for twice and few against the jobs they were made from, so they are written once.
    live = stored(outbox.filter(~F.col("is_test")).select(*_message_key(), "booking_id").distinct(), "messages")
    # Only the results of these messages are compared: a maximum of texts sorts what it gets.
    asked = results.select(*_message_key(), result.alias("_r")).join(live.select(*key), key, "left_semi")
    best = asked.groupBy(*key).agg(F.max("_r").alias("_r")).select(
        *key, F.col("_r.ok").alias("_ok"), "_r.status", "_r.error")
    matched = live.join(best, key, "left")
    ok = F.coalesce("_ok", F.lit(False))
    sent = matched.filter(ok).select("job_id", "booking_id", "kind")
    failed = matched.filter(~ok).select(
        "job_id", "booking_id", "kind", F.coalesce("status", F.lit("no result")).alias("status"),
        "error",
    )
    return sent, failed


def template_catalog(spark: SparkSession, settings: DataFrame) -> DataFrame:
    """Every tenant's templates in their fixed order, grouped by booking type."""
    templates = default_templates(spark)
    listed = settings.select(
        "tenant_id", F.from_json("data_json", SETTINGS_DOC).alias("settings"),
        F.explode(F.array(*[F.lit(kind) for kind, *_ in CATALOG])).alias("kind"),
    )
    own = F.try_element_at(F.col("settings.emailTemplates"), F.col("template_key"))
    return listed.join(F.broadcast(templates), "kind").select(
        "tenant_id", "ordinal", "booking_type", "template_key",
        own.isNotNull().alias("is_custom"),
        F.when(own.isNotNull(), own["subject"]).otherwise(F.col("default_subject")).alias("subject"),
    )
