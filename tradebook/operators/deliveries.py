"""Webhook deliveries: lenient parsing, raw capture, the project gate and field extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.documents import (
    first_of, kind_of, parsed, positive_price_text, present_text, text_or_blank, truthy_non_text,
)
from ..functions.text import join_nonempty, parse_fee, tenant_key, text_excerpt, trimmed
from .once import once

# Property names of the project payload.
REFERENCE, NAME, EMAIL, PHONE = "Reference", "Name", "Email", "Phone"
ADDRESS, POSTCODE, FEE = "Address", "Postcode", "Installation Fee"
RETAINED = 50

PROJECT_FIELDS = (
    "reference", "name", "email", "phone", "address", "quote_value", "installation_value",
    "ext_status", "modified",
)


def lenient_payload_parse(deliveries: DataFrame) -> DataFrame:
    """Add `payload` (JSON text): the body itself if it is JSON whatever its declared type, else
    a wrapper with the beginning of the text."""
    wrapper = F.to_json(F.struct(
        F.lit(True).alias("_nonJsonBody"),
        F.coalesce("content_type", F.lit("")).alias("contentType"),
        text_excerpt(F.coalesce("raw_text", F.lit(""))).alias("rawText"),
    ))
    return once(deliveries, {"is_json": parsed(F.col("raw_text")).isNotNull()}).withColumn(
        "payload", F.when(F.col("is_json"), F.col("raw_text")).otherwise(wrapper)
    )


def capture_raw_event(deliveries: DataFrame) -> DataFrame:
    """Rows of the append-only capture table; every delivery is kept, readable or not.

    A body that is no JSON is kept whole in `raw_text`, its beginning also in the payload.
    """
    return lenient_payload_parse(deliveries).select(
        "seq", "tenant_id", "received_at", "content_type", "is_json", "payload",
        F.when(~F.col("is_json"), F.col("raw_text")).alias("raw_text"),
    )


def recent_events(captured: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The newest captures of each tenant.

    The rank is tested right above the window, so each task keeps its own top rows before the
    shuffle and a tenant holding most of the rows costs no more than the others.
    """
    newest = W.partitionBy("tenant_id").orderBy(F.col("received_at").desc(), F.col("seq").desc())
    return captured.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= keep
    )


def _properties(payload: Column) -> Column:
    """The property list, read in one go; what is no object in it has neither name nor value."""
    return F.try_variant_get(payload, "$.json.infoProperties", "array<struct<name: string, value: variant>>")


def project_payload_gate(captured: DataFrame) -> DataFrame:
    """Captures that carry a project: its property list is an array, be it empty."""
    items = _properties(parsed(F.col("payload")))
    return captured.filter("is_json").filter(items.isNotNull())


def extract_project_fields(captured: DataFrame, keep: tuple = ("seq", "received_at")) -> DataFrame:
    """The nine project fields of every gated capture.

    `error` names a value that is no text where a text is needed; such an event stays captured
    and is not applied.
    """
    kept = list(keep)
    document = once(captured.filter("is_json"), {"_v": parsed(F.col("payload"))}, kept)
    gated = once(document, {"_items": _properties(F.col("_v"))}).filter(
        F.col("_items").isNotNull()
    )
    # Last pair first, so that the first position of a name is the one that counts.
    latest_first = F.reverse("_items")
    listed = once(gated, {"_names": latest_first["name"], "_values": latest_first["value"]}, [*kept, "_v"])

    def member(name: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.json.{name}", "variant")

    texts = {"_ref": REFERENCE, "_name": NAME, "_email": EMAIL, "_phone": PHONE, "_fee": FEE}
    others = {"_address": ADDRESS, "_postcode": POSTCODE}
    values = once(listed, {
        **{c: first_of(F.col("_names"), F.col("_values"), name)
           for c, name in {**texts, **others}.items()},
        "_price": member("price"), "_status": member("statusName"),
        "_modified": member("modifiedDate"),
    }, kept)

    def text(column: str) -> Column:
        return trimmed(text_or_blank(F.col(column)))

    error = F.concat_ws(", ", *[
        F.when(truthy_non_text(F.col(c)), F.concat(F.lit(n), F.lit(" is a "), kind_of(F.col(c))))
        for c, n in {**texts, "_status": "statusName"}.items()
    ])
    return once(values, {
        "reference": text("_ref"), "name": text("_name"), "email": text("_email"),
        "phone": text("_phone"),
        "address": join_nonempty(
            ", ", present_text(F.col("_address")), present_text(F.col("_postcode"))),
        "quote_value": positive_price_text(F.col("_price")),
        "installation_value": parse_fee(text_or_blank(F.col("_fee"))),
        "ext_status": text("_status"),
        "modified": F.coalesce(present_text(F.col("_modified")), F.lit("")),
        "error": F.nullif(error, F.lit("")),
    }, kept)


def project_events(captured: DataFrame) -> DataFrame:
    """Extracted events that can be applied, with the keys they are matched by within a tenant."""
    fields = extract_project_fields(captured, keep=("seq", "tenant_id", "received_at"))
    return fields.filter(F.col("error").isNull()).drop("error").select("*", *[
        tenant_key(F.col("tenant_id"), F.col(field)).alias(key)
        for key, field in (("ref_key", "reference"), ("email_key", "email"), ("phone_key", "phone"))
    ])
