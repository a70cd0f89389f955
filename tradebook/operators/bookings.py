"""Newly made bookings: a job document before a save against the one after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import default_on_flag, is_booked, is_install_booked, is_truthy
from ..functions.text import join_names
from ..schemas import BOOKED_TABS
from .joins import document_join
from .once import once
from .reminders import INSTALL_BOOKED, SERVICE_BOOKED, SURVEY_BOOKED, first_booking, same_id

BOOKED_KINDS = (SURVEY_BOOKED, INSTALL_BOOKED, SERVICE_BOOKED)


def last_booking(bookings: Column, booking_id: Column) -> Column:
    """The last booking of that id; the state before a save is read this way."""
    return F.try_element_at(F.filter(bookings, lambda b: same_id(b["id"], booking_id)), F.lit(-1))


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both versions of each saved job; a job without an earlier version is no save."""
    earlier = before.select("id", F.col("data_json").alias("_was"))
    saved = after.select("id", "customer_id", F.col("data_json").alias("_now"))
    return parsed_pairs(document_join(saved, earlier, "id"), "_now", "_was")


def parsed_pairs(saves: DataFrame, now: str, was: str) -> DataFrame:
    """`(id, customer_id, was, now)` of saves with both documents as text, parsed after any join."""
    return once(saves, {"was": booked_tabs(was), "now": booked_tabs(now)}, ["id", "customer_id"])


def booked_tabs(data_json: str) -> Column:
    """The tabs that hold bookings, with the sent marks as they are."""
    return F.from_json(data_json, f"tabs {BOOKED_TABS}")["tabs"]


def booking_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per service booking after the save with its earlier date and fitter."""
    pairs = _pairs(before, after).select(
        F.col("id").alias("job_id"),
        F.col("was.serviceCall.bookings").alias("_was"),
        F.posexplode("now.serviceCall.bookings").alias("pos", "_b"),
    )
    earlier = last_booking(F.col("_was"), F.col("_b.id"))
    return pairs.withColumn("_e", earlier).select(
        "job_id", F.col("_b.id").alias("booking_id"), "pos",
        F.col("_b.date").alias("date"), F.col("_b.fitter").alias("fitter"),
        F.col("_e").isNotNull().alias("existed"),
        F.col("_e.date").alias("date_before"), F.col("_e.fitter").alias("fitter_before"),
    )


def _message(kind: str, booking_id: Column, date: Column, fitters: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), booking_id.alias("booking_id"), date.alias("message_date"),
        fitters.alias("message_fitters"),
    )


def booking_transitions(
    before: DataFrame, after: DataFrame, kinds: tuple[str, ...] = BOOKED_KINDS
) -> DataFrame:
    """Messages that saves give rise to, from the jobs before and after."""
    return new_bookings(_pairs(before, after), kinds)


def new_bookings(pairs: DataFrame, kinds: tuple[str, ...] = BOOKED_KINDS) -> DataFrame:
    """Messages that each save `(id, customer_id, was, now)` gives rise to, for `build_outbox`.

    A survey or installation counts when it is fully booked now and was not before; a service
    booking is compared with the earlier booking of the same id, if there was one. Any
    mark on the new document but null, false, 0 or an empty text blocks the message.
    """
    now, was = F.col("now"), F.col("was")
    no_id = F.lit(None).cast("string")
    parts: list[Column] = []

    if SURVEY_BOOKED in kinds:
        s, p = now["survey"], was["survey"]
        fresh = (
            ~is_booked(p["date"], p["fitter"]) & is_booked(s["date"], s["fitter"])
            & default_on_flag(s["notifyEnabled"]) & ~is_truthy(s["emailSent"])
        )
        parts.append(F.array(F.when(fresh, _message(SURVEY_BOOKED, no_id, s["date"], s["fitter"]))))
    if INSTALL_BOOKED in kinds:
        s, p = now["installation"], was["installation"]
        fresh = (
            ~is_install_booked(p["date"], p["fitters"]) & is_install_booked(s["date"], s["fitters"])
            & default_on_flag(s["notifyEnabled"]) & ~is_truthy(s["bookedEmailSent"])
        )
        parts.append(F.array(F.when(
            fresh, _message(INSTALL_BOOKED, no_id, s["date"], join_names(s["fitters"]))
        )))
    if SERVICE_BOOKED in kinds:
        s, p = now["serviceCall"], was["serviceCall"]

        def is_fresh(b: Column) -> Column:
            earlier = last_booking(p["bookings"], b["id"])
            return (
                default_on_flag(s["notifyEnabled"]) & is_booked(b["date"], b["fitter"])
                & ~is_truthy(b["emailSent"]) & ~is_booked(earlier["date"], earlier["fitter"])
            )

        def message(b: Column) -> Column:
            about = first_booking(s["bookings"], b["id"])
            return _message(SERVICE_BOOKED, b["id"], about["date"], about["fitter"])

        parts.append(F.coalesce(
            F.transform(F.filter(s["bookings"], is_fresh), message), F.array()
        ))

    found = parts[0] if len(parts) == 1 else F.concat(*parts)
    return pairs.select(
        F.col("id").alias("job_id"), "customer_id", F.explode(F.array_compact(found)).alias("_m")
    ).select(
        "job_id", "_m.booking_id", "_m.kind", "customer_id", "_m.message_date", "_m.message_fitters"
    )
