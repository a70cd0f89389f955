"""Calendar expressions over ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(text: Column) -> Column:
    return text.try_cast("date")


def days_until(text: Column, run_date: str) -> Column:
    """Whole days from the run date; null (never due) where the text is not a date."""
    return F.datediff(as_date(text), F.lit(run_date).cast("date"))


def long_date(text: Column) -> Column:
    """`Monday 3 August 2026`, or an empty text."""
    return F.coalesce(F.date_format(as_date(text), "EEEE d MMMM yyyy"), F.lit(""))


def short_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def week_start(text: Column) -> Column:
    return F.date_trunc("week", as_date(text)).cast("date")


def month_start(text: Column) -> Column:
    return F.date_trunc("month", as_date(text)).cast("date")


def is_working_day(text: Column) -> Column:
    return F.weekday(as_date(text)) < 5


def _clock(text: Column) -> Column:
    """The text where it begins with `HH:MM`, else null; `try_cast` of other texts to numbers is slow."""
    return F.when(text.rlike(r"^\d{1,2}:\d{2}"), text)


def start_hour(text: Column) -> Column:
    """Hour of an `HH:MM` text, null where there is none."""
    return F.substring_index(_clock(text), ":", 1).try_cast("int")


def day_minute(text: Column) -> Column:
    """Minute of the day of an `HH:MM` text, -1 where there is none."""
    minute = F.substr(text, F.locate(":", text) + 1, F.lit(2)).try_cast("int")
    hour = F.substring_index(text, ":", 1).try_cast("int")
    return F.when(_clock(text).isNotNull(), hour * 60 + minute).otherwise(F.lit(-1))
