"""Event times: parsing, spans and partition months. The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_millis(col: Column) -> Column:
    """Cut a timestamp to whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(col))


def parse_event_time(col: Column) -> Column:
    """Event time from text; NULL when unreadable.

    Read are ISO times and dates (also with slashes), 10 / 13 digits of epoch seconds / milliseconds, 14 digits
    ``yyyyMMddHHmmss``, and mail dates such as ``Tue, 05 Mar 2024 10:00:00 GMT``. A time of day without a date is unreadable: it
    would mean another day with every run.
    """
    text = F.trim(col)
    iso = F.when(text.rlike("^[0-9]{4}[-/][0-9]"), F.regexp_replace(text, "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", "$1-$2-$3").try_cast("timestamp"))
    compact = F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
    mail = F.regexp_replace(text, "^[A-Za-z]{3},\\s*", "")
    named = F.when(mail.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8} [A-Z]{2,4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")))
    offset = F.when(mail.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8} [+-][0-9]{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
    epoch = F.when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("bigint"))).when(
        text.rlike("^[0-9]{13}$"), F.timestamp_millis(text.try_cast("bigint"))
    )
    return to_millis(F.coalesce(iso, epoch, compact, named, offset))


def span_seconds(start: Column, end: Column) -> Column:
    """Second boundaries between two times, never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), F.unix_seconds(end) - F.unix_seconds(start))


def event_month(col: Column) -> Column:
    """Month as a number such as 202401, the partition key of stored tables."""
    return (F.year(col) * 100 + F.month(col)).cast("int")
