"""Timestamp parsing for log lines (year-less syslog form) and JSON values."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def now_literal(now: _dt.datetime | None = None) -> Column:
    """The fallback instant used when a text time cannot be parsed.

    It is a parameter (fixed per job) instead of the wall clock per row, so a
    re-run of the same input gives the same result.
    """
    if now is None:
        now = _dt.datetime.now(_dt.timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=_dt.timezone.utc)
    micros = int(now.timestamp() * 1_000_000)
    return F.timestamp_micros(F.lit(micros))


def syslog_time(text: Column, year: int | None = None, now: _dt.datetime | None = None) -> Column:
    """``MMM d HH:mm:ss`` (any run of blanks between parts) in ``year``, UTC.

    Unparsable text (e.g. an unknown month word) gives ``now``.
    """
    if year is None:
        year = (now or _dt.datetime.now(_dt.timezone.utc)).year
    squeezed = F.regexp_replace(text, r"(?U)\s+", " ")
    parsed = F.try_to_timestamp(F.concat(F.lit(f"{year} "), squeezed), F.lit("yyyy MMM d HH:mm:ss"))
    return F.coalesce(parsed, now_literal(now))


# ISO-8601 forms accepted for JSON time text: date, optional time with
# optional fraction, optional Z or numeric offset.
_ISO = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
        r"(Z|[+-]\d{2}(:?\d{2})?)?$")
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
# ISO basic form (no separators), accepted by Python's fromisoformat:
# rewritten to the extended form before parsing.
_ISO_BASIC = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(\.\d{1,9})?(Z|[+-]\d{2}(?::?\d{2})?)?$"


def json_time(value: Column, now: _dt.datetime | None = None) -> Column:
    """Time from a JSON field kept as text.

    Number text = epoch seconds; ISO text with T or blank, optional fraction
    and offset (none = UTC); anything else, or NULL, gives ``now``.
    """
    v = value
    epoch = F.timestamp_micros(F.round(v.cast("double") * F.lit(1_000_000)).cast("bigint"))
    iso = F.try_to_timestamp(v)
    basic = F.try_to_timestamp(F.regexp_replace(v, _ISO_BASIC, "$1-$2-$3T$4:$5:$6$7$8"))
    return (
        F.when(v.rlike(_NUMBER), epoch)
        .when(v.rlike(_ISO), F.coalesce(iso, now_literal(now)))
        .when(v.rlike(_ISO_BASIC), F.coalesce(basic, now_literal(now)))
        .otherwise(now_literal(now))
    )
