"""Time bounds and the live state of sessions."""

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# How close to now the last record of a live session is, and the forms a bound may take.
LIVE_SECONDS = 600
_BOUND = re.compile(
    r"(?P<today>today)|(?P<day>\d{4}-\d{2}-\d{2})(?:[T ](?P<clock>\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-][\d:]+)?))?"
)


def event_time(ts: Column) -> Column:
    """Timestamp of an ISO stamp; NULL for anything else."""
    return F.try_to_timestamp(F.nullif(ts, F.lit("")))


def is_live(ended: Column, now: datetime | Column) -> Column:
    """Was the last record written within ten minutes of ``now``, either way?"""
    moment = now if isinstance(now, Column) else F.lit(as_utc(now))
    gap = F.abs(F.unix_micros(moment) - F.unix_micros(event_time(ended)))
    return F.coalesce(gap < F.lit(LIVE_SECONDS * 1_000_000), F.lit(False))


def as_utc(moment: datetime) -> datetime:
    """Aware UTC time; a time without a zone is UTC already."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def parse_bound(value: str, now: datetime | None = None) -> datetime:
    """A date (midnight UTC), ``today`` or an ISO datetime as a UTC time."""
    form = _BOUND.fullmatch(value.strip())
    if form is None:
        raise ValueError(f"{value!r} is no time bound; a bound is today, a date, an ISO datetime or @N")
    if form["today"]:
        day = as_utc(now or datetime.now(UTC)).date()
        return datetime(day.year, day.month, day.day, tzinfo=UTC)
    try:
        moment = datetime.fromisoformat("T".join(part for part in (form["day"], form["clock"]) if part))
    except ValueError as exc:
        raise ValueError(f"{value!r} is no time bound: {exc}") from exc
    return as_utc(moment)
