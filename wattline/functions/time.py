"""Timestamp parsing, rendering, bucketing and calendar ranges."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# Display patterns (24 h clock, UTC).
TIME_OF_DAY = "HH:mm:ss"
DATE_TIME = "yyyy-MM-dd HH:mm:ss"


def parse_ts(c) -> Column:
    """ISO text with ``Z``, an offset or no zone -> instant; no zone = UTC
    (session time zone is UTC).  Unparseable text -> null (caller quarantines)."""
    return F.try_to_timestamp(_c(c))


def to_instant(c) -> Column:
    """Cast ``timestamp_ntz`` (test tables) or text to an instant under UTC."""
    return _c(c).cast("timestamp")


def iso_utc(c) -> Column:
    """C11: ``yyyy-MM-ddTHH:mm:ssZ`` (session time zone must be UTC)."""
    return F.date_format(_c(c), ISO_UTC)


def epoch_seconds(c) -> Column:
    return F.unix_seconds(_c(c).cast("timestamp"))


def bucket(c, minutes: int) -> Column:
    """Start of the epoch-aligned bucket of ``minutes`` minutes.

    Seconds since epoch are floored to a multiple of ``minutes*60``; fractions of
    a second are dropped first, like the reference's integer seconds.
    """
    width = int(minutes) * 60
    secs = epoch_seconds(c)
    return F.timestamp_seconds(F.floor(secs / F.lit(width)) * F.lit(width))


def time_label(c) -> Column:
    """C14: time of day, 24 h, UTC."""
    return F.date_format(_c(c), TIME_OF_DAY)


def date_time_label(c) -> Column:
    """C14: date and time, UTC."""
    return F.date_format(_c(c), DATE_TIME)


def _clock(text: str) -> _dt.timedelta:
    """``hh:mm`` as time since midnight; a part that is missing or no number counts as 0."""
    hours, minutes = re.fullmatch(r"\s*(\d*)[^:]*:?\s*(\d*).*", text, re.DOTALL).groups()
    return _dt.timedelta(hours=int(hours or 0), minutes=int(minutes or 0))


def calendar_range(date_start: str | None, date_end: str | None,
                   time_start: str | None = None, time_end: str | None = None,
                   tz: str = "UTC") -> tuple[_dt.datetime | None, _dt.datetime | None]:
    """date + ``hh:mm`` -> inclusive [start, end] instants in UTC.

    Start is at ``:00.000`` (default 00:00), end at ``:59.999`` (default 23:59),
    both read in time zone ``tz``.  A missing date leaves that side open.
    """
    from zoneinfo import ZoneInfo
    zone = ZoneInfo(tz)

    def instant(date: str | None, clock: str, extra: _dt.timedelta) -> _dt.datetime | None:
        if not date:
            return None
        midnight = _dt.datetime.combine(_dt.date.fromisoformat(date[:10]), _dt.time(), zone)
        return (midnight + _clock(clock) + extra).astimezone(_dt.timezone.utc).replace(tzinfo=None)

    last = _dt.timedelta(seconds=59, milliseconds=999)
    return instant(date_start, time_start or "00:00", _dt.timedelta()), instant(date_end, time_end or "23:59", last)
