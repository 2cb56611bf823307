"""Date / clock parsing and timestamp helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def parse_yyyymmdd(c) -> Column:
    """GTFS ``YYYYMMDD`` -> DATE; unparsable -> NULL (never an exception)."""
    return F.try_to_date(F.trim(_c(c).cast("string")), "yyyyMMdd")


def parse_gtfs_clock(c) -> Column:
    """``H:MM:SS`` since service-day noon-minus-12h; hours may exceed 23.

    Returns INT seconds, NULL when the value is not three integer fields.
    """
    text = F.trim(_c(c))
    h, m, s = (p.try_cast("int") for p in (F.substring_index(text, ":", 1), F.substring_index(F.substring_index(text, ":", 2), ":", -1), F.substring_index(text, ":", -1)))
    three = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) == 2
    return F.when(three, h * 3600 + m * 60 + s)


def local_wall_clock(date_col, seconds_col) -> Column:
    """Service date + seconds -> wall-clock TIMESTAMP_NTZ (may roll past midnight)."""
    return F.to_timestamp_ntz(F.date_format(_c(date_col), "yyyy-MM-dd")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), _c(seconds_col).cast("decimal(18,6)")
    )


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _clock_seconds(ts_ntz: Column) -> Column:
    """Seconds of a wall clock since 1970-01-01 00:00:00 (``timestampdiff`` would go by the session zone)."""
    days = F.datediff(ts_ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts_ntz) * 3600 + F.minute(ts_ntz) * 60 + F.second(ts_ntz)


def wall_clock_to_instant(ts_ntz, zone) -> Column:
    """Local wall clock in ``zone`` -> instant (TIMESTAMP), whatever the session zone.

    A clock time that a zone skips moves on by the gap; of a repeated one the first is meant.
    """
    utc = F.convert_timezone(_c(zone), F.lit("UTC"), _c(ts_ntz))
    return F.timestamp_seconds(_clock_seconds(utc))


def instant_to_local(ts, zone) -> Column:
    """Instant -> wall clock (TIMESTAMP_NTZ) in ``zone``, whatever the session zone."""
    utc = F.timestamp_add("SECOND", F.unix_timestamp(_c(ts)), F.expr(_EPOCH))
    return F.convert_timezone(F.lit("UTC"), _c(zone), utc)


def utc_offset_seconds(ts, zone) -> Column:
    """Offset of ``zone`` from UTC at instant ``ts``, in seconds."""
    return _clock_seconds(instant_to_local(ts, zone)) - F.unix_timestamp(_c(ts))


def clock_text(ts_ntz) -> Column:
    """``HHhMM`` of a wall clock."""
    return F.format_string("%02dh%02d", F.hour(_c(ts_ntz)), F.minute(_c(ts_ntz)))


def day_text(ts_ntz) -> Column:
    """``dd-MM`` of a wall clock."""
    day = _c(ts_ntz).cast("date")
    return F.format_string("%02d-%02d", F.dayofmonth(day), F.month(day))


def hour_floor_seconds(seconds) -> Column:
    """Earliest-departure filter keeps only the hour (minutes dropped)."""
    return (F.floor(_c(seconds) / 3600) * 3600).cast("int")


def parse_iso_request_time(c) -> Column:
    """Request time ``yyyy-MM-ddTHH:mm:ss``; NULL when malformed."""
    return F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def parse_request_clock(c) -> Column:
    """``HH:mm:ss`` of a requested earliest departure -> seconds, NULL when malformed."""
    t = parse_iso_request_time(F.concat(F.lit("2000-10-10T"), _c(c)))
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
