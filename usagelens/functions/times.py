"""Civil days, range starts, peak hours. ``now`` is always an argument, never the clock."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens import fixed


def local_time(ts_ms: Column, tz: str = "UTC") -> Column:
    """Wall-clock timestamp of an instant in ``tz`` (the session zone must be UTC)."""
    instant = F.timestamp_millis(ts_ms)
    return instant if tz == "UTC" else F.from_utc_timestamp(instant, tz)


def local_day(ts_ms: Column, tz: str = "UTC") -> Column:
    """Civil day of an instant in ``tz``."""
    return utc_day(ts_ms) if tz == "UTC" else F.to_date(local_time(ts_ms, tz))


def utc_day(ts_ms: Column) -> Column:
    """UTC day of an instant; does not depend on the session zone."""
    return F.date_from_unix_date(F.floor(ts_ms / fixed.DAY_MS).cast("int"))


def day_start_ms(day: Column, tz: str = "UTC") -> Column:
    """First instant of a civil day in ``tz``."""
    midnight = day.cast("timestamp")
    return F.unix_millis(midnight if tz == "UTC" else F.to_utc_timestamp(midnight, tz))


def local_day_start_col(ts_ms: Column, offset: int = 0, tz: str = "UTC") -> Column:
    """Start of the civil day ``offset`` days away from an instant's day."""
    return day_start_ms(F.date_add(local_day(ts_ms, tz), offset), tz)


def local_day_start(now_ms: int, offset: int = 0, tz: str = "UTC") -> int:
    """Driver-side twin of :func:`local_day_start_col` for job arguments."""
    zone = ZoneInfo(tz)
    day = datetime.fromtimestamp(now_ms / 1000, zone).date() + timedelta(days=offset)
    midnight = datetime(day.year, day.month, day.day, tzinfo=zone)
    return int(midnight.astimezone(timezone.utc).timestamp() * 1000)


def local_range_start(days: int, now_ms: int, tz: str = "UTC") -> int:
    """Start of the last ``days`` civil days including today; 0 days means all history."""
    return local_day_start(now_ms, 1 - days, tz) if days > 0 else 0


def local_month_start(now_ms: int, tz: str = "UTC") -> int:
    zone = ZoneInfo(tz)
    today = datetime.fromtimestamp(now_ms / 1000, zone)
    first = datetime(today.year, today.month, 1, tzinfo=zone)
    return int(first.timestamp() * 1000)


def local_today(now_ms: int, tz: str = "UTC") -> str:
    return datetime.fromtimestamp(now_ms / 1000, ZoneInfo(tz)).date().isoformat()


def utc_day_offset(now_ms: int, offset: int) -> str:
    shifted = (now_ms + offset * fixed.DAY_MS) / 1000
    return datetime.fromtimestamp(shifted, timezone.utc).date().isoformat()


def is_peak(ts_ms: Column) -> Column:
    """Provider peak time: UTC working days within the peak hour spans."""
    hour = F.floor(F.pmod(ts_ms, F.lit(fixed.DAY_MS)) / fixed.HOUR_MS)
    in_span = None
    for first, last in fixed.PEAK_HOURS:
        span = hour.between(first, last)
        in_span = span if in_span is None else in_span | span
    return (F.weekday(utc_day(ts_ms)) < 5) & in_span


def iso_millis(ts_ms: Column) -> Column:
    """``2024-01-30T15:00:00.000Z`` text of an instant."""
    instant = F.timestamp_millis(ts_ms)
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO text; null when it is not a date."""
    return F.unix_millis(F.try_to_timestamp(text))


def seconds_to_millis(v: Column) -> Column:
    """Second stamps are scaled up, millisecond stamps kept; 0 and below give null."""
    n = v.cast("double")
    scaled = F.when((n > 0) & (n < 1e12), n * 1000).otherwise(n)
    return F.when(scaled > 0, scaled.cast("long"))


def to_millis(v: Column, now_ms: int, is_text: bool = False) -> Column:
    """Seconds, milliseconds or microseconds to milliseconds; implausible stamps give null."""
    n = F.when(v.rlike(r"^\d{10,16}$"), v.try_cast("double")) if is_text else v.try_cast("double")
    ms = (
        F.when(n > 1e14, F.floor(n / 1000))
        .when(n < 1e11, F.floor(n * 1000))
        .otherwise(F.floor(n))
    )
    plausible = (n > 0) & ms.between(fixed.EARLIEST_MS, now_ms + fixed.DAY_MS)
    return F.when(plausible, ms.cast("long"))
