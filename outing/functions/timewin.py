"""Singapore time windows and displays. Stored times are UTC timestamps without zone."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from outing.model import OFFSET_HOURS

_OFFSET = timedelta(hours=OFFSET_HOURS)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def local_day(now: datetime) -> date:
    """Calendar day in Singapore of a UTC time."""
    return (now + _OFFSET).date()


def midnight(day: date) -> datetime:
    """The UTC time at which a Singapore day starts."""
    return datetime.combine(day, time()) - _OFFSET


def day_window(first: date, days: int) -> tuple[datetime, datetime]:
    return midnight(first), midnight(first + timedelta(days=days))


def preset_window(preset: str, now: datetime) -> tuple[datetime, datetime]:
    """Half-open UTC window: today and weekend by Singapore days; week and month are 7 and 30 days from now."""
    today = local_day(now)
    if preset == "today":
        return day_window(today, 1)
    if preset == "weekend":  # on a Sunday, the weekend that is on
        back = 1 if today.weekday() == 6 else -((5 - today.weekday()) % 7)
        return day_window(today - timedelta(days=back), 2)
    if preset in ("week", "month"):
        return now, now + timedelta(days=7 if preset == "week" else 30)
    raise ValueError(f"unknown window {preset!r}")


def phrase_window(key: str, now: datetime) -> tuple[datetime, datetime]:
    """Window of a phrase of a question: tonight, tomorrow, a weekday, next_week or a preset."""
    today = local_day(now)
    if key == "tonight":
        return midnight(today) + timedelta(hours=17), midnight(today + timedelta(days=1))
    if key == "tomorrow":
        return day_window(today + timedelta(days=1), 1)
    if key == "next_week":
        return day_window(today + timedelta(days=7 - today.weekday()), 7)
    if key in WEEKDAYS:
        return day_window(today + timedelta(days=(WEEKDAYS.index(key) - today.weekday()) % 7), 1)
    return preset_window(key, now)


def explicit_window(start: str | None, end: str | None, now: datetime) -> tuple[datetime, datetime]:
    """Window of ISO texts: a plain end date counts in full, a time ends it there; without an end, 30 days."""

    def read(value: str) -> datetime:
        got = datetime.fromisoformat(value)
        return got - (got.utcoffset() or timedelta()) if got.tzinfo else got - _OFFSET

    first = read(start).replace(tzinfo=None) if start else now
    if end is None:
        return first, max(first, now) + timedelta(days=30)
    last = read(end).replace(tzinfo=None)
    return first, last + timedelta(days=1) if len(end) == 10 else last


def local(ts: Column) -> Column:
    """Singapore clock of a stored time."""
    return ts + F.expr(f"INTERVAL '{OFFSET_HOURS}' HOUR")


def local_date(ts: Column) -> Column:
    return F.to_date(local(ts))


def _clock(ts: Column, clock: str) -> Column:
    if clock == "24h":
        return F.date_format(local(ts), "HH:mm")
    short = F.concat(F.date_format(local(ts), "h"), F.lower(F.date_format(local(ts), "a")))
    full = F.concat(F.date_format(local(ts), "h:mm"), F.lower(F.date_format(local(ts), "a")))
    return F.when(F.minute(local(ts)) == 0, short).otherwise(full)


def format_when(starts_at: Column, ends_at: Column, all_day: Column, clock: str = "24h") -> Column:
    """Sat 3 Oct 2026, 10:00-16:00 SGT, with en dashes; the end of an all-day event is exclusive."""
    day, short = F.date_format(local(starts_at), "E d MMM yyyy"), F.date_format(local(starts_at), "E d MMM")
    last = local(ends_at) - F.expr("INTERVAL '1' DAY")
    long = F.to_date(last) > local_date(starts_at)
    days = F.when(ends_at.isNotNull() & long, F.concat(short, F.lit(" – "), F.date_format(last, "E d MMM yyyy"))).otherwise(day)
    start, end = _clock(starts_at, clock), _clock(ends_at, clock)
    same = local_date(ends_at) == local_date(starts_at)
    times = (
        F.when(ends_at.isNull(), F.concat(day, F.lit(", "), start, F.lit(" SGT")))
        .when(same, F.concat(day, F.lit(", "), start, F.lit("–"), end, F.lit(" SGT")))
        .otherwise(F.concat(day, F.lit(", "), start, F.lit(" – "), F.date_format(local(ends_at), "E d MMM"), F.lit(", "), end, F.lit(" SGT")))
    )
    return F.when(all_day, days).otherwise(times)


# Whether an event is over has five answers, each used in one place.


def search_end(starts_at: Column, ends_at: Column, all_day: Column) -> Column:
    """Search and the judge: an all-day event without an end lasts its day."""
    whole_day = F.when(F.coalesce(all_day, F.lit(False)), starts_at + F.expr("INTERVAL '1' DAY")).otherwise(starts_at)
    return F.coalesce(ends_at, whole_day)


def enrichment_end(starts_at: Column, ends_at: Column) -> Column:
    """Enrichment, freshness checks and saved events: no grace."""
    return F.coalesce(ends_at, starts_at)


def expiry_end(starts_at: Column, ends_at: Column) -> Column:
    """Expiry: every event without an end gets a day."""
    return F.coalesce(ends_at, starts_at + F.expr("INTERVAL '1' DAY"))
