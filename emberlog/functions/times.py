"""Time functions on columns. Text that is no time gives null; no function raises on data."""

from __future__ import annotations

from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of log lines.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SYSLOG = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
_APACHE = r"(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{2}:\d{2}:\d{2})\s+([+-]\d{4})"


def zone(name: str | None) -> str:
    """A zone that Spark knows: ``name``, or UTC where it is unknown."""
    try:
        return str(ZoneInfo(name or "UTC"))
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return "UTC"


def month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int"), F.lit(0))


def number(text: Column) -> Column:
    return text.try_cast("int")


def made(year: Column, mon: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A timestamp from its parts, null for days that do not exist."""
    return F.try_make_timestamp(year, mon, day, hour, minute, second.cast("decimal(16,6)"))


def to_utc(text: Column) -> Column:
    """A time with an offset, or without one in UTC."""
    return text.try_cast("timestamp")


def parse_epoch(text: Column) -> Column:
    """Whole seconds since 1970, cut to the second; null from 0 down."""
    seconds = F.floor(text.try_cast("double")).try_cast("long")
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def parse_iso(text: Column) -> Column:
    """ISO 8601, or the date form of mails; a time without an offset is in UTC."""
    trimmed = F.trim(text)
    iso = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), trimmed.try_cast("timestamp"))
    mail = F.regexp_replace(F.regexp_replace(trimmed, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT)$", "+0000")
    shape = r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"
    return F.coalesce(iso, F.when(mail.rlike(shape), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))))


def from_syslog(part: list[Column], year: Column | int, tz: str = "UTC") -> Column:
    """A time of its five parts as ``SYSLOG`` has them, in a zone and year."""
    year = F.lit(year) if isinstance(year, int) else year
    local = made(year, month(part[0]), number(part[1]), number(part[2]), number(part[3]), F.coalesce(number(part[4]), F.lit(0)))
    return F.to_utc_timestamp(local, zone(tz))


def parse_syslog(text: Column, year: Column | int, tz: str = "UTC") -> Column:
    """``Mon d HH:MM:SS`` in a zone and year."""
    return F.when(text.rlike(SYSLOG), from_syslog([F.regexp_extract(text, SYSLOG, k) for k in range(1, 6)], year, tz))


def parse_apache(text: Column) -> Column:
    """``d/Mon/yyyy:HH:MM:SS +zzzz``, anywhere in the text."""
    day, mon, year, clock, offset = (F.regexp_extract(text, _APACHE, k) for k in range(1, 6))
    iso = F.concat_ws("-", year, F.lpad(month(mon).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    whole = F.concat(iso, F.lit(" "), clock, F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    return F.when(text.rlike(_APACHE), whole.try_cast("timestamp"))


def parse_last_style(mon: Column, day: Column, clock: Column, year: Column | int, tz: str = "UTC") -> Column:
    """Month, day and HH:MM as separate columns."""
    year = F.lit(year) if isinstance(year, int) else year
    hour, minute = (number(F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})", k)) for k in (1, 2))
    return F.to_utc_timestamp(made(year, month(mon), number(day), hour, minute, F.lit(0)), zone(tz))


def shadow_days(days: Column) -> Column:
    """Days since 1970 as midnight in UTC; null for what is no number of days above 0."""
    n = days.try_cast("int")
    return F.when(n > 0, F.date_add(F.lit("1970-01-01").cast("date"), n).cast("timestamp"))


def parse_any(text: Column, year: Column | int, tz: str = "UTC") -> Column:
    return F.coalesce(parse_iso(text), parse_apache(text), parse_syslog(text, year, tz))


def parse_numeric_or_text(text: Column, year: Column | int, tz: str = "UTC") -> Column:
    """A number as an epoch whose unit follows from its size, if within 1980..2100; else text, in a zone where it names none."""
    value = text.try_cast("double")
    size = F.abs(value)
    seconds = F.when(size >= 1e17, value / 1e9).when(size >= 1e14, value / 1e6).when(size >= 1e11, value / 1e3).otherwise(value)
    inside = (seconds >= 315532800) & (seconds < 4133980800)
    epoch = F.when(inside, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))
    trimmed = F.trim(text)
    local = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.to_utc_timestamp(trimmed.try_cast("timestamp"), zone(tz)))
    return F.when(value.isNotNull(), epoch).otherwise(F.coalesce(local, parse_any(text, year, tz)))


def acquisition_time(name: Column, tz: str = "UTC") -> Column:
    """The first lone run of 14 digits that starts with 20, read as yyyyMMddHHmmss."""
    digits = F.regexp_extract(name, r"(?<!\d)(20\d{12})(?!\d)", 1)
    part = [number(F.substring(digits, at, size)) for at, size in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.when(digits != "", F.to_utc_timestamp(made(*part), zone(tz)))
