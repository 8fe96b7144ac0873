"""Printed dates and times → DATE, seconds of the day, wall-clock timestamps.

A printed date is first rewritten to one canonical form by shape, so that a value
costs a handful of anchored matches instead of dozens of formatter attempts.
Nothing is invented: what no shape accepts becomes NULL.

All results are local wall clock (DATE / TIMESTAMP_NTZ): calendar work then never
depends on the session zone. ``wall_clock`` converts an instant at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import let, strip

# Month names and the date shapes that statements print.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_LONG = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
_ANY = f"{_LONG}|{_SHORT}"
MONTH_REPAIRS = [
    (r"(?i)\bSept\b", "Sep"),
    (r"(?i)\bJune\b", "Jun"),
    (r"(?i)\bJuly\b", "Jul"),
]
# Each shape is rewritten to ``#year|month|day``.
DATE_SHAPES = [
    (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", "#$4|$3|$1"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "#$1|$2|$3"),
    (rf"^(\d{{1,2}}) ({_ANY}),? (\d{{4}})$", "#$3|$2|$1"),
    (rf"^(\d{{1,2}})-({_SHORT})-(\d{{4}})$", "#$3|$2|$1"),
    (rf"^({_ANY}) (\d{{1,2}}), (\d{{4}})$", "#$3|$1|$2"),
    (r"^(\d{2})(\d{2})(\d{4})$", "#$3|$2|$1"),
]
# What the start of any accepted date looks like: decides cheaply for other text.
DATE_HINT = r"^\s*(?:\d{1,2}[/\- ]\S|\d{4}-\d|\d{8}\s*$|[A-Za-z]{3,9} \d)"
CLOCK = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?: ([AP]M))?$"
DATE_TIME = (
    r"^(.*?\d),?[ T]\s*(\d{1,2}:\d{1,2}(?::\d{1,2})?(?:\s*[AaPp][Mm])?)"
    r"(?:\s+[A-Za-z]{2,5})?$"
)


def _rewrite(col: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def parse_date(text: Column) -> Column:
    canonical = _rewrite(strip(text), MONTH_REPAIRS + DATE_SHAPES)

    def build(parts: Column) -> Column:
        year = F.get(parts, 0).try_cast("int")
        month = F.get(parts, 1)
        day = F.get(parts, 2).try_cast("int")
        year = F.when(F.length(F.get(parts, 0)) == 2, year + 2000).otherwise(year)
        named = ((F.instr(F.lit(MONTHS), F.substring(month, 1, 3)) + 2) / 3).cast("int")
        month = F.when(month.rlike(r"^\d"), month.try_cast("int")).otherwise(named)
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"))

    def to_date(p: Column) -> Column:
        valid = p["m"].between(1, 12) & p["d"].between(1, 31) & (p["y"] >= 1)
        last = F.dayofmonth(F.last_day(F.make_date(p["y"], p["m"], F.lit(1))))
        # A day past the end of a shorter month means its last day.
        return F.when(valid, F.make_date(p["y"], p["m"], F.least(p["d"], last)))

    return F.when(
        text.rlike(DATE_HINT),
        let(
            canonical,
            lambda c: F.when(
                c.startswith("#"),
                let(build(F.split(F.substring(c, 2, 64), r"\|")), to_date),
            ),
        ),
    )


def parse_time(text: Column) -> Column:
    """Clock text → seconds of the day."""
    spaced = F.regexp_replace(strip(text), r"(?i)(\d)([ap]m)\b", "$1 $2")
    clock = F.translate(F.upper(spaced), ".", ":")

    def seconds(c: Column) -> Column:
        hour = F.regexp_extract(c, CLOCK, 1).try_cast("int")
        minute = F.regexp_extract(c, CLOCK, 2)
        second = F.coalesce(F.regexp_extract(c, CLOCK, 3).try_cast("int"), F.lit(0))
        half = F.regexp_extract(c, CLOCK, 4)
        minutes = minute.try_cast("int")
        twelve = F.when(
            hour.between(1, 12) & (F.length(minute) == 2),
            hour % 12 + F.when(half == "PM", 12).otherwise(0),
        )
        hours = F.when(half != "", twelve).otherwise(F.when(hour < 24, hour))
        return F.when(
            c.rlike(CLOCK) & (minutes < 60) & (second < 60),
            hours * 3600 + minutes * 60 + second,
        )

    return let(clock, seconds)


def at_seconds(day: Column, seconds: Column) -> Column:
    """DATE + seconds of the day → wall-clock timestamp (no zone involved)."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.coalesce(seconds, F.lit(0)).cast("decimal(18,6)")
    )


def parse_date_and_time(date_text: Column, time_text: Column) -> Column:
    return at_seconds(parse_date(date_text), parse_time(time_text))


def parse_datetime(text: Column) -> Column:
    """Date with an optional time; am/pm is read before a zone word is dropped."""

    def both(raw: Column) -> Column:
        seconds = parse_time(F.regexp_extract(raw, DATE_TIME, 2))
        day = parse_date(F.regexp_extract(raw, DATE_TIME, 1))
        with_time = F.when(seconds.isNotNull(), at_seconds(day, seconds))
        return F.coalesce(with_time, parse_date(raw).cast("timestamp_ntz"))

    return F.when(text.isNotNull(), let(strip(text), both))


def wall_clock(instant: Column, zone: str) -> Column:
    """Instant → local wall clock in ``zone``, independent of the session zone."""
    micros = F.unix_micros(instant).cast("decimal(20,0)")
    seconds = (micros / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def month_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def has_time_of_day(ts: Column) -> Column:
    return ts != ts.cast("date").cast("timestamp_ntz")
