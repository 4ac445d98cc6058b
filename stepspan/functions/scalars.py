"""Scalar functions on columns, all built-in but the folding of accents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def minutes(clock: Column) -> Column:
    """FN-1. HH:MM:SS to minutes; hours may pass 23, seconds are ignored; bad text gives null."""
    h, m = (F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int") for i in (1, 2))
    return h * 60 + m


def december_change(year: Column) -> Column:
    """The Sunday after December's second Saturday."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(12), F.lit(1)), 1), "Sat"), 8)


def timetable_change(day: Column) -> Column:
    """FN-2. The next yearly timetable change, strictly after day."""
    this = december_change(F.year(day))
    return F.when(this > day, this).otherwise(december_change(F.year(day) + 1))


def timetable_year(day: Column) -> Column:
    """FN-2. The yearly timetable a day belongs to, named by the year of its end."""
    return F.year(timetable_change(day))


def day_kind(day: Column) -> Column:
    """FN-3. weekday (Monday to Friday), saturday, or null for a Sunday."""
    return F.when(F.weekday(day) < 5, "weekday").when(F.weekday(day) == 5, "saturday")


def iso_utc(t: Column) -> Column:
    """FN-12. A timestamp as ISO-8601 in UTC (session zone UTC)."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_day(t: Column, hours: int = 2) -> Column:
    """FN-12. The day at a fixed offset from UTC."""
    return F.to_date(F.timestamp_seconds(F.unix_seconds(t) + hours * 3600))


def _folded(names: pd.Series) -> pd.Series:
    import unicodedata

    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def fold(name: Column) -> Column:
    """Letters without accents, other non-ASCII dropped: Spark has no Unicode folding, so in Arrow batches."""
    return F.pandas_udf(_folded, StringType())(name)


def name_key(name: Column) -> Column:
    """FN-5. Folded, lower-case, everything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(fold(name)), "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    """FN-6. Folded, lower-case, apostrophes dropped, everything else a hyphen."""
    bare = F.regexp_replace(F.lower(fold(F.regexp_replace(name, "['’]", ""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(bare, "^-+|-+$", "")


def status_of_counts(yes: Column, no: Column, total: Column) -> Column:
    """PRJ-6. Three-way status from counts."""
    return F.when(total.isNull() | (total == 0), "unknown").when(yes == total, "yes").when(no == total, "no").when(yes == 0, "unknown").otherwise("partial")


def status_of_height(ok: Column, every: Column) -> Column:
    """PRJ-6, two counts: null unknown, all yes, none no, else partial."""
    return F.when(ok.isNull() | every.isNull(), "unknown").when(ok == every, "yes").when(ok == 0, "no").otherwise("partial")


def band(minutes: Column, limits: tuple[int, ...] = (30, 60, 90, 120)) -> Column:
    """PRJ-10. 0 up to the first limit, inclusive, and so on."""
    return sum(((minutes > x).cast("int") for x in limits), F.lit(0))


def freshness(full_state: Column, last_message: Column, published: Column, now: Column) -> Column:
    """PRJ-11."""
    def older(t: Column, minutes: int) -> Column:
        return F.unix_micros(now) - F.unix_micros(t) > minutes * 60_000_000

    return F.when(full_state.isNull() | older(full_state, 26 * 60), "unknown").when(last_message.isNull() | older(last_message, 30) | older(published, 30), "nightly").otherwise("live")
