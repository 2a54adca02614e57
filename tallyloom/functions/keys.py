"""Keys of time and place: ISO weeks, ``week:entity`` ids and their conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import group_week

TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def first_timestamp(columns: Sequence[Column], form: str = TIMESTAMP) -> Column:
    """The first column that parses; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(form)) for c in columns])


def iso_week(ts: Column, mode: str = "iso") -> Column:
    """Week text of a date or timestamp.

    ``iso``: ISO year and two-digit week; ``mixed``: calendar year and ISO
    week; ``unpadded``: weeks that start on Sunday, week 1 holding 1 January, not padded.
    """
    if mode == "iso":
        return F.concat_ws("_", F.extract(F.lit("YEAROFWEEK"), ts), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if mode == "mixed":
        return F.concat_ws("_", F.year(ts), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if mode == "unpadded":
        new_year = F.trunc(ts, "year")
        offset = F.dayofweek(new_year) - 1
        week = F.floor((F.dayofyear(ts) - 1 + offset) / 7).cast("int") + 1
        next_year = F.add_months(new_year, 12)
        rolls = F.date_add(F.to_date(ts), 7 - F.dayofweek(ts)) >= next_year
        return F.concat_ws("_", F.year(ts), F.when(rolls, F.lit(1)).otherwise(week))
    raise ValueError(f"no mode {mode}")


def message_group(dates: Sequence[Column], user: Column, mode: str = "iso") -> Column:
    """``week:user`` of a message; ``:user`` if no date parses, empty if the user is null or blank."""
    ts = first_timestamp(dates)
    week = F.when(ts.isNotNull(), iso_week(ts, mode)).otherwise("")
    return F.when(user.isNull() | (F.trim(user) == ""), "").otherwise(F.concat(week, F.lit(":"), user))


def dated_group(group: Column, when: Column, pattern: str, mode: str = "unpadded") -> Column:
    """Key of the date in ``when`` (group 1 of ``pattern``, yyyy-MM-dd) and the group.

    Null without a match; the bare group where the match is no date.
    """
    found = F.regexp_extract(when, pattern, 1)
    day = F.try_to_timestamp(found, F.lit("yyyy-MM-dd"))
    return F.when(F.coalesce(found, F.lit("")) == "", None).otherwise(F.when(day.isNotNull(), F.concat_ws(":", iso_week(day, mode), group)).otherwise(group))


def date_group(when: Column, pattern: str) -> Column:
    """The matched date itself as group; null without a match."""
    return F.nullif(F.regexp_extract(when, pattern, 1), F.lit(""))


def first_word(group: Column) -> Column:
    """A group id cut at the first white space."""
    return F.element_at(F.split(group, r"\s+"), 1)


def week_monday(week: Column) -> Column:
    """Date of the Monday of ``2020_09``; null for other texts."""
    year = F.substring(week, 1, 4).try_cast("int")
    number = F.substring(week, 6, 2).try_cast("int")
    fourth = F.to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")))
    return F.date_add(F.trunc(fourth, "week"), 7 * (number - 1))


def week_days(week: Column) -> Column:
    """struct (monday, thursday, sunday) of a week."""
    monday = week_monday(week)
    return F.struct(monday.alias("monday"), F.date_add(monday, 3).alias("thursday"), F.date_add(monday, 6).alias("sunday"))


def week_county(group_id: Column, county: Column) -> Column:
    """``week:county``; null for malformed keys or a null county."""
    return F.concat(group_week(group_id), F.lit(":"), county)


def month_county(group_id: Column, county: Column) -> Column:
    """``year_month:county`` by the month of the week's Monday."""
    return F.concat(F.date_format(week_monday(group_week(group_id)), "yyyy_MM"), F.lit(":"), county)


def year_county(group_id: Column, county: Column) -> Column:
    """``year:county`` by the week's year."""
    return F.concat(F.substring(group_week(group_id), 1, 4), F.lit(":"), county)


def date_week(day: Column) -> Column:
    """The ISO week of a date."""
    return iso_week(day)


def date_quarter(day: Column) -> Column:
    """``2020_Q1`` of a date."""
    return F.concat(F.year(day), F.lit("_Q"), F.quarter(day))


def split_week(compact: Column) -> Column:
    """``202009`` to ``2020_09``."""
    return F.concat_ws("_", F.substring(compact, 1, 4), F.substring(compact, 5, 10))


def label(*parts: Column) -> Column:
    """``a:b``; null if a part is null."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(":"), p)
    return out


def in_year_range(group_id: Column, low: str, high: str) -> Column:
    """Ids from ``low`` up to but without ``high``, compared as text (``2020_01`` to ``2021_01``)."""
    return (group_id >= low) & (group_id < high)


def complete_group(group_id: Column) -> Column:
    """False for ids that start or end with a colon, and for null."""
    return F.coalesce(~group_id.startswith(":") & ~group_id.endswith(":"), F.lit(False))

