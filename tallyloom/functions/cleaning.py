"""Column expressions that clean fields; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Blanks and the quote that are taken off around a value.
AROUND = ' "\t\n\r\u00a0'


def unquote(c: Column) -> Column:
    """The value without the blanks and double quotes around it; null stays null."""
    return F.btrim(c, F.lit(AROUND))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text_value(c: Column) -> Column:
    """Unquoted value; null if nothing is left."""
    return blank_to_null(unquote(c))


def pad_week(c: Column) -> Column:
    """``2020_7`` and ``2020_7:user`` to ``2020_07``, ``2020_07:user``; other texts stay."""
    # c is named once: pushed-down filters on ids repeat the expression for every reference
    return F.regexp_replace(c, r"^(?<y>\d{4})_(?<w>\d)(?=:|$)", "${y}_0${w}")


def clean_group_id(c: Column) -> Column:
    """A ``week:entity`` id without blanks around it and without any quotes, its week padded; blank gives null."""
    return blank_to_null(pad_week(F.trim(F.translate(c, '"', ""))))


def group_week(group_id: Column) -> Column:
    """The week of a cleaned group id; null where it has none (``:user``) or the id has no colon."""
    return F.regexp_substr(group_id, F.lit(r"^\d{4}_\d{2}(?=:)"))


def group_entity(group_id: Column) -> Column:
    """The part of a cleaned group id after the first colon; null if absent."""
    return F.regexp_substr(group_id, F.lit(r"(?s)(?<=:).+"))


def pad_county(value: Column) -> Column:
    """A cleaned county padded to five digits; null for the marker -1. Longer values are kept whole."""
    padded = F.when(F.length(value) < 5, F.lpad(value, 5, "0")).otherwise(value)
    return F.when(value != "-1", padded)


def clean_county(c: Column) -> Column:
    """County without blanks and quotes around it, padded to five digits; null for blank values and -1."""
    return pad_county(clean_text_value(c))


def clean_number(c: Column) -> Column:
    """Text to DOUBLE after trimming blanks and quotes; malformed values give 0.0."""
    return F.coalesce(unquote(c).try_cast("double"), F.lit(0.0))


def finite(c: Column) -> Column:
    """True for readings that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def plausible_share(c: Column) -> Column:
    """True for finite readings above 0 and at most 1."""
    return F.coalesce(finite(c) & (c > 0) & (c <= 1), F.lit(False))
