"""Messy values to typed ones, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "y年M月d日"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{8}$", "yyyyMMdd"),
)
TRUE_WORDS = ("true", "yes", "是", "1", "y")
TEN_THOUSAND = "万"


def stripped(c: Column) -> Column:
    """Without white space at the ends, as Python's str.strip but for U+001C to U+001F."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def typed_date(c: Column) -> Column:
    """The date a string spells in one of the known styles, day first before month first; else null."""
    t = stripped(c.cast("string"))
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_date(t, style)) for shape, style in DATE_SHAPES])


def iso_date(c: Column, kind: str = "string") -> Column:
    """ISO text of dates, timestamps, eight-digit numbers and date strings; other text stays, stripped."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(c, "yyyy-MM-dd")
    return F.coalesce(F.date_format(typed_date(c), "yyyy-MM-dd"), stripped(c.cast("string")))


def boolean(c: Column, kind: str = "string") -> Column:
    """Null stays; known words are true and all other text false; numbers are true unless 0."""
    if kind == "boolean":
        return c
    if kind != "string":
        return c != 0
    return F.when(c.isNull(), None).otherwise(F.lower(stripped(c)).isin(*TRUE_WORDS))


def number(c: Column, kind: str = "string", integer: bool = False) -> Column:
    """A double (or long, truncated) out of text with units, currency and separators; null where none is left.

    The ten-thousand sign multiplies. Everything but digits, points and minus signs goes, so "1e5" is 15.
    """
    if kind == "string":
        digits = F.regexp_replace(c, r"[^0-9.\-]", "")
        value = F.try_multiply(digits.try_cast("double"), F.when(F.contains(c, F.lit(TEN_THOUSAND)), 1e4).otherwise(1.0))
    else:
        value = c.cast("double")
    return F.when(F.abs(value) < 9.2e18, value).try_cast("long") if integer else value


def looks_numeric(c: Column) -> Column:
    """Whether text without points and minus signs is digits only."""
    return F.regexp_replace(c, r"[.\-]", "").rlike(r"^\d+$")


def masked_text(c: Column) -> Column:
    """[RESTRICTED-n chars]; null and empty stay, and so does what is masked already."""
    done = c.rlike(r"^\[RESTRICTED-\d+ chars\]$")
    return F.when(c.isNull() | (c == "") | done, c).otherwise(F.concat(F.lit("[RESTRICTED-"), F.length(c).cast("string"), F.lit(" chars]")))


def masked_number(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("***.**"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
