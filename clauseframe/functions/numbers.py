"""Numbers: money rounding, extraction from text, months and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    """Two places, halves towards plus infinity."""
    return F.floor(_col(value) * 100 + 0.5) / 100


NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def numbers_in(text: Column | str) -> Column:
    """The numbers of a text as they stand, without list markers at line starts and without thousands separators."""
    plain = F.regexp_replace(_col(text), r"(?m)^[ \t]*\d{1,3}[.)][ \t]", "")
    found = F.regexp_extract_all(plain, F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))


def amounts_in(text: Column | str, currency: str = "ILS|NIS|USD|EUR|₪|\\$|€") -> Column:
    """Amounts with a currency before or after them, as doubles, in order."""
    found = F.regexp_extract_all(_col(text), F.lit(f"((?:(?:{currency})\\s*(?:{NUMBER}))|(?:(?:{NUMBER})\\s*(?:{currency})))"), F.lit(1))
    return F.transform(found, lambda a: F.regexp_replace(F.regexp_extract(a, f"({NUMBER})", 1), ",", "").cast("double"))


def percents_in(text: Column | str) -> Column:
    found = F.regexp_extract_all(_col(text), F.lit(f"({NUMBER})\\s*(?:%|percent|אחוז)"), F.lit(1))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double"))


def duration(value: Column, unit: Column) -> Column:
    """struct(value, unit): hours and weeks in days, years in months."""
    u = F.lower(unit)
    days = F.when(u.rlike("^hours?$"), value / 24).when(u.rlike("^weeks?$"), value * 7).when(u.rlike("^days?$"), value)
    months = F.when(u.rlike("^months?$"), value).when(u.rlike("^years?$"), value * 12)
    return F.struct(F.coalesce(days, months).alias("value"), F.when(days.isNotNull(), "days").otherwise("months").alias("unit"))


def add_months(period: Column | str, months: Column) -> Column:
    """A month 'YYYY-MM' some months later."""
    return F.date_format(F.add_months(F.to_date(F.concat(_col(period), F.lit("-01"))), months.cast("int")), "yyyy-MM")


def date_in_zone(instant: Column | str, zone: str = "Asia/Jerusalem") -> Column:
    """The calendar date in ``zone`` of an instant, in a session that keeps UTC."""
    return F.to_date(F.from_utc_timestamp(_col(instant), zone))
