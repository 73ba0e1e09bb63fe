"""Rules on identifiers, versions and date texts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import found
from .rule import Rule, on_text, pattern_rule


def _month_days(year: Column, month: Column) -> Column:
    """Days of a month of the proleptic Gregorian calendar, for any year."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _digits(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n).try_cast("int")


def _calendar(c: Column) -> Column:
    """Whether year, month and (if there is one) day of a text that starts like 2024-02-30 exist."""
    year, month, day = _digits(c, 1, 4), _digits(c, 6, 2), _digits(c, 9, 2)
    return month.between(1, 12) & (day.isNull() | day.between(1, _month_days(year, month)))


_ISO8601 = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?$"


def is_iso8601(*, strict: bool = False) -> Rule:
    """The shape; strict: existing dates, hours to 23, minutes to 59, seconds to 60."""

    def test(c: Column) -> Column:
        date = (F.length(c) == 4) | _calendar(c)
        time = (F.length(c) <= 10) | (_digits(c, 12, 2) <= 23) & (_digits(c, 15, 2) <= 59) & (_digits(c, 18, 2) <= 60)
        return found(c, _ISO8601) & F.coalesce(date & time, F.lit(False)) if strict else found(c, _ISO8601)

    return on_text("isISO8601", test, {"format": "date-time", "strict": strict})


def is_date_string() -> Rule:
    return on_text("isDateString", lambda c: found(c, "^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.coalesce(_calendar(c) & (_digits(c, 9, 2) >= 1), F.lit(False)))


is_isrc = pattern_rule("isISRC", "^[A-Z]{2}-[A-Z0-9]{3}-[0-9]{2}-[0-9]{5}$", "^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$")


@cache
def iso_countries(letters: int) -> tuple[str, ...]:
    """ISO 3166-1 codes of two or three letters, as the Java runtime lists them."""
    locale = SparkSession.active()._jvm.java.util.Locale
    codes = [*locale.getISOCountries()]
    if letters == 3:
        codes = [locale.Builder().setRegion(c).build().getISO3Country() for c in codes]
    return tuple(sorted(codes))


is_iso31661_alpha2 = on_text("isISO31661Alpha2", lambda c: F.upper(c).isin(*iso_countries(2)))
is_iso31661_alpha3 = on_text("isISO31661Alpha3", lambda c: F.upper(c).isin(*iso_countries(3)))
is_firebase_push_id = pattern_rule("isFirebasePushId", r"^[\w-]{20}$")
_NUMBER, _WORD = "(0|[1-9][0-9]*)", "[0-9a-zA-Z-]+"
_PRE = "(0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)"
is_sem_ver = pattern_rule("isSemVer", rf"^{_NUMBER}(\.{_NUMBER}){{2}}(-{_PRE}(\.{_PRE})*)?(\+{_WORD}(\.{_WORD})*)?$")
is_mongo_id = pattern_rule("isMongoId", "^[0-9a-fA-F]{24}$")


def is_ulid() -> Rule:
    """26 letters and digits of Crockford's alphabet, upper case only."""
    return pattern_rule("isULID", "^[0-9A-HJKMNP-TV-Z]{26}$", constraints={"format": "ulid"})


def is_cuid2() -> Rule:
    return pattern_rule("isCUID2", "^[a-z][0-9a-z]{23,31}$", constraints={"format": "cuid2"})
