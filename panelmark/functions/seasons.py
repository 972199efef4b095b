"""Seasons, listing dates, tenure and ages. A season begins on July 1 and is coded by two years' last digits, 2526."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(first_year: Column) -> Column:
    """The code of the season that begins in first_year: 2025 gives 2526."""
    return (first_year % 100 * 100 + (first_year + 1) % 100).cast("int")


def of_date(date: Column) -> Column:
    return code(F.year(date) - (F.month(date) < 7).cast("int"))


def ending_in(year: Column) -> Column:
    return code(year - 1)


def beginning_in(year: Column) -> Column:
    return code(year)


def first_year(season: Column, century: int = 2000) -> Column:
    """The year in which a coded season begins."""
    return (F.lit(century) + F.floor(season / 100)).cast("int")


def last_codes(season: Column, n: int) -> Column:
    """The codes of the n seasons that end with `season`, oldest first."""
    if n <= 0:
        return F.array().cast("array<int>")
    start = F.floor(season / 100).cast("int")
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda back: code(start - back + 200))


def before_listing(anchor: Column, n: int) -> Column:
    """The codes of the n seasons completed before the listing season's July 1."""
    return last_codes(code(first_year(anchor) - 1), n)


def listing_date(season: Column) -> Column:
    return F.make_date(first_year(season), F.lit(7), F.lit(1))


def of_text(text: Column) -> Column:
    """A season code or a calendar year as text: 2526 as it is, 2024 as the season that ends in it; null for other text."""
    n = F.when(text.rlike("^[0-9]{4}$"), F.try_to_number(text, F.lit("9999")).cast("int"))
    follows = (F.floor(n / 100) + 1) % 100 == n % 100
    return F.when(follows, n).when(n.between(1900, 2100), ending_in(n))


def grade_date(achieved: Column, appointed: Column) -> Column:
    return F.coalesce(achieved, appointed)


def years_in_grade(since: Column, season: Column) -> Column:
    """Whole years at the listing's July 1: credited from the July 1 after the date, or on a listing's own July 1."""
    ref = first_year(season)
    first = F.year(since) + (F.month(since) >= 7).cast("int")
    return F.when(since == listing_date(season), 1).when(first > ref, 0).otherwise(ref - first + 1)


def age_at(born: Column, season: Column) -> Column:
    """Whole years on the listing's July 1."""
    late = (F.month(born) > 7) | ((F.month(born) == 7) & (F.dayofmonth(born) > 1))
    return first_year(season) - F.year(born) - late.cast("int")


def first_listing_at_age(born: Column, age: int) -> Column:
    late = (F.month(born) > 7) | ((F.month(born) == 7) & (F.dayofmonth(born) > 1))
    return code(F.year(born) + age + late.cast("int"))


def parsed_date(text: Column) -> Column:
    """ISO, US and day-first dates with dots; null for other text."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "d.M.yyyy"))
