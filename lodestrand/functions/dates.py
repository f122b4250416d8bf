"""Dates as written: the local date of an ISO string, its parts, and days named in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(value: Column) -> Column:
    """The date as written, never moved to another zone; '' for null or empty."""
    plain = F.replace(F.replace(value.cast("string"), F.lit("+08:00"), F.lit("")), F.lit("Z"), F.lit(""))
    day = F.when(F.contains(plain, F.lit("T")), F.substring_index(plain, "T", 1)).otherwise(F.substring(plain, 1, 10))
    return F.coalesce(day, F.lit(""))


def part(date: Column, index: int) -> Column:
    """Year (0), month (1) or day (2) of a local date, null where there is none."""
    return F.try_element_at(F.split(date, "-"), F.lit(index + 1)).try_cast("int")


#: The months in order.
MONTHS = "january february march april may june july august september october november december".split()


def _named(said: Column, day: Column) -> Column:
    """`November`, `November 2025`, `November 5`, `November 5, 2025` or `5 November 2025` as a date.

    A year that is not said is that of the given day, and so is a day of the month, or the month's last where it has fewer.
    """
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(said, rf"\b({'|'.join(MONTHS)})\b", 1))
    number = F.nullif(F.regexp_extract(said, r"\b(\d{1,2})(?:st|nd|rd|th)?\b", 1), F.lit("")).cast("int")
    year = F.coalesce(F.nullif(F.regexp_extract(said, r"\b(\d{4})\b", 1), F.lit("")).cast("int"), F.year(day))
    first = F.when(month > 0, F.make_date(year, F.greatest(month.cast("int"), F.lit(1)), F.lit(1)))
    own = F.date_add(first, F.least(F.coalesce(number, F.dayofmonth(day)), F.dayofmonth(F.last_day(first))) - 1)
    return F.when((month > 0) & (F.coalesce(number, F.lit(1)) > 0), F.date_format(own, "yyyy-MM-dd"))


def resolve(phrase: Column, today: Column) -> Column:
    """A phrase for a day as an ISO date, relative to a given day; null for phrases outside the grammar.

    today, yesterday, tomorrow, the day before yesterday, N days|weeks|months|years ago, last|past|next week|month|year,
    months by name with or without day and year, and ISO dates.
    """
    said, day = F.lower(F.trim(phrase)), F.to_date(today)
    n = F.coalesce(F.regexp_extract(said, r"(\d+)\s+(?:day|week|month|year)s?\s+ago", 1).try_cast("int"), F.lit(0))
    iso = F.regexp_extract(said, r"\d{4}-\d{2}-\d{2}", 0)
    found = (
        F.when(iso != "", iso)
        .when(said == "today", F.date_format(day, "yyyy-MM-dd"))
        .when(said == "yesterday", F.date_format(F.date_sub(day, 1), "yyyy-MM-dd"))
        .when(said == "tomorrow", F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))
        .when(said.rlike(r"^(?:the\s+)?day\s+before\s+yesterday$"), F.date_format(F.date_sub(day, 2), "yyyy-MM-dd"))
        .when(said.rlike(r"\d+\s+days?\s+ago"), F.date_format(F.date_sub(day, n), "yyyy-MM-dd"))
        .when(said.rlike(r"\d+\s+weeks?\s+ago"), F.date_format(F.date_sub(day, n * 7), "yyyy-MM-dd"))
        .when(said.rlike(r"\d+\s+months?\s+ago"), F.date_format(F.add_months(day, -n), "yyyy-MM-dd"))
        .when(said.rlike(r"\d+\s+years?\s+ago"), F.date_format(F.add_months(day, -12 * n), "yyyy-MM-dd"))
    )
    for word, weeks, months in (("week", 7, 0), ("month", 0, 1), ("year", 0, 12)):
        for mark, sign in (("last|past", -1), ("next", 1)):
            moved = F.date_add(day, sign * weeks) if weeks else F.add_months(day, sign * months)
            found = found.when(said.rlike(rf"^(?:{mark})\s+{word}$"), F.date_format(moved, "yyyy-MM-dd"))
    return found.otherwise(_named(said, day))
