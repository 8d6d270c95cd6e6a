"""Date parsing, date parts and calendar labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions.text import glue, piece

# Two-digit years from 69 up belong to the 1900s; stores are aged at this day; the two
# calendar weeks that have no Monday of their own year are moved to these Mondays.
TWO_DIGIT_PIVOT = 69
STORE_AGE_DAY = dt.date(2018, 3, 1)
WEEK_REPAIRS = {(2016, 0): dt.date(2016, 1, 4), (2017, 53): dt.date(2017, 12, 25)}


def parse_day_month_year(column: Column) -> Column:
    """``dd/mm/yy`` text to a date; null if it is no date."""
    parsed = F.try_to_date(column, "dd/MM/yy")
    return F.when(
        F.year(parsed) >= 2000 + TWO_DIGIT_PIVOT, F.add_months(parsed, -1200)
    ).otherwise(parsed)


def parse_stamp(column: Column) -> Column:
    """The date of a ``ddMONyyyy:hh:mm:ss`` text; null if it is no date."""
    return F.try_to_date(piece(column, ":", 0), "ddMMMyyyy")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def age_in_days(since: Column, at: dt.date = STORE_AGE_DAY) -> Column:
    return F.datediff(F.lit(at), since.cast("date"))


def day_name(column: Column) -> Column:
    return F.date_format(column, "EEEE")


def is_weekend(column: Column) -> Column:
    return F.weekday(column) >= 5


def week_start(year: Column, week: Column) -> Column:
    """The Monday of a week counted from the year's first Monday (that one opens week 1).

    Null where that Monday falls outside the year.
    """
    first_monday = F.next_day(F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1), "Mon")
    monday = F.date_add(first_monday, 7 * (week - 1))
    return F.when(F.year(monday) == year, monday)


def week_start_repaired(
    year: Column, week: Column, repairs: Mapping[tuple[int, int], dt.date] = WEEK_REPAIRS
) -> Column:
    """``week_start`` with named (year, week) pairs moved to a given day where it is null."""
    start = week_start(year, week)
    choice = F.when(start.isNotNull(), start)
    for (y, w), day in repairs.items():
        choice = choice.when((year == y) & (week == w), F.lit(day))
    return choice


def year_quarter(column: Column) -> Column:
    """``yyyy-q``; a null date gives the text ``NA-NA``."""
    return glue("-", F.year(column), F.quarter(column))


def year_month(column: Column) -> Column:
    """``yyyy-mm``; null stays null."""
    return F.date_format(column, "yyyy-MM")
