"""Dates from texts, and how near two dates are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that are read, in order, and the days over which likeness falls to nothing.
FORMS = ("yyyy-MM-dd", "MMM d, yyyy", "M/d/yy")
SCALE = 30.0


def date_of(text: Column) -> Column:
    """The date that a text gives in the first form that fits it; null for blank texts and for those of no form.

    Years of two digits are those from 2000 on.
    """
    given = F.nullif(F.trim(text), F.lit(""))
    return reduce(lambda a, b: F.coalesce(a, b), [F.try_to_timestamp(given, F.lit(x)).cast("date") for x in FORMS])


def date_text(date: Column) -> Column:
    return F.date_format(date, FORMS[0])


def date_likeness(given: Column, actual: Column) -> Column:
    """1 less the days between over 30, not under 0; null if none is given, 0 if none is there."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.date_diff(actual, given)) / SCALE)
    return F.when(given.isNull(), None).otherwise(F.coalesce(near, F.lit(0.0)))
