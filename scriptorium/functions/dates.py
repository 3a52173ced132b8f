"""Date text -> year / ISO date, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_anchored(date: Column) -> Column:
    """Four digits at the very start, else NULL (``2019-05`` -> 2019, ``May 2019`` -> NULL)."""
    return F.nullif(F.regexp_extract(date, r"^([0-9]{4})", 1), F.lit("")).cast("int")


def year_anywhere(date: Column) -> Column:
    """The first four consecutive digits anywhere, else NULL (``May 2019`` -> 2019)."""
    return F.nullif(F.regexp_extract(date, r"([0-9]{4})", 1), F.lit("")).cast("int")


def year_prefix(iso_date: Column) -> Column:
    """Year of an ISO date text (its first four characters); NULL when absent."""
    return F.substring(iso_date, 1, 4).try_cast("int")


def iso_date(value: Column) -> Column:
    """A date or timestamp as ``YYYY-MM-DD`` text; NULL stays NULL."""
    return F.date_format(value, "yyyy-MM-dd")
