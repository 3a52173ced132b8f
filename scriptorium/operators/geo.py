"""Publications per country: the country rules applied to a whole record table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.countries import country_to_iso
from scriptorium.functions.dates import year_anchored


def publications_by_country(
    records: DataFrame, country_col: str = "affiliation_country", key: str = "doi", date_col: str = "date"
) -> DataFrame:
    """Distinct papers per ISO country and year.

    ``country_col`` is an array of country texts (a paper may list several);
    it is exploded, mapped with the country rules (unknown -> ``""``) and
    counted with a distinct aggregate, so a paper listing two cities of one
    country counts once.  The year is the 4 digits at the start of ``date_col``.
    """
    ex = records.select(
        F.col(key), year_anchored(F.col(date_col)).alias("year"), F.explode(F.col(country_col)).alias("_country")
    )
    iso = ex.select(key, "year", country_to_iso(F.col("_country")).alias("iso"))
    return iso.groupBy("iso", "year").agg(F.countDistinct(key).alias("n_papers"))


def unknown_countries(records: DataFrame, country_col: str = "affiliation_country") -> DataFrame:
    """Country texts no rule recognises, with their number of occurrences."""
    ex = records.select(F.explode(F.col(country_col)).alias("country"))
    return ex.where(country_to_iso(F.col("country")) == "").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
