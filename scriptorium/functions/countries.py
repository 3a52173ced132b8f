"""Country text -> ISO 3166 alpha-3 code, as one CASE expression.

The rules are ordered and case-sensitive: the first rule that matches wins,
so their order carries meaning (frequent countries first, then alphabetical).
A text no rule matches maps to ``""``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (ISO code, test, patterns) in rule order.  "contains" tests
# whether any pattern occurs in the text, "endswith" whether the text ends
# with any pattern.
COUNTRY_RULES = (
    ("CHN", "contains", ("China", "Hunan", "Macao", "Hong Kong")),
    ("USA", "contains", ("USA", "U.S.A", "United States", "Iowa", "North Carolina", "Massachusetts", "Oregon", "Illinois", "Maryland")),
    ("ARE", "endswith", ("UAE", "United Arab Emirates")),
    ("AUS", "endswith", ("Australia",)),
    ("AUT", "endswith", ("Austria",)),
    ("BGD", "endswith", ("Bangladesh",)),
    ("BRA", "endswith", ("Brazil",)),
    ("BEL", "endswith", ("Belgium",)),
    ("CAN", "endswith", ("Canada",)),
    ("COL", "endswith", ("Colombia",)),
    ("CHE", "endswith", ("Switzerland",)),
    ("CZE", "endswith", ("Czech Republic", "Czechia")),
    ("DEU", "endswith", ("Germany",)),
    ("DNK", "endswith", ("Denmark",)),
    ("DZA", "endswith", ("Algeria", "Algérie")),
    ("EST", "endswith", ("Estonia",)),
    ("EGY", "endswith", ("Egypt",)),
    ("ESP", "endswith", ("Spain",)),
    ("FRA", "endswith", ("France",)),
    ("FIN", "endswith", ("Finland",)),
    ("GBR", "endswith", ("UK", "U.K", "United Kingdom", "England", "Scotland", "Wales", "Northern Ireland", "London")),
    ("GRC", "endswith", ("Greece",)),
    ("IND", "endswith", ("India",)),
    ("IND", "contains", ("West Bengal",)),
    ("IRN", "endswith", ("Iran", "Iran,", "Isfahan Iran")),
    ("IRQ", "endswith", ("Iraq",)),
    ("ISL", "endswith", ("Iceland",)),
    ("ISR", "endswith", ("Israel",)),
    ("ITA", "endswith", ("Italy",)),
    ("JPN", "endswith", ("Japan",)),
    ("JOR", "endswith", ("Jordan",)),
    ("KOR", "contains", ("Korea", "Seoul", "Jeonju", "Gwangju")),
    ("LTU", "endswith", ("Lithuania",)),
    ("MEX", "endswith", ("Mexico", "México", "DF")),
    ("MNE", "endswith", ("Montenegro",)),
    ("MYS", "endswith", ("Malaysia",)),
    ("MWI", "endswith", ("Malawi",)),
    ("NLD", "endswith", ("Netherlands",)),
    ("NPL", "endswith", ("Nepal",)),
    ("NOR", "endswith", ("Norway",)),
    ("PAK", "endswith", ("Pakistan",)),
    ("PER", "endswith", ("Peru",)),
    ("POL", "endswith", ("Poland",)),
    ("PRT", "endswith", ("Portugal",)),
    ("RUS", "endswith", ("Russia",)),
    ("SAU", "endswith", ("Saudi Arabia", "Saudia Arabia", "Arabia", "P. O. Box Saudi Arabia")),
    ("SWE", "endswith", ("Sweden",)),
    ("SGP", "endswith", ("Singapore",)),
    ("TUN", "endswith", ("Tunisia",)),
    ("TUR", "endswith", ("Turkey",)),
    ("ZAF", "endswith", ("South Africa", "Durban South Africa")),
)


def _test(c: Column, kind: str, patterns) -> Column:
    conds = [c.contains(p) if kind == "contains" else c.endswith(p) for p in patterns]
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return out


def country_to_iso(c: Column) -> Column:
    """ISO alpha-3 code of a country text; ``""`` when unknown (NULL stays NULL)."""
    expr = None
    for iso, kind, patterns in COUNTRY_RULES:
        cond = _test(c, kind, patterns)
        expr = F.when(cond, F.lit(iso)) if expr is None else expr.when(cond, F.lit(iso))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit("")))
