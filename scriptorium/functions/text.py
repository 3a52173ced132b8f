"""String column expressions shared by the section and segment jobs.

Python-style semantics (``str.strip``, ``\\w``, ``str.isupper``) are written
with explicit Unicode classes so that Java regex and RE2 (the SQL oracle)
agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it (tab..CR, NEL, separators),
# and a word character (letter, number, underscore).
WS_CLASS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
NON_WS_RUN = r"[^\t\n\x0B\f\r\x{85}\p{Z}]+"
STRIP_PATTERN = rf"^{WS_CLASS}+|{WS_CLASS}+$"
NON_WORD = r"[^\p{L}\p{N}_]"
# Fixed value: word characters that the near-duplicate rule of sections compares where asked to
# (the default compares whole texts).
WORD_KEY_LEN = 100


def strip(c: Column) -> Column:
    """White space removed at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def split_ws(c: Column) -> Column:
    """Words of a text: its maximal runs of non-white-space characters.

    (``regexp_extract_all`` compiles its pattern once; ``split`` with a regex
    recompiles it for every row.)
    """
    return F.regexp_extract_all(c, F.lit(NON_WS_RUN), 0)


def word_key(c: Column, n: int | None = None) -> Column:
    """The word characters of a text (everything else removed), the first ``n`` only if given."""
    words = F.regexp_replace(c, NON_WORD, "")
    return words if n is None else F.substring(words, 1, n)


def is_upper(c: Column) -> Column:
    """All cased characters upper case and at least one cased character."""
    return (c == F.upper(c)) & (c != F.lower(c))


def leading_upper_words(title: Column) -> Column:
    """The leading run of upper-case words of a stripped title, joined by one space."""
    words = split_ws(title)
    first_lower = F.array_position(F.transform(words, lambda w: is_upper(w)), F.lit(False))
    n = F.when(first_lower == 0, F.size(words)).otherwise(first_lower - 1)
    return F.array_join(F.slice(words, 1, n.cast("int")), " ")


def first_word(title: Column) -> Column:
    """First word of a title; NULL when it has none."""
    return F.try_element_at(split_ws(title), F.lit(1))


# Values of the roman digits.
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_to_int(c: Column) -> Column:
    """Subtractive roman numeral (any case) -> int; ``''`` -> 0.

    A right-to-left fold: a digit smaller than the one after it is subtracted.
    """
    digits = F.create_map(*[x for k, v in ROMAN_VALUES.items() for x in (F.lit(k), F.lit(v))])
    chars = F.reverse(F.split(F.lower(c), ""))
    chars = F.filter(chars, lambda ch: ch != "")
    init = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))

    def step(acc, ch):
        v = F.element_at(digits, ch)
        return F.struct(
            F.when(v < acc["prev"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"),
            v.alias("prev"),
        )

    return F.aggregate(chars, init, step, lambda acc: acc["total"])


def _roman_digits(one: str, five: str, ten: str) -> list[str]:
    """Numerals of 0..9 in one decimal place (rule: 1-3 repeats, subtractive 4
    and 9, 5-8 after the five-digit)."""
    return ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]


# The digit letters of hundreds, tens and ones.
_ROMAN_PLACES = (("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X"))


def int_to_roman(n: Column) -> Column:
    """Positive int (< 4000) -> upper-case roman numeral (one lookup per place)."""
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for place, (one, five, ten) in zip((100, 10, 1), _ROMAN_PLACES, strict=True):
        table = F.array(*[F.lit(x) for x in _roman_digits(one, five, ten)])
        parts.append(F.element_at(table, (F.floor(n / place) % 10 + 1).cast("int")))
    return F.concat(*parts)


def underline(title: Column, ch: str = "-") -> Column:
    """``title`` + newline + as many ``ch`` as the title has characters."""
    return F.concat(title, F.lit("\n"), F.repeat(F.lit(ch), F.length(title)))
