"""Scalar column expressions: text, numbers, dates, seeded hashing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal numerals, with single underscores allowed between digits, and the names of
# the values that are no numerals.
_DIGITS = r"[0-9](_?[0-9])*"
_NUMERAL = rf"[+-]?({_DIGITS}([.]({_DIGITS})?)?|[.]{_DIGITS})([eE][+-]?{_DIGITS})?"
_NUMBER = rf"^({_NUMERAL}|(?i:[+-]?nan|[+-]?inf(inity)?))$"
_PLAIN = "0123456789+-.eE"
_BLANKS = " \t\n\r\f\v"


def strip_whitespace(text: Column) -> Column:
    """Drop blanks of every kind at both ends (``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(_BLANKS))


def to_number(text: Column) -> Column:
    """Number written in ``text``, or NULL: ``'<5'``, ``'1.5d'`` and ``'0x10'`` are no numbers."""
    text = strip_whitespace(text.cast("string"))
    special = F.when(F.lower(text).endswith("nan"), F.lit(float("nan"))).otherwise(
        F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    )
    return (
        # Nearly every value, without a pattern match.
        F.when(F.translate(text, _PLAIN, "") == "", text.try_cast("double"))
        .when(text.rlike(_NUMBER), special)
    )


def age_number(age: Column, highest: int = 1321) -> Column:
    """Age as an integer no greater than ``highest``; 0 where the text is not all digits."""
    digits = F.regexp_replace(age.cast("string"), "^0+(?=[0-9])", "")
    return (
        F.when(digits.isNull() | ~digits.rlike("^[0-9]+$"), F.lit(0))
        .when(F.length(digits) > 9, F.lit(highest))
        .otherwise(F.least(digits.try_cast("int"), F.lit(highest)))
    )


def years_before(day: Column, years) -> Column:
    """The date ``years`` years earlier; 29 February becomes 28 February."""
    years = years if isinstance(years, Column) else F.lit(years)
    return F.add_months(day, years * F.lit(-12))


def calendar_years(first: Column, last: Column) -> Column:
    """Number of New Year's Days between two dates."""
    return F.year(last) - F.year(first)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def is_positive(prob: Column, threshold: float = 0.5) -> Column:
    """1 where the probability is strictly above the threshold."""
    return (prob > F.lit(threshold)).cast("int")


def event_kind(code: Column) -> Column:
    """``DX`` for a diagnosis code, else ``LAB/VITAL``."""
    return F.when(code.startswith("DX:"), F.lit("DX")).otherwise(F.lit("LAB/VITAL"))


def seeded_key(identifier: Column, seed: int) -> Column:
    """Sort key that shuffles identifiers the same way on any partitioning; ties cannot occur."""
    identifier = identifier.cast("string")
    digest = F.md5(F.concat(identifier, F.lit(f":{seed}")))
    return F.concat(digest, F.lit(":"), identifier)


def hashed_integer(*parts: Column) -> Column:
    """Integer in [0, 2^32) drawn from the md5 of the parts joined by ``:``."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashed_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends on the parts alone."""
    return hashed_integer(*parts) / F.lit(float(2**32))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
