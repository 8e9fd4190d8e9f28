"""The single gate through which text becomes a number, and the repairs that need it.

Spark's own casts read ``12d`` and ``1.5f`` as numbers and refuse ``1_000``; under ANSI mode they also throw.  The
gate checks the shape first, so that every operator agrees on what a number is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANKS, strip

# The accepted spellings of a number, as anchored patterns.
_DIGITS = "[0-9]+(_[0-9]+)*"
FINITE = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
_PADDED = rf"(?U)^\s*{FINITE[1:-1]}\s*$"
_SPECIAL = r"(?iU)^\s*[+-]?(inf|infinity|nan)\s*$"
_SKIPPED = "_" + BLANKS  # digit separators, and the blanks that may surround a number

# Number words and what they stand for.
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}


def as_number(c: Column) -> Column:
    """DOUBLE value of a text cell, or NULL when the text is not a number."""
    special = (
        F.when(c.ilike("%nan%"), F.lit(float("nan")))
        .when(c.contains("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.when(c.rlike(_PADDED), F.translate(c, _SKIPPED, "").try_cast("double")).when(c.rlike(_SPECIAL), special)


def number_of(df: DataFrame, c: Column) -> Column:
    """DOUBLE value of a column of ``df``, text or not; a cell that is no number is NULL and never an error."""
    text = isinstance(df.select(c).schema[0].dataType, (T.StringType, T.CharType, T.VarcharType))
    return as_number(c) if text else c.try_cast("double")


def plain_decimal(c: Column, scale: int = 2) -> Column:
    """Text of a numeric column without exponents: ``1.0E7`` becomes ``10000000.00``; NULL where it has no room."""
    return c.try_cast(f"decimal(38,{scale})").cast("string")


def digits_for_letters(c: Column) -> Column:
    """Undo letter-for-digit slips (``1O`` -> ``10``); NULL when the result is no number or nothing changed."""
    # Look-alike letters and their digits.
    swapped = F.translate(strip(c), "OoIlSB", "001158")
    return F.when(as_number(c).isNull() & swapped.rlike(FINITE), swapped)


def number_from_words(c: Column) -> Column:
    """Whole number spelled out in English (``seventy-five thousand`` -> 75000); NULL for anything else."""
    table = F.create_map(*[F.lit(x) for pair in {**UNITS, **SCALES, "hundred": 100}.items() for x in pair])
    words = F.filter(
        F.split(F.regexp_replace(F.lower(strip(c)), r"[-\s,]+", " "), " "), lambda w: (w != "") & (w != "and")
    )
    values = F.transform(words, lambda w: F.try_element_at(table, w).cast("double"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("group"))

    def add(acc: Column, v: Column) -> Column:
        total, group = acc["total"], acc["group"]
        factor = F.greatest(group, F.lit(1.0))
        return (
            F.when(v >= 1000, F.struct((total + factor * v).alias("total"), F.lit(0.0).alias("group")))
            .when(v == 100, F.struct(total.alias("total"), (factor * v).alias("group")))
            .otherwise(F.struct(total.alias("total"), (group + v).alias("group")))
        )

    # A text of number words may name more than a bigint holds; the fold is in doubles, exact up to 2^53, and such a text is NULL.
    spelled = (F.size(words) > 0) & ~F.exists(values, lambda v: v.isNull())
    whole = F.when(spelled, F.aggregate(values, start, add, lambda acc: acc["total"] + acc["group"]))
    return F.when(whole <= float(2**53), whole.try_cast("bigint"))


def truncate_decimals(c: Column, places: int) -> Column:
    """Cut (not round) a decimal text to ``places`` decimals; NULL when it is no plain decimal or has no room in 38 digits.

    The cut is made on the text, so it does not matter how many decimals there are."""
    plain = F.when(strip(c).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), strip(c))
    return F.regexp_extract(plain, rf"^([+-]?[0-9]+(?:\.[0-9]{{0,{places}}})?)", 1).try_cast(f"decimal(38,{places})")
