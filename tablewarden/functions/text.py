"""Text helpers. All of them are built-in expressions and treat whitespace the Unicode way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the Latin alphabets that occur in western European text, plus digits.
WORD = "[a-zà-öø-ÿ0-9]+"


# The Unicode blanks.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode blanks (``trim`` alone drops only the ASCII space)."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """True for NULL, the empty string and text of blanks only; never NULL itself."""
    return c.isNull() | (strip(c) == "")


def tokens(c: Column, pattern: str = WORD) -> Column:
    """Lower-cased words in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def casefold_tokens(c: Column, pattern: str = WORD) -> Column:
    """The set of lower-cased words of a text, each once."""
    return F.array_distinct(tokens(c, pattern))


def word_count(c: Column, pattern: str = WORD) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.lower(c), F.lit(pattern))


def hit_count(c: Column, vocabulary: list[str]) -> Column:
    """How many words of a text belong to ``vocabulary``: one pass of a pattern, no array of words is built."""
    letters = WORD.removesuffix("+")
    return F.regexp_count(F.lower(c), F.lit(f"(?<!{letters})(?:{'|'.join(vocabulary)})(?!{letters})"))
