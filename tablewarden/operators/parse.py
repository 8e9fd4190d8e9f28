"""Reading reported issues and proposed fixes out of text.

Everything here is a column expression or a projection: no shuffle, one pass over the submissions.  Patterns carry
``(?iUd)``: letters, digits and blanks are Unicode, and only ``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The accepted field spellings.
_FLAGS = "(?iUd)"
ROW = _FLAGS + r"row\s*[:=]\s*(\d+)"
COL = _FLAGS + r"col(?:umn)?\s*[:=]\s*(\w+)"
SHORT_COL = _FLAGS + r"col\s*[:=]\s*(\w+)"
ISSUE = _FLAGS + r"issue\s*[:=]\s*(\w+)"
FIX = _FLAGS + r"fix\s*[:=]\s*(.+?)$"
NUMBERED = r"(?U)^\s*\d+[.)]\s*"
BULLET = r"(?U)^\s*[-*]\s*"
_ROW_COL = _FLAGS + r"row\s*[:=]\s*(\d+)\s*[,;\s]+col(?:umn)?\s*[:=]\s*(\w+)\s*[,;\s]+"
ISSUE_LINE = _ROW_COL + r"issue\s*[:=]\s*(\w+)"
FIX_LINE = _ROW_COL + r"fix\s*[:=]\s*(.+?)$"
_START = r"(?:^|[,;\s])\s*"


def issue_key(row_id: Column, col: Column, issue_type: Column) -> Column:
    """Display form of an issue address."""
    return F.concat(F.lit("row:"), row_id.cast("string"), F.lit(",col:"), col, F.lit(",issue:"), issue_type)


def split_issue_key(key: Column) -> Column:
    """Inverse of :func:`issue_key`."""
    parts = F.split(key, ",", 3)
    return F.struct(
        F.split(F.get(parts, F.lit(0)), ":")[1].try_cast("bigint").alias("row_id"),
        F.substring_index(F.get(parts, F.lit(1)), ":", -1).alias("col"),
        F.substring_index(F.get(parts, F.lit(2)), ":", -1).alias("issue_type"),
    )


def _anchored(pattern: str) -> str:
    return _FLAGS + _START + pattern.removeprefix(_FLAGS)


def parse_issue(raw: Column, short_col_only: bool = False, anchored: bool = False) -> Column:
    """``row:<n>,col:<name>,issue:<type>`` in any order and spacing -> struct, or NULL when a part is missing.

    ``short_col_only`` refuses the spelling ``column:``; ``anchored`` wants each field at the start of a part, so
    that ``arrow:3`` is not taken for a row.
    """
    f = _issue_fields(F.lower(strip(raw)), short_col_only, anchored)
    return F.when(f["row_id"].isNotNull() & (f["col"] != "") & (f["issue_type"] != ""), f)


def _issue_fields(text: Column, short_col_only: bool = False, anchored: bool = False) -> Column:
    fix = _anchored if anchored else (lambda p: p)
    return F.struct(
        F.regexp_extract(text, fix(ROW), 1).try_cast("bigint").alias("row_id"),
        F.regexp_extract(text, fix(SHORT_COL if short_col_only else COL), 1).alias("col"),
        F.regexp_extract(text, fix(ISSUE), 1).alias("issue_type"),
    )


def reported_issues(issues: Column, **how) -> Column:
    """Distinct readable issues of a list, in order, as :func:`parse_issue` reads them.

    Texts, fields and the verdict on them are one array each: an expression over array elements is worked out anew wherever it is
    named, so every pattern is named once.
    """
    texts = F.transform(issues, lambda raw: F.lower(strip(raw)))
    fields = F.transform(texts, lambda t: _issue_fields(t, **how))
    return F.array_distinct(F.filter(fields, lambda f: f["row_id"].isNotNull() & (f["col"] != "") & (f["issue_type"] != "")))


def parse_fix(raw: Column, anchored: bool = False) -> Column:
    """``row:<n>,col:<name>,fix:<value>`` -> struct; the value keeps its case. NULL when a part is missing."""
    text = strip(raw)
    fix = _anchored if anchored else (lambda p: p)
    row = F.regexp_extract(text, fix(ROW), 1).try_cast("bigint")
    col = F.lower(F.regexp_extract(text, fix(COL), 1))
    found = text.rlike(fix(FIX))
    value = strip(F.regexp_extract(text, fix(FIX), 1))
    return F.when(
        row.isNotNull() & (col != "") & found,
        F.struct(row.alias("row_id"), col.alias("col"), value.alias("proposed")),
    )


def proposed_fixes(fixes: Column, anchored: bool = False) -> Column:
    """Readable fixes of a list with their place ``seq``, as :func:`parse_fix` reads them but for the blanks around ``proposed``; every
    pattern is named once, as in :func:`reported_issues`.  The value of a fix has a character at least, so an empty one is no match."""
    fix = _anchored if anchored else (lambda p: p)
    fields = F.transform(F.transform(fixes, strip), lambda t, i: F.struct(
        i.alias("seq"), F.regexp_extract(t, fix(ROW), 1).try_cast("bigint").alias("row_id"),
        F.lower(F.regexp_extract(t, fix(COL), 1)).alias("col"), F.regexp_extract(t, fix(FIX), 1).alias("proposed")))
    return F.filter(fields, lambda f: f["row_id"].isNotNull() & (f["col"] != "") & (f["proposed"] != ""))


def _lines(text: Column) -> Column:
    marks = F.transform(
        F.split(text, "\n"),
        lambda s: strip(F.regexp_replace(F.regexp_replace(strip(s), NUMBERED, ""), BULLET, "")),
    )
    return F.filter(marks, lambda s: s != "")


def parse_issue_lines(text: Column) -> Column:
    """Issues found in free text, one per line, list marks dropped; repeats are kept.  ARRAY of structs."""
    parsed = F.transform(
        _lines(text),
        lambda s: F.when(
            s.rlike(ISSUE_LINE),
            F.struct(
                F.regexp_extract(s, ISSUE_LINE, 1).try_cast("bigint").alias("row_id"),
                F.lower(F.regexp_extract(s, ISSUE_LINE, 2)).alias("col"),
                F.lower(F.regexp_extract(s, ISSUE_LINE, 3)).alias("issue_type"),
            ),
        ),
    )
    return F.filter(parsed, lambda p: p["row_id"].isNotNull())


def parse_fix_lines(text: Column) -> Column:
    """Fixes found in free text, one per line.  ARRAY of structs."""
    parsed = F.transform(
        _lines(text),
        lambda s: F.when(
            s.rlike(FIX_LINE),
            F.struct(
                F.regexp_extract(s, FIX_LINE, 1).try_cast("bigint").alias("row_id"),
                F.lower(F.regexp_extract(s, FIX_LINE, 2)).alias("col"),
                strip(F.regexp_extract(s, FIX_LINE, 3)).alias("proposed"),
            ),
        ),
    )
    return F.filter(parsed, lambda p: p["row_id"].isNotNull())


KEYS = ["episode_id", "step", "dataset"]


def parse_reports(submissions: DataFrame, **how) -> DataFrame:
    """Distinct reported issues per submission.

    A submission is one row, so repeats are dropped inside its array before it is exploded; nothing is shuffled.
    """
    return submissions.select(*KEYS, F.explode(reported_issues(F.col("issues"), **how)).alias("r")).select(*KEYS, "r.*")


def parse_fixes(submissions: DataFrame, **how) -> DataFrame:
    """Parsed proposals in submission order; ``seq`` is the place in the submitted list."""
    listed = submissions.select(*KEYS, F.explode(proposed_fixes(F.col("fixes"), **how)).alias("f"))
    return listed.select(*KEYS, "f.seq", "f.row_id", "f.col", strip(F.col("f.proposed")).alias("proposed"))


def parse_errors(submissions: DataFrame, **how) -> DataFrame:
    """Every submitted string that could not be read, with its kind and place."""
    fix_how = {k: v for k, v in how.items() if k == "anchored"}
    both = F.concat(
        F.transform("issues", lambda raw, i: F.struct(
            F.lit("issue").alias("kind"), i.alias("seq"), raw.alias("raw"), parse_issue(raw, **how).isNull().alias("bad"))),
        F.transform("fixes", lambda raw, i: F.struct(
            F.lit("fix").alias("kind"), i.alias("seq"), raw.alias("raw"), parse_fix(raw, **fix_how).isNull().alias("bad"))),
    )
    return submissions.select(*KEYS, F.explode(both).alias("e")).where("e.bad").select(
        *KEYS, "e.kind", "e.seq", "e.raw",
        F.concat(F.lit("Could not parse "), F.col("e.kind"), F.lit(": '"), F.col("e.raw"), F.lit("'")).alias("reason"),
    )


__all__ = [
    "issue_key", "parse_errors", "parse_fix", "parse_fix_lines", "parse_fixes", "parse_issue",
    "parse_issue_lines", "parse_reports", "proposed_fixes", "reported_issues", "split_issue_key",
]
