"""Checks on source code kept in a text column.  Heuristics on the text; no code is parsed or run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .rules import Rule

# Literals and comments that may hold brackets of their own.
QUOTED = r"'[^'\n]*'|\"[^\"\n]*\""
COMMENT = r"(?m)#.*$|//.*$|--.*$"

# Patterns that speak for a language, each worth one point.
LANGUAGE_HINTS = {
    "python": [r"(?m)^\s*def \w+\(.*\):\s*$", r"(?m)^\s*(import|from) \w+", r"(?m):\s*$", r"\bself\b|\bNone\b|\belif\b"],
    "javascript": [r"\bfunction\b", r"\b(const|let|var) \w+", r"=>|===", r"\bconsole\.\w+|\bdocument\.\w+"],
    "sql": [r"(?i)\bselect\b[\s\S]+\bfrom\b", r"(?i)\b(insert into|create table|group by|order by)\b",
            r"(?i)\b(inner|left) join\b", r"(?i)\bwhere\b"],
    "java": [r"\bpublic (static )?(class|void|int|String)\b", r"\bSystem\.out\b", r"\bnew \w+\(", r"\bprivate \w+"],
    "cpp": [r"#include\s*<", r"\bstd::", r"\bcout\b|\bcin\b", r"\btemplate\s*<"],
    "rust": [r"\bfn \w+", r"\blet mut\b", r"\bimpl\b|\bmatch\b", r"println!"],
    "go": [r"\bfunc \w+\(", r"\bpackage \w+", r":=", r"\bfmt\.\w+"],
}

# Calls that run text as code, and queries glued together from text.
UNSAFE = [r"\beval\s*\(", r"\bexec\s*\(", r"(?i)\"(select|insert|update|delete)\b[^\"]*\"\s*\+", r"os\.system\s*\("]


def bare_code(c: Column) -> Column:
    """Code without quoted text."""
    return F.regexp_replace(c, QUOTED, "")


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def bracket_gaps(c: Column) -> Column:
    """Sum of the differences between opening and closing brackets, per kind."""
    bare = bare_code(c)
    return sum((F.abs(_count(bare, a) - _count(bare, b)) for a, b in ("()", "[]", "{}")), F.lit(0))


def unbalanced_brackets(col: str, issue_type: str = "format_violation") -> Rule:
    gaps = bracket_gaps(F.col(col))
    return Rule(f"unbalanced_brackets:{col}", col, issue_type, gaps > 0, observed=gaps)


OPENING, CLOSING = "([{", ")]}"
HELD = 20  # open brackets in one number of the stack, base three with a leading one


def bracket_nesting(c: Column, comment: str | None = None) -> Column:
    """Struct of ``wrong`` (place, from 1, of the first closing bracket that does not close the last open one; 0 if none) and ``depth`` (brackets
    open there, or at the end).

    Quoted text, and what the pattern ``comment`` matches, hold no brackets.  The code is cut into quotes, comments, brackets and runs
    between them; a fold over these keeps the kinds of the open brackets as a stack, ``HELD`` of them in one number and full numbers in
    an array, so pushing and popping do not depend on the depth but every twentieth time.
    """
    skipped = QUOTED if comment is None else f"{QUOTED}|{comment}"
    cut = F.regexp_extract_all(c, F.lit(rf"(?s)(?-s:{skipped})|[()\[\]{{}}]|[^()\[\]{{}}'\"#/\-]+|."), F.lit(0))
    one, zero, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    start = F.struct(zero.alias("at"), zero.alias("depth"), one.alias("top"), none.alias("full"), zero.alias("wrong"))
    most = 3**HELD

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + F.length(part)
        opens, closes = (F.when(F.length(part) == 1, F.instr(F.lit(kinds), part)).otherwise(0) for kinds in (OPENING, CLOSING))

        def state(depth: Column, top: Column, full: Column, wrong: Column) -> Column:
            return F.struct(at.alias("at"), depth.alias("depth"), top.alias("top"), full.alias("full"), wrong.alias("wrong"))

        grown = s["top"] >= most
        pushed = state(s["depth"] + 1, F.when(grown, 3 + opens - 1).otherwise(s["top"] * 3 + opens - 1).cast("bigint"), F.when(grown, F.array_prepend(s["full"], s["top"])).otherwise(s["full"]), s["wrong"])
        right = (s["depth"] > 0) & (s["top"] % 3 == closes - 1)
        spent = (s["top"] < 9) & (F.size(s["full"]) > 0)
        popped = state(s["depth"] - 1, F.when(spent, F.get(s["full"], F.lit(0))).otherwise(F.floor(s["top"] / 3)).cast("bigint"),
                       F.when(spent, F.slice(s["full"], F.lit(2), F.size(s["full"]))).otherwise(s["full"]), s["wrong"])
        stopped = state(s["depth"], s["top"], s["full"], at)
        passed = state(s["depth"], s["top"], s["full"], s["wrong"])
        return F.when(s["wrong"] > 0, s).when(opens > 0, pushed).when((closes > 0) & right, popped).when(closes > 0, stopped).otherwise(passed)

    return F.aggregate(cut, start, step, lambda s: F.struct(s["wrong"].alias("wrong"), s["depth"].alias("depth")))


def misnested_brackets(col: str, comment: str | None = None, issue_type: str = "format_violation") -> Rule:
    """Brackets that close in the wrong order, close nothing, or stay open; observed is ``place:depth`` as in :func:`bracket_nesting`."""
    told = bracket_nesting(F.col(col), comment)
    shown = F.concat_ws(":", told["wrong"].cast("string"), told["depth"].cast("string"))
    return Rule(f"misnested_brackets:{col}", col, issue_type, shown != "0:0", observed=shown)


def truncated_code(col: str, issue_type: str = "format_violation") -> Rule:
    """Code whose last line opens something or ends in an operator, or whose brackets stay open."""
    last = F.substring_index(strip(F.col(col)), "\n", -1)
    bare = bare_code(strip(F.col(col)))
    opens = sum((_count(bare, a) - _count(bare, b) for a, b in ("()", "[]", "{}")), F.lit(0)) > 0
    dangling = last.rlike(r"([-+*/=,(\[{&|]|\b(and|or|not|in|return|if|else|elif|for|while|def)|:)\s*$")
    return Rule(f"truncated_code:{col}", col, issue_type, ~is_blank(F.col(col)) & (dangling | opens),
                observed=F.right(last, F.lit(40)))


def guess_code_language(c: Column, hints: dict[str, list[str]] | None = None, min_points: int = 2) -> Column:
    """Language with the most hints; ties go to the one listed first; NULL below ``min_points``."""
    hints = hints or LANGUAGE_HINTS
    scored = [
        F.struct(sum((F.when(c.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0)).alias("points"),
                 F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
        for i, (lang, patterns) in enumerate(hints.items())
    ]
    best = F.greatest(*scored)
    return F.when(best["points"] >= min_points, best["lang"])


def code_language_mismatch(
    code: str, language: str, report_col: str | None = None, min_points: int = 2,
    hints: dict[str, list[str]] | None = None,
) -> Rule:
    """Code that reads like another language than its label; reported on either column."""
    guess = guess_code_language(F.col(code), hints, min_points)
    name = report_col or code
    return Rule(f"code_language:{name}", name, "inconsistent_value", guess != F.lower(strip(F.col(language))),
                observed=F.col(language), expected=guess)


def unsafe_pattern(code: str, approved: Column | None = None, patterns: list[str] | None = None) -> Rule:
    """Dangerous calls in code; with ``approved`` only where the row claims to be correct."""
    pattern = "|".join(patterns or UNSAFE)
    bad = F.col(code).rlike(pattern)
    return Rule(f"unsafe_pattern:{code}", code, "inconsistent_value", bad if approved is None else bad & approved,
                observed=F.regexp_extract(F.col(code), f"({pattern})", 1))
