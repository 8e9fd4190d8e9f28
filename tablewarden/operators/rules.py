"""Checks that need nothing but the row itself.

Each check builds a :class:`Rule`; :func:`run_rules` turns any number of them into one projection over one scan.
Every numeric test goes through ``as_number`` when the column is text, and a blank cell is only ever reported as a
missing value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_number
from ..functions.text import is_blank, strip


@dataclass(frozen=True)
class Rule:
    """A named condition that is true where the cell is at fault."""

    rule_id: str
    col: str
    issue_type: str
    bad: Column
    observed: Column | None = None
    expected: Column | None = None

    def finding(self) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
        seen = F.col(_q(self.col)) if self.observed is None else self.observed
        return F.when(
            self.bad,
            F.struct(
                F.lit(self.col).alias("col"), F.lit(self.issue_type).alias("issue_type"),
                F.lit(self.rule_id).alias("rule_id"), text(seen).alias("observed"), text(self.expected).alias("expected"),
            ),
        )


def _q(name: str) -> str:
    return name if name.startswith("`") or name.isidentifier() else f"`{name}`"


def _text(col: str) -> Column:
    return F.col(_q(col)).cast("string")


def _given(col: str) -> Column:
    return ~is_blank(_text(col))


def run_rules(
    df: DataFrame, rules: Iterable[Rule], row_id: str = "row_id", dataset: str | Column = "data"
) -> DataFrame:
    """All findings of ``rules`` in one pass: no shuffle, columns that no rule names are not read."""
    name = dataset if isinstance(dataset, Column) else F.lit(dataset)
    found = [r.finding() for r in rules]
    if not found:
        raise ValueError("no rules given")
    return (
        df.select(
            name.alias("dataset"), F.col(_q(row_id)).cast("bigint").alias("row_id"), F.explode(F.array(*found)).alias("f")
        )
        .where("f IS NOT NULL")
        .select("dataset", "row_id", "f.*")
    )


def missing_value(col: str, issue_type: str = "missing_value") -> Rule:
    return Rule(f"missing_value:{col}", col, issue_type, is_blank(_text(col)))


# Spellings of a boolean.
BOOLEANS = ["true", "false"]


def wrong_type(col: str, kind: str, issue_type: str = "wrong_type") -> Rule:
    """Text that is not of the declared kind: int, float, bool or date."""
    t = strip(_text(col))
    tests: dict[str, Column] = {
        "int": as_number(t).isNull() | ~t.rlike(r"^[+-]?[0-9]+(\.0*)?$"),
        "float": as_number(t).isNull(),
        "bool": ~F.lower(t).isin(BOOLEANS),
        "date": F.try_to_date(t, "yyyy-MM-dd").isNull(),
    }
    return Rule(f"wrong_type:{col}", col, issue_type, _given(col) & tests[kind], expected=F.lit(kind))


def out_of_range(
    col: str, lo: float | None = None, hi: float | None = None, issue_type: str = "out_of_range"
) -> Rule:
    """Numbers outside inclusive bounds; either side may be open."""
    x = as_number(_text(col))
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (x < F.lit(float(lo)))
    if hi is not None:
        bad = bad | (x > F.lit(float(hi)))
    bound = f"[{'' if lo is None else lo},{'' if hi is None else hi}]"
    return Rule(f"out_of_range:{col}", col, issue_type, x.isNotNull() & ~F.isnan(x) & bad, expected=F.lit(bound))


def numeric_out_of_range(
    col: str, lo: float | None = None, hi: float | None = None, issue_type: str = "out_of_range"
) -> Rule:
    """The same for a column of a numeric type: a bare comparison, which the parquet reader can use."""
    x = F.col(_q(col))
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (x < F.lit(lo))
    if hi is not None:
        bad = bad | (x > F.lit(hi))
    bound = f"[{'' if lo is None else lo},{'' if hi is None else hi}]"
    return Rule(f"out_of_range:{col}", col, issue_type, bad, expected=F.lit(bound))


def score_range(cols: Iterable[str], lo: float = 0, hi: float = 4) -> list[Rule]:
    return [out_of_range(c, lo, hi) for c in cols]


def in_set(col: str, allowed: Iterable, issue_type: str = "format_violation", ignore_case: bool = False) -> Rule:
    values = [str(v) for v in allowed]
    t = strip(_text(col))
    hit = F.lower(t).isin([v.lower() for v in values]) if ignore_case else t.isin(values)
    return Rule(f"in_set:{col}", col, issue_type, _given(col) & ~hit)


def binary_labels(cols: Iterable[str], issue_type: str = "out_of_range") -> list[Rule]:
    return [in_set(c, ["0", "1"], issue_type) for c in cols]


def matches(col: str, pattern: str, issue_type: str = "format_violation") -> Rule:
    return Rule(f"matches:{col}", col, issue_type, _given(col) & ~_text(col).rlike(pattern), expected=F.lit(pattern))


# Shapes of the supported date layouts.
DATE_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "MM-dd-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
}


def _parse_date(t: Column, layout: str) -> Column:
    parsed = F.try_to_timestamp(t, F.lit(layout))
    return F.when(t.rlike(DATE_SHAPES[layout]), parsed) if layout in DATE_SHAPES else parsed


def date_format(col: str, layout: str = "yyyy-MM-dd", issue_type: str = "format_violation") -> Rule:
    """Text that is not a real date in the declared layout."""
    t = strip(_text(col))
    return Rule(
        f"date_format:{col}", col, issue_type, _given(col) & _parse_date(t, layout).isNull(), expected=F.lit(layout)
    )


def date_range(col: str, lo: str, hi: str, layout: str = "yyyy-MM-dd", issue_type: str = "out_of_range") -> Rule:
    d = _parse_date(strip(_text(col)), layout)
    bad = (d < F.lit(lo).cast("timestamp")) | (d > F.lit(hi).cast("timestamp"))
    return Rule(f"date_range:{col}", col, issue_type, bad, expected=F.lit(f"[{lo},{hi}]"))


def max_decimals(col: str, places: int = 2, issue_type: str = "format_violation") -> Rule:
    t = strip(_text(col))
    return Rule(
        f"max_decimals:{col}", col, issue_type, t.rlike(rf"^[+-]?[0-9]*\.[0-9]{{{places + 1},}}$"),
        expected=F.lit(f"at most {places} decimals"),
    )


def nearest_word(c: Column, words: Iterable[str], max_distance: int = 2) -> Column:
    """Closest word within ``max_distance`` edits, ties to the smaller word; NULL when none is near or equal.

    The words are inlined; for a dictionary of thousands ``spelling.misspelling_against`` plans better and answers alike.
    """
    listed = sorted(set(words))
    if not listed:
        return F.lit(None).cast("string")
    ranked = [
        F.when(
            F.levenshtein(c, F.lit(w), max_distance) >= 1,
            F.struct(F.levenshtein(c, F.lit(w), max_distance).alias("distance"), F.lit(w).alias("word")),
        )
        for w in listed
    ]
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    return F.when(~c.isin(listed), best["word"])


def misspelling(col: str, words: Iterable[str], max_distance: int = 2, issue_type: str = "format_violation") -> Rule:
    """Near miss of one of a few known values (an enum); evaluated in the row, without a join."""
    near = nearest_word(strip(_text(col)), words, max_distance)
    return Rule(f"misspelling:{col}", col, issue_type, _given(col) & near.isNotNull(), expected=near)


def row_expression(
    col: str, expected: Column, tolerance: float = 0.0, actual: Column | None = None,
    issue_type: str = "inconsistent_value",
) -> Rule:
    """A numeric cell that differs from an expression over the row; a NULL operand raises nothing."""
    actual = as_number(_text(col)) if actual is None else actual
    return Rule(
        f"row_expression:{col}", col, issue_type, F.abs(expected - actual) > F.lit(tolerance),
        expected=F.round(expected, 6),
    )


def column_compare(
    col: str, ok: Column, rule_id: str | None = None, issue_type: str = "inconsistent_value"
) -> Rule:
    """A relation between columns that must hold; NULL operands raise nothing."""
    return Rule(rule_id or f"column_compare:{col}", col, issue_type, ~ok)


def derived_match(
    col: str, expected: Column, inputs: Iterable[str] = (), issue_type: str = "inconsistent_value"
) -> Rule:
    """Text that must equal an expression over other cells; skipped while one of those is blank."""
    ready = _given(col)
    for name in inputs:
        ready = ready & _given(name)
    return Rule(f"derived_match:{col}", col, issue_type, ready & (strip(_text(col)) != expected), expected=expected)


def implies(
    condition: Column, consequence: Column, col: str, rule_id: str | None = None,
    issue_type: str = "inconsistent_value",
) -> Rule:
    return Rule(rule_id or f"implies:{col}", col, issue_type, condition & ~consequence)


def label_implication(child: str, parent: str, issue_type: str = "inconsistent_value") -> Rule:
    """``child = 1`` needs ``parent = 1``; the parent label is reported."""
    one = lambda c: as_number(_text(c)) == 1
    return implies(one(child), F.coalesce(one(parent), F.lit(False)), parent, f"implies:{child}:{parent}", issue_type)


def power_of_two(col: str, issue_type: str = "format_violation") -> Rule:
    x = as_number(_text(col))
    n = F.when(x == F.floor(x), x.try_cast("bigint"))
    ok = (n > 0) & (n.bitwiseAND(n - 1) == 0)
    return Rule(f"power_of_two:{col}", col, issue_type, x.isNotNull() & ~F.isnan(x) & ~F.coalesce(ok, F.lit(False)))


def context_bound(
    col: str, category: str, limits: dict[str, tuple[float | None, float | None]],
    issue_type: str = "statistical_outlier",
) -> Rule:
    """Bounds that depend on a category, given as a small table; see ``statistics.context_bound`` for a large one."""
    x, key = as_number(_text(col)), strip(_text(category))
    bad = F.lit(False)
    for name, (lo, hi) in limits.items():
        outside = F.lit(False)
        if lo is not None:
            outside = outside | (x < F.lit(float(lo)))
        if hi is not None:
            outside = outside | (x > F.lit(float(hi)))
        bad = bad | ((key == F.lit(name)) & outside)
    return Rule(f"context_bound:{col}", col, issue_type, bad & ~F.isnan(x))


# Named builders, so that users can add their own under a name.
CHECKS: dict[str, Callable[..., Rule | list[Rule]]] = {
    "missing_value": missing_value, "wrong_type": wrong_type, "out_of_range": out_of_range, "in_set": in_set,
    "numeric_out_of_range": numeric_out_of_range, "score_range": score_range, "binary_labels": binary_labels,
    "matches": matches, "date_format": date_format, "date_range": date_range, "max_decimals": max_decimals,
    "misspelling": misspelling, "row_expression": row_expression, "column_compare": column_compare,
    "derived_match": derived_match, "implies": implies, "label_implication": label_implication,
    "power_of_two": power_of_two, "context_bound": context_bound,
}


def register_check(name: str, builder: Callable[..., Rule | list[Rule]]) -> None:
    """Add a named check; the builder returns one :class:`Rule` or a list of them."""
    CHECKS[name] = builder


def build_check(name: str, *args, **kwargs) -> list[Rule]:
    if name not in CHECKS:
        raise ValueError(f"Unknown check: {name}. Available: {sorted(CHECKS)}")
    made = CHECKS[name](*args, **kwargs)
    return list(made) if isinstance(made, (list, tuple)) else [made]
