"""Planting known faults: the dirty table together with the truth about it.

A fault is a column expression over the row, chosen for given rows or for a seeded share of all rows, so planting is
one projection whatever the size of the table.  Faults are applied in the order given; a later one sees what an
earlier one left in the cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw, picked
from ..functions.numbers import as_number
from ..functions.text import strip

# (cell text, luck) -> new cell text; NULL means the rule cannot apply to this cell.  ``luck`` is a BIGINT drawn for
# this fault and row, the only source of chance a rule may use.
Rewrite = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class FaultRule:
    """How a cell is spoilt, and what the truth says about it.  ``{col}`` in the description is the column name."""

    rewrite: Rewrite
    issue_type: str
    difficulty: float = 1.0
    description: str = "{col} changed"


# Texts that stand in for a number.
NOT_NUMBERS = ["not-a-number", "N/A", "null", "undefined"]


def _text_for_number(v: Column, luck: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NOT_NUMBERS]), (luck % len(NOT_NUMBERS) + 1).cast("int"))


def _negative(v: Column, luck: Column) -> Column:
    """Minus the absolute value; a blank cell becomes -1; text that is no number is left alone."""
    n = as_number(v)
    shown = F.when(n == F.floor(n), F.concat((-F.abs(n)).try_cast("decimal(38,0)").cast("string"), F.lit(".0")))
    decimals = F.regexp_replace((-F.abs(n)).try_cast("decimal(38,10)").cast("string"), "0+$", "")
    # What ten decimals or 38 digits cannot show keeps its own text, with a minus before it.
    signed = F.concat(F.lit("-"), F.regexp_replace(strip(v), "^[+-]", ""))
    shown = F.coalesce(shown, F.when(decimals.rlike("[1-9]"), decimals), signed)
    return F.when(v.isNull() | (v == ""), F.lit("-1")).when(n.isNotNull(), shown)


def _typo(v: Column, luck: Column) -> Column:
    """Drop, double or swap one letter at a drawn place."""
    at = (luck % F.greatest(F.length(v) - 1, F.lit(1)) + 1).cast("int")
    kind = F.floor(luck / 65536) % 3
    pair = F.substring(v, at, F.lit(2))
    a, b = F.left(pair, F.lit(1)), F.substring(pair, 2, 1)
    doubled = F.concat(a, pair)
    made = F.when(kind == 0, b).when((kind == 1) | (a == b), doubled).otherwise(F.concat(b, a))
    return F.when(F.length(v) >= 2, F.concat(F.substring(v, F.lit(1), at - 1), made, F.substring(v, at + 2, F.length(v))))


def _date_layout(layout: str) -> Rewrite:
    return lambda v, luck: F.date_format(F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")), layout)


def _letter_for_digit(v: Column, luck: Column) -> Column:
    return F.when(v.contains("0"), F.translate(v, "0", "O"))


def _extra_decimal(v: Column, luck: Column) -> Column:
    return F.when(v.rlike(r"^[+-]?[0-9]+\.[0-9]{2}$"), F.concat(v, F.lit("9")))


def _flip_flag(v: Column, luck: Column) -> Column:
    return F.when(strip(v) == "0", "1").when(strip(v) == "1", "0")


def scaled(factor: float, places: int = 2) -> Rewrite:
    """Multiply a number, which breaks a sum, a ratio or a range."""
    return lambda v, luck: (as_number(v) * F.lit(factor)).try_cast(f"decimal(38,{places})").cast("string")


def cut_short(share: float) -> Rewrite:
    """Keep only the first part of a text."""
    return lambda v, luck: F.when(
        F.length(v) > 1, F.substring(v, F.lit(1), F.greatest(F.floor(F.length(v) * share).cast("int"), F.lit(1)))
    )


def prefixed(marker: str) -> Rewrite:
    return lambda v, luck: F.concat(F.lit(marker), v)


def constant(value: str) -> Rewrite:
    return lambda v, luck: F.lit(value)


def shifted_time(days: int) -> Rewrite:
    """Move a timestamp text by whole days."""
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return lambda v, luck: F.date_format(
        F.try_to_timestamp(v, F.lit(fmt)) + F.make_interval(days=F.lit(days)), fmt
    )


def renamed_key(old: str, new: str) -> Rewrite:
    return lambda v, luck: F.when(
        v.contains(f'"{old}"'), F.replace(v, F.lit(f'"{old}"'), F.lit(f'"{new}"'))
    )


def dropped_key(key: str) -> Rewrite:
    """Take a key out of a JSON object; the other members keep their types."""
    as_map = lambda v: F.try_parse_json(v).try_cast("map<string,variant>")
    return lambda v, luck: F.when(
        v.contains(f'"{key}"'), F.to_json(F.map_filter(as_map(v), lambda k, x: k != key))
    )


def added_key(key: str, json_value: str) -> Rewrite:
    """Append a member to a JSON object text."""
    member = f'"{key}": {json_value}}}'

    def rewrite(v: Column, luck: Column) -> Column:
        t = strip(v)
        body = F.regexp_replace(t, r"\s*\}$", "")
        glue = F.when(body == "{", F.lit("")).otherwise(F.lit(", "))
        return F.when(t.startswith("{") & t.endswith("}"), F.concat(body, glue, F.lit(member)))

    return rewrite


def retyped_key(key: str, json_value: str) -> Rewrite:
    """Replace the scalar value of a JSON member."""
    pattern = rf'("{key}"\s*:\s*)("[^"]*"|[-+0-9.eE]+|true|false|null)'
    return lambda v, luck: F.when(
        v.rlike(pattern), F.regexp_replace(v, pattern, "$1" + json_value.replace("\\", "\\\\").replace("$", "\\$"))
    )


RULES: dict[str, FaultRule] = {
    "missing_value": FaultRule(lambda v, luck: F.lit(""), "missing_value", 1.0, "Empty {col} field"),
    "whitespace_value": FaultRule(lambda v, luck: F.lit(" "), "missing_value", 2.5, "Whitespace-only {col} field"),
    "wrong_type_text": FaultRule(_text_for_number, "wrong_type", 1.0, "{col} is text instead of expected type"),
    "negative_value": FaultRule(_negative, "out_of_range", 1.0, "Negative {col}"),
    "typo": FaultRule(_typo, "format_violation", 1.0, "{col} is misspelled"),
    "date_us": FaultRule(_date_layout("MM-dd-yyyy"), "format_violation", 1.5, "{col} is in MM-DD-YYYY layout"),
    "date_slashed": FaultRule(_date_layout("dd/MM/yyyy"), "format_violation", 1.5, "{col} is in DD/MM/YYYY layout"),
    "letter_for_digit": FaultRule(_letter_for_digit, "wrong_type", 1.5, "{col} has a letter for a digit"),
    "extra_decimal": FaultRule(_extra_decimal, "format_violation", 1.5, "{col} has too many decimals"),
    "flip_flag": FaultRule(_flip_flag, "inconsistent_value", 2.0, "{col} label flipped"),
    "doubled": FaultRule(scaled(2.0), "inconsistent_value", 2.0, "{col} does not add up"),
    "cut_short": FaultRule(cut_short(0.5), "missing_value", 2.5, "{col} is cut short"),
}


def register_contamination_rule(
    name: str, rewrite: Rewrite, issue_type: str, difficulty: float = 1.0, description: str = "{col} changed"
) -> None:
    """Add a named rule.  ``rewrite`` returns a Column; wrap Python code in a ``pandas_udf`` to use it here."""
    RULES[name] = FaultRule(rewrite, issue_type, difficulty, description)


@dataclass(frozen=True)
class Fault:
    """One planting order: a rule, a column, and which rows: ``rows`` (ids), ``rate`` (share) or ``where``."""

    rule: str | FaultRule | Rewrite
    col: str
    rows: tuple[int, ...] = ()
    rate: float | None = None
    where: Column | None = None
    difficulty: float | None = None
    issue_type: str | None = None
    description: str | None = None

    def resolve(self) -> FaultRule:
        if isinstance(self.rule, FaultRule):
            return self.rule
        if callable(self.rule):
            return FaultRule(self.rule, self.issue_type or "inconsistent_value")
        if self.rule not in RULES:
            raise ValueError(f"Unknown contamination rule: {self.rule}. Available: {list(RULES)}")
        return RULES[self.rule]


def contaminate(
    df: DataFrame, faults: list[Fault], row_id: str = "row_id", dataset: str | Column = "data", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Return ``(dirty, truth)``.

    Columns that get a fault become text.  Both results are projections of ``df``: nothing is shuffled, and the
    truth is read off the same expressions that spoil the cells.
    """
    row = F.col(row_id).cast("bigint")
    name = dataset if isinstance(dataset, Column) else F.lit(dataset)
    touched = list(dict.fromkeys(f.col for f in faults))
    work = df.select(
        *[F.col(c).cast("string").alias(c) if c in touched else F.col(c) for c in df.columns],
        *[F.col(c).cast("string").alias(f"__clean_{c}") for c in touched],
    )
    marks = []
    for i, fault in enumerate(faults):
        rule = fault.resolve()
        chosen = F.lit(True)
        if fault.rows:
            chosen = row.isin(list(fault.rows))
        elif fault.rate is not None:
            chosen = picked(row, f"{i}:{fault.col}", fault.rate, seed)
        if fault.where is not None:
            chosen = chosen & fault.where
        new, luck, hit = f"__new_{i}", f"__luck_{i}", f"__hit_{i}"
        made = rule.rewrite(F.col(fault.col), F.col(luck))
        # Choice, draw, new value and cell are computed once each, one projection upon the other; where the rule cannot apply
        # the new value is NULL and the cell keeps what it has.
        work = (
            work.withColumn(hit, chosen)
            .withColumn(luck, F.when(F.col(hit), draw(row, f"value:{i}:{fault.col}", seed)))
            .withColumn(new, F.when(F.col(hit), made))
            .withColumn(fault.col, F.coalesce(F.col(new), F.col(fault.col)))
        )
        difficulty = rule.difficulty if fault.difficulty is None else fault.difficulty
        description = (fault.description or rule.description).replace("{col}", fault.col)
        marks.append(
            F.when(
                F.col(new).isNotNull(),
                F.struct(
                    F.lit(fault.col).alias("col"), F.lit(fault.issue_type or rule.issue_type).alias("issue_type"),
                    F.lit(description).alias("description"), F.lit(float(difficulty)).alias("difficulty"),
                    strip(F.col(f"__clean_{fault.col}")).alias("clean_value"), F.lit(i).alias("seq"),
                ),
            )
        )
    dirty = work.select(*df.columns)
    truth = (
        work.select(name.alias("dataset"), row.alias("row_id"), F.explode(F.array(*marks)).alias("m"))
        .where("m IS NOT NULL").select("dataset", "row_id", "m.*")
    )
    return dirty, truth


def append_copies(
    df: DataFrame, key_col: str, row_id: str = "row_id", rate: float | None = None, rows: tuple[int, ...] = (),
    dataset: str = "data", seed: int = 42, difficulty: float = 1.5, first_id: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Append exact copies of some rows under new ids; the truth names the key column and has no clean cell."""
    row = F.col(row_id).cast("bigint")
    chosen = row.isin(list(rows)) if rows else picked(row, "copy", rate or 0.0, seed)
    if first_id is None:
        first_id = (df.agg(F.max(row)).first()[0] or 0) + 1
    new_id = row + F.lit(first_id)
    if len(rows) == 1:
        new_id = F.lit(first_id).cast("bigint")
    copies = df.where(chosen).withColumn("__source", row).withColumn(row_id, new_id.cast(df.schema[row_id].dataType))
    truth = copies.select(
        F.lit(dataset).alias("dataset"), F.col(row_id).cast("bigint").alias("row_id"), F.lit(key_col).alias("col"),
        F.lit("duplicate_row").alias("issue_type"),
        F.concat(F.lit("Exact duplicate of row "), F.col("__source").cast("string")).alias("description"),
        F.lit(float(difficulty)).alias("difficulty"), F.lit(None).cast("string").alias("clean_value"),
        F.lit(0).alias("seq"),
    )
    return df.unionByName(copies.drop("__source")), truth


def copy_from_donor(
    df: DataFrame, col: str, donor_shift: int, row_id: str = "row_id", rate: float | None = None,
    rows: tuple[int, ...] = (), where: Column | None = None, dataset: str = "data", seed: int = 42,
    issue_type: str = "duplicate_row", difficulty: float = 1.5,
) -> tuple[DataFrame, DataFrame]:
    """Overwrite a cell with the cell of the row ``donor_shift`` ids before it (a key, a text, a label).

    Donors are fetched by a join on ids, each of which occurs once; rows without a donor stay as they are.
    """
    row = F.col(row_id).cast("bigint")
    chosen = row.isin(list(rows)) if rows else picked(row, f"donor:{col}", rate or 0.0, seed)
    if where is not None:
        chosen = chosen & where
    wanted = df.where(chosen).select((row - donor_shift).alias("__donor"), row.alias("__row"))
    donors = df.select(row.alias("__donor"), F.col(col).alias("__given"))
    gifts = wanted.join(donors, "__donor").select("__row", "__given", "__donor")
    joined = df.join(gifts, row == F.col("__row"), "left").withColumn(
        "__changed", F.col("__given").isNotNull() & ~F.col("__given").eqNullSafe(F.col(col))
    )
    dirty = joined.select(
        *[F.when(F.col("__changed"), F.col("__given")).otherwise(F.col(c)).alias(c) if c == col else F.col(c)
          for c in df.columns]
    )
    truth = joined.where("__changed").select(
        F.lit(dataset).alias("dataset"), row.alias("row_id"), F.lit(col).alias("col"),
        F.lit(issue_type).alias("issue_type"),
        F.concat(F.lit(f"{col} copied from row "), F.col("__donor").cast("string")).alias("description"),
        F.lit(float(difficulty)).alias("difficulty"), strip(F.col(col).cast("string")).alias("clean_value"),
        F.lit(0).alias("seq"),
    )
    return dirty, truth
