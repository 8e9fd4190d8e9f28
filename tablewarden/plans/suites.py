"""Suites: a clean table, the faults planted in it, and the checks that should find them.

A suite is looked up by name in a registry.  Nothing is computed until a caller acts on the tables it returns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contaminate import Fault, contaminate
from ..operators.rules import Rule, run_rules
from ..operators.score import MAX_STEPS

Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ColumnSpec:
    """Declared properties of a column, which compile to checks."""

    name: str
    kind: str = "string"
    nullable: bool = False
    lo: float | None = None
    hi: float | None = None
    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    layout: str | None = None
    unique: bool = False

    def rules(self) -> list[Rule]:
        from ..operators import rules as r

        made = [] if self.nullable else [r.missing_value(self.name)]
        if self.kind in ("int", "float", "bool"):
            made.append(r.wrong_type(self.name, self.kind))
        if self.lo is not None or self.hi is not None:
            made.append(r.out_of_range(self.name, self.lo, self.hi))
        if self.allowed:
            made.append(r.in_set(self.name, self.allowed))
        if self.pattern:
            made.append(r.matches(self.name, self.pattern))
        if self.layout:
            made.append(r.date_format(self.name, self.layout))
        return made

    def detectors(self, dataset: str) -> list[Detector]:
        from ..operators.keyed import duplicate_key

        return [lambda df: duplicate_key(df, [self.name], dataset=dataset)] if self.unique else []


@dataclass
class Suite:
    """A named bundle: ``load`` gives ``(clean, dirty, truth)``, ``detect`` runs all checks on a table."""

    name: str
    load: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]]
    columns: list[ColumnSpec] = field(default_factory=list)
    rules: Callable[[], list[Rule]] = lambda: []
    detectors: list[Detector] = field(default_factory=list)
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    max_steps: int = MAX_STEPS
    description: str = ""

    def detect(self, df: DataFrame) -> DataFrame:
        """All findings: the row-local checks in one scan, the others one aggregate each; one per cell and type."""
        local = [rule for spec in self.columns for rule in spec.rules()] + self.rules()
        found = run_rules(self.prepare(df), local, dataset=self.name) if local else None
        keyed = [d for spec in self.columns for d in spec.detectors(self.name)] + self.detectors
        for detector in keyed:
            part = detector(df)
            found = part if found is None else found.unionByName(part)
        return found.dropDuplicates(["dataset", "row_id", "col", "issue_type"])


SUITES: dict[str, Callable[[], Suite]] = {}


def register_suite(name: str, factory: Callable[[], Suite]) -> None:
    """Make a suite available under a name."""
    SUITES[name] = factory


def get_suite(name: str) -> Suite:
    if name not in SUITES:
        raise ValueError(f"Unknown suite: {name}. Available: {list(SUITES)}")
    return SUITES[name]()


def list_suites() -> list[str]:
    return list(SUITES)


def suite_from_config(config: dict, clean: Callable[[SparkSession], DataFrame]) -> Suite:
    """Build a suite from ``{name, contaminations, columns?, seed?, max_steps?, description?}``.

    A contamination is ``{rule, row, col, difficulty?}`` with a 0-based row and a column number or name, applied in
    order; ``rule`` is a registered name or a function of a Column.  ``rate`` instead of ``row`` picks a share of
    the rows.  The clean table has a 1-based ``row_id``.
    """
    from ..operators.contaminate import RULES

    for spec in config["contaminations"]:
        if not callable(spec["rule"]) and spec["rule"] not in RULES:
            raise ValueError(f"Unknown contamination rule: {spec['rule']}. Available: {list(RULES)}")
    name, seed = config["name"], config.get("seed", 42)

    def load(spark: SparkSession):
        table = clean(spark)
        names = [c for c in table.columns if c != "row_id"]
        faults = [
            Fault(
                s["rule"], names[s["col"]] if isinstance(s["col"], int) else s["col"],
                rows=(s["row"] + 1,) if "row" in s else (), rate=s.get("rate"), difficulty=s.get("difficulty"),
                issue_type=s.get("issue_type"), description=s.get("description"),
            )
            for s in config["contaminations"]
        ]
        dirty, truth = contaminate(table, faults, "row_id", name, seed)
        return table, dirty, truth

    return Suite(name, load, config.get("columns", []), max_steps=config.get("max_steps", MAX_STEPS),
                 description=config.get("description", ""))


def planted(
    clean: DataFrame, dataset: str, cells: list[tuple], copies: tuple[int, str, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply a fixed list ``(row, col, issue_type, difficulty, dirty value, description)``, in order.

    ``copies`` appends a copy of one row: (source row, key column, difficulty).
    """
    from ..operators.contaminate import FaultRule, constant

    faults = [
        Fault(FaultRule(constant(value), kind, weight, text), col, rows=(row,))
        for row, col, kind, weight, value, text in cells
    ]
    dirty, truth = contaminate(clean, faults, "row_id", dataset)
    if copies:
        source, key, weight = copies
        last = clean.agg(F.max("row_id")).first()[0]
        twin = clean.where(F.col("row_id") == source).withColumn("row_id", F.lit(last + 1).cast("bigint"))
        dirty = dirty.unionByName(twin.select(*[F.col(c).cast(dirty.schema[c].dataType).alias(c) for c in dirty.columns]))
        mark = twin.select(
            F.lit(dataset).alias("dataset"), "row_id", F.lit(key).alias("col"), F.lit("duplicate_row").alias("issue_type"),
            F.lit(f"Exact duplicate of row {source}").alias("description"), F.lit(float(weight)).alias("difficulty"),
            F.lit(None).cast("string").alias("clean_value"), F.lit(len(cells)).alias("seq"),
        )
        truth = truth.unionByName(mark)
    return dirty, truth
