"""Profiles and outliers.

Group statistics are aggregates that combine on the map side.  Exact quantiles are found without gathering a group:
an approximate sketch brackets each wanted rank, and only the few values inside the bracket are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import number_of
from ..functions.text import is_blank
from .keyed import to_findings
from .skew import lookup_join

SKETCH = 10_000  # ranks of the quantile sketch are off by at most 1 in this many
WHOLE = 20 * SKETCH  # below this a bracket could be narrower than the rounding of ranks


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing count and share per column: one aggregate over one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(is_blank(F.col(c).cast("string"))).alias(f"__{i}") for i, c in enumerate(cols)],
    )
    per_col = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"__{i}").alias("n_missing")) for i, c in enumerate(cols)])
    return counted.select("n_rows", F.explode(per_col).alias("m")).select(
        "m.col", "n_rows", "m.n_missing",
        F.coalesce(F.try_divide(F.col("m.n_missing").cast("double"), F.col("n_rows")), F.lit(0.0)).alias("missing_share"),
    )


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column ``q0, q1, ...`` per share.

    The sketch bounds each wanted rank from both sides; values below the bracket are only counted, values inside are
    counted per distinct value and ranked.  A bracket holds about 6 / ``SKETCH`` of its group, however large that is;
    groups of up to ``WHOLE`` rows are ranked whole.
    """
    given = df.where(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    slack = 3.0 / SKETCH
    lows = [F.lit(max(s - slack, 0.0)) for s in shares]
    highs = [F.lit(min(s + slack, 1.0)) for s in shares]
    sketch = given.groupBy("__g").agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", F.array(*lows), SKETCH).alias("__lo"),
        F.percentile_approx("__v", F.array(*highs), SKETCH).alias("__hi"),
    )
    marked = lookup_join(given, sketch, ["__g"], "__v", "inner")
    # One row per value and wanted share it may decide, or a count of how far below the bracket it lies.
    whole = F.col("__n") <= WHOLE
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(s).alias("share"),
            F.when(whole | (F.col("__v") >= F.col("__lo")[i]), F.col("__v")).alias("v"),
            (whole | (F.col("__v") <= F.col("__hi")[i])).alias("keep"),
        ) for i, s in enumerate(shares)
    ])
    counts = (
        marked.select("__g", "__n", F.explode(wanted).alias("w")).where("w.keep")
        .groupBy("__g", "__n", F.col("w.i").alias("i"), F.col("w.share").alias("share"), F.col("w.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upto = Window.partitionBy("__g", "i").orderBy(F.col("v").asc_nulls_first())
    ranked = counts.withColumn("__to", F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    place = (F.col("__n") - 1) * F.col("share")
    low, high = F.floor(place), F.ceil(place)
    holds = lambda rank: (F.col("__to") - F.col("c") <= rank) & (rank < F.col("__to"))
    picked = ranked.where("v IS NOT NULL").groupBy("__g", "i").agg(
        F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"),
        F.max(place - low).alias("t"),
    )
    value_of = lambda i: F.max(F.when(F.col("i") == i, F.col("a") + (F.col("b") - F.col("a")) * F.col("t")))
    return picked.groupBy(F.col("__g").alias(group)).agg(*[value_of(i).alias(f"q{i}") for i in range(len(shares))])


def _flag(df: DataFrame, stats: DataFrame, value: str, bad: Column, row_id: str, group: str, dataset: str,
          report_col: str, rule: str, centre: Column) -> DataFrame:
    found = lookup_join(df, stats, ["__group"], "row_id", "inner").where(bad)
    return to_findings(found, dataset, report_col, "statistical_outlier", f"{rule}:{report_col}",
                       F.col("__value"), F.round(centre, 6))


def _prepared(df: DataFrame, value: Column | str, group: str | None, row_id: str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.select(
        F.col(row_id).cast("bigint").alias("row_id"), number_of(df, v).alias("__value"),
        (F.lit(0) if group is None else F.col(group)).alias("__group"),
    ).where("__value IS NOT NULL AND NOT isnan(__value)")


def outlier_zscore(
    df: DataFrame, value: Column | str, group: str | None = None, k: float = 3.0, row_id: str = "row_id",
    report_col: str | None = None, dataset: str = "data",
) -> DataFrame:
    """Values more than ``k`` sample standard deviations from their group's mean."""
    name = report_col or str(value)
    rows = _prepared(df, value, group, row_id)
    stats = rows.groupBy("__group").agg(F.avg("__value").alias("mean"), F.stddev_samp("__value").alias("sd"))
    bad = F.abs(F.col("__value") - F.col("mean")) > F.lit(k) * F.col("sd")
    return _flag(rows, stats, "__value", bad, row_id, "__group", dataset, name, "outlier_zscore", F.col("mean"))


def outlier_iqr(
    df: DataFrame, value: Column | str, group: str | None = None, k: float = 1.5, row_id: str = "row_id",
    report_col: str | None = None, dataset: str = "data",
) -> DataFrame:
    """Values more than ``k`` interquartile ranges outside the quartiles of their group."""
    name = report_col or str(value)
    rows = _prepared(df, value, group, row_id)
    stats = exact_quantiles(rows, "__group", "__value", [0.25, 0.75])
    spread = F.lit(k) * (F.col("q1") - F.col("q0"))
    bad = (F.col("__value") < F.col("q0") - spread) | (F.col("__value") > F.col("q1") + spread)
    return _flag(rows, stats, "__value", bad, row_id, "__group", dataset, name, "outlier_iqr", F.col("q0"))


def outlier_mad(
    df: DataFrame, value: Column | str, group: str | None = None, k: float = 5.0, row_id: str = "row_id",
    report_col: str | None = None, dataset: str = "data",
) -> DataFrame:
    """Values further than ``k`` median absolute deviations from their group's median."""
    name = report_col or str(value)
    rows = _prepared(df, value, group, row_id)
    median = exact_quantiles(rows, "__group", "__value", [0.5]).withColumnRenamed("q0", "median")
    away = lookup_join(rows, median, ["__group"], "row_id", "inner").withColumn(
        "__away", F.abs(F.col("__value") - F.col("median"))
    )
    mad = exact_quantiles(away, "__group", "__away", [0.5]).withColumnRenamed("q0", "mad")
    stats = median.join(mad, "__group")
    bad = (F.col("mad") > 0) & (F.abs(F.col("__value") - F.col("median")) > F.lit(k) * F.col("mad"))
    return _flag(rows, stats, "__value", bad, row_id, "__group", dataset, name, "outlier_mad", F.col("median"))


OUTLIER_TESTS = {"zscore": outlier_zscore, "iqr": outlier_iqr, "mad": outlier_mad}


def outlier_ratio(
    df: DataFrame, numerator: Column, denominator: Column, report_col: str, test: str = "mad", **how
) -> DataFrame:
    """Outliers of a derived ratio, reported on one of the columns behind it; zero denominators are left out."""
    ratio = F.try_divide(number_of(df, numerator), number_of(df, denominator))
    return OUTLIER_TESTS[test](df, ratio, report_col=report_col, **how)


def context_bound(
    df: DataFrame, col: str, category: str, limits: DataFrame, row_id: str = "row_id", dataset: str = "data"
) -> DataFrame:
    """Values outside the limits of their category. ``limits`` holds ``category, lo, hi``, each category once."""
    rows = df.select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(category).alias("__c"), number_of(df, F.col(col)).alias("__value")
    ).where("__value IS NOT NULL AND __c IS NOT NULL")
    bounds = limits.select(F.col("category").alias("__c"), "lo", "hi")
    found = lookup_join(rows, bounds, ["__c"], "row_id", "inner").where("__value < lo OR __value > hi")
    shown = F.concat(F.lit("["), F.coalesce(F.col("lo").cast("string"), F.lit("")), F.lit(","),
                     F.coalesce(F.col("hi").cast("string"), F.lit("")), F.lit("]"))
    return to_findings(found, dataset, col, "statistical_outlier", f"context_bound:{col}", F.col("__value"), shown)
