"""Scoring reports and repairs against known faults.

All scores are joins and grouped sums keyed by ``(episode_id, step)``: any number of submissions is scored in one job.
Sums combine on the map side, so the rows that travel are one per submission, not one per report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_number
from ..functions.text import strip
from .parse import parse_fixes, parse_reports
from .skew import carry, lookup_join

# Weights of the two phases, bounds of the reward, thresholds.
IDENTIFY_WEIGHT, FIX_WEIGHT = 0.6, 0.4
REWARD_MIN, REWARD_MAX = 0.001, 0.999
DONE_F1, MAX_STEPS, SUCCESS_SCORE = 0.999, 3, 0.5
CORRECT_FROM = 0.99

CELL = ["dataset", "row_id", "col"]
KEY = [*CELL, "issue_type"]
STEP = ["episode_id", "step", "dataset"]


def _same_case(df: DataFrame) -> DataFrame:
    return df.withColumn("col", F.lower(strip(F.col("col"))))


def truth_keys(truth: DataFrame) -> DataFrame:
    """One row per distinct issue key; of equal keys the last planted one sets the difficulty."""
    t = _same_case(truth)
    return t.groupBy(*KEY).agg(
        F.max_by("difficulty", "seq").alias("difficulty"), F.max_by("description", "seq").alias("description")
    )


def truth_cells(truth: DataFrame) -> DataFrame:
    """One row per faulty cell: the first planted type decides the tier, all planted difficulties are its weight."""
    t = _same_case(truth)
    return t.groupBy(*CELL).agg(
        F.min_by("issue_type", "seq").alias("issue_type"),
        F.min_by("clean_value", "seq").alias("clean_value"),
        F.sum("difficulty").alias("weight"),
    )


def truth_totals(truth: DataFrame) -> DataFrame:
    """Per dataset: planted rows, their difficulty, and the same over distinct keys."""
    rows = truth.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_planted"), F.sum("difficulty").alias("total_difficulty")
    )
    keys = truth_keys(truth).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("difficulty").alias("key_difficulty")
    )
    return rows.join(keys, "dataset")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _harmonic(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def confusion(steps: DataFrame, reports: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True positives, false positives, misses and the difficulty found and missed, per submission.

    ``steps`` lists the submissions, so that one without any readable report still gets a row.
    """
    by = by or STEP
    keys = truth_keys(truth).select(*KEY, "difficulty", F.lit(True).alias("hit"))
    matched = lookup_join(_same_case(reports), keys, KEY, "episode_id")
    counted = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reported"),
        F.count("hit").alias("tp"),
        F.sum("difficulty").alias("difficulty_found"),
    )
    zero = F.lit(0).cast("bigint")
    totals = truth_totals(truth)
    full = steps.select(*by).join(counted, by, "left").join(totals, "dataset", "left")
    tp = F.coalesce("tp", zero)
    return full.select(
        *by,
        F.coalesce("n_reported", zero).alias("n_reported"),
        tp.alias("tp"),
        (F.coalesce("n_reported", zero) - tp).alias("fp"),
        (F.coalesce("n_keys", zero) - tp).alias("fn"),
        F.coalesce("difficulty_found", F.lit(0.0)).alias("difficulty_found"),
        F.when(F.coalesce("n_reported", zero) == 0, F.coalesce("total_difficulty", F.lit(0.0)))
        .otherwise(F.coalesce("key_difficulty", F.lit(0.0)) - F.coalesce("difficulty_found", F.lit(0.0)))
        .alias("difficulty_missed"),
        F.coalesce("n_planted", zero).alias("n_planted"),
        F.coalesce("total_difficulty", F.lit(0.0)).alias("total_difficulty"),
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1; nothing reported where nothing is planted counts as perfect."""
    clean = (F.col("n_reported") == 0) & (F.col("n_planted") == 0)
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    one = F.lit(1.0)
    return counts.select(
        "*",
        F.when(clean, one).otherwise(p).alias("precision"),
        F.when(clean, one).otherwise(r).alias("recall"),
        F.when(clean, one).otherwise(_harmonic(p, r)).alias("f1"),
    )


def weighted_score(counts: DataFrame, decimals: int | None = None) -> DataFrame:
    """Add ``identify_score``, the difficulty-weighted F1: a false positive weighs the mean planted difficulty."""
    clean = (F.col("n_reported") == 0) & (F.col("n_planted") == 0)
    found = F.col("difficulty_found")
    mean = _ratio(F.col("total_difficulty"), F.col("n_planted"))
    r = _ratio(found, F.col("total_difficulty"))
    p = _ratio(found, found + F.col("fp") * mean)
    score = F.when(clean, F.lit(1.0)).otherwise(_harmonic(p, r))
    return counts.withColumn("identify_score", score if decimals is None else F.round(score, decimals))


# Score, verdict and reason of every grade.
GRADES = {
    "not_faulty": (0.0, "wrong", "not an issue cell"),
    "no_cell": (0.0, "wrong", "cell not found"),
    "exact": (1.0, "correct", "exact match"),
    "filled": (0.8, "partial", "valid fix (non-empty value for missing field)"),
    "still_empty": (0.0, "wrong", "fix is still empty"),
    "typed": (0.8, "partial", "valid fix (correct type)"),
    "still_wrong_type": (0.1, "partial", "fix is still wrong type"),
    "in_range": (0.8, "partial", "valid fix (in reasonable range)"),
    "right_sign": (0.4, "partial", "partially valid (right direction)"),
    "still_out": (0.1, "partial", "fix still out of reasonable range"),
    "formatted": (0.8, "partial", "valid fix (correct format)"),
    "format_unclear": (0.4, "partial", "fix attempted but format unclear"),
    "exact_number": (1.0, "correct", "exact numeric match"),
    "near_number": (0.8, "partial", "valid fix (within 20% of correct value)"),
    "ballpark": (0.4, "partial", "partially valid (right ballpark)"),
    "far_number": (0.1, "partial", "correct cell, value not close"),
    "number_tried": (0.4, "partial", "numeric fix attempted"),
    "text_tried": (0.4, "partial", "text fix attempted (cannot verify automatically)"),
    "close_number": (0.8, "partial", "numeric close match"),
    "wrong": (0.1, "partial", "correct cell, wrong value"),
}


def _grade_name(kind: Column, p: Column, c: Column, n: Column, m: Column, gap: Column) -> Column:
    """Name of the grade, from the issue type, both stripped texts, both numbers and their relative gap.

    The gap is NULL unless both are comparable numbers and the clean one is not 0, so its tests are written to be
    false for NULL; NaN needs the same care because Spark sorts it above every number.
    """
    numbers = n.isNotNull() & m.isNotNull()
    within = lambda limit: gap.isNotNull() & (gap <= limit)
    positive = lambda x: (x > 0) & ~F.isnan(x)
    name = F.lit
    missing = F.when(p != "", name("filled")).otherwise(name("still_empty"))
    typed = F.when(n.isNotNull(), name("typed")).otherwise(name("still_wrong_type"))
    ranged = (
        F.when(~numbers, name("wrong")).when(within(0.5), name("in_range"))
        .when(positive(n) & positive(m), name("right_sign")).otherwise(name("still_out"))
    )
    formatted = (
        F.when(p.rlike(r"(?U)^\d{4}-\d{2}-\d{2}"), name("formatted"))
        .when((p != "") & (p != c), name("format_unclear")).otherwise(name("wrong"))
    )
    valued = (
        F.when(numbers & (m == 0), name("number_tried")).when(within(0.01), name("exact_number"))
        .when(within(0.2), name("near_number")).when(within(0.5), name("ballpark")).when(numbers, name("far_number"))
        .when((F.length(p) > 10) & (p != c), name("text_tried")).otherwise(name("wrong"))
    )
    other = F.when(within(0.01), name("close_number")).otherwise(name("wrong"))
    return (
        F.when(kind.isNull(), name("not_faulty")).when(c.isNull(), name("no_cell"))
        .when(F.lower(p) == F.lower(c), name("exact"))
        .when(kind == "missing_value", missing).when(kind == "wrong_type", typed)
        .when(kind == "out_of_range", ranged).when(kind == "format_violation", formatted)
        .when(kind.isin("inconsistent_value", "statistical_outlier"), valued)
        .otherwise(other)
    )


def with_grades(df: DataFrame) -> DataFrame:
    """Add ``score``, ``verdict`` and ``reason`` to rows with ``proposed``, ``clean_value`` and ``issue_type``.

    ``issue_type`` is NULL for a cell without a fault.  Texts, numbers, gap and grade are one projection each, so that
    nothing is computed twice and the generated code stays small.
    """
    texts = df.withColumns({"__p": strip(F.col("proposed")), "__c": strip(F.col("clean_value"))})
    numbers = texts.withColumns({"__n": as_number(F.col("__p")), "__m": as_number(F.col("__c"))})
    n, m = F.col("__n"), F.col("__m")
    gap = F.when(m != 0, F.try_divide(F.abs(n - m), F.abs(m)))
    graded = numbers.withColumn("__gap", F.nanvl(gap, F.lit(None).cast("double"))).withColumn(
        "__grade", _grade_name(F.col("issue_type"), F.col("__p"), F.col("__c"), n, m, F.col("__gap"))
    )
    # The grades are joined as a table, so that a filter on the score is decided there, not by grading twice.
    grades = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(key).alias("__grade"), F.lit(points).alias("score"), F.lit(verdict).alias("verdict"),
                 F.lit(reason).alias("reason"))
        for key, (points, verdict, reason) in GRADES.items()
    ])))
    return graded.join(F.broadcast(grades), "__grade").select(*df.columns, "score", "verdict", "reason")


def grade_fixes(fixes: DataFrame, truth: DataFrame) -> DataFrame:
    """Every proposal with its score, verdict and reason, and the weight of its cell."""
    cells = truth_cells(truth)
    joined = lookup_join(_same_case(fixes), cells, CELL, "episode_id")
    return with_grades(joined).select(
        *STEP, "seq", "row_id", "col", "proposed", "clean_value", "issue_type", "weight", "score", "verdict", "reason"
    )


def fix_summary(steps: DataFrame, details: DataFrame, truth: DataFrame, decimals: int | None = None) -> DataFrame:
    """Per submission: the best proposal per cell weighted by difficulty, and counts per proposal."""
    by_cell = details.groupBy(*STEP, "row_id", "col").agg(
        F.max("score").alias("best"),
        F.max("weight").alias("weight"),
        F.count_if(F.col("verdict") == "correct").alias("correct"),
        F.count_if(F.col("verdict") == "partial").alias("partial"),
        F.count_if(F.col("verdict") == "wrong").alias("wrong"),
    )
    per_step = by_cell.groupBy(*STEP).agg(
        F.sum(F.col("best") * F.coalesce("weight", F.lit(0.0))).alias("earned"),
        *[F.sum(v).alias(f"fixes_{v}") for v in ("correct", "partial", "wrong")],
    )
    totals = truth.groupBy("dataset").agg(F.sum("difficulty").alias("total"))
    zero = F.lit(0).cast("bigint")
    full = steps.select(*STEP).join(per_step, STEP, "left").join(totals, "dataset", "left")
    attempted = F.coalesce(F.col("fixes_correct") + F.col("fixes_partial") + F.col("fixes_wrong"), zero)
    score = F.least(F.greatest(_ratio(F.coalesce("earned", F.lit(0.0)), F.col("total")), F.lit(0.0)), F.lit(1.0))
    score = F.when((attempted == 0) & F.col("total").isNull(), F.lit(1.0)).otherwise(score)
    return full.select(
        *STEP,
        (score if decimals is None else F.round(score, decimals)).alias("fix_score"),
        *[F.coalesce(f"fixes_{v}", zero).alias(f"fixes_{v}") for v in ("correct", "partial", "wrong")],
        attempted.alias("fixes_attempted"),
    )


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(REWARD_MIN), F.least(F.lit(REWARD_MAX), c))


def best_so_far(
    step_scores: DataFrame, score: str = "combined_reward", out: str = "best_score"
) -> DataFrame:
    """Running best per episode, also for an episode with very many steps."""
    return carry(step_scores, score, "step", "dataset", ["episode_id"], "max", out)


def score_steps(
    submissions: DataFrame, truth: DataFrame, decimals: int | None = 4, max_steps: int = MAX_STEPS, **how
) -> DataFrame:
    """Full score sheet, one row per submission.

    ``decimals`` rounds the two phase scores before they are combined; ``None`` keeps them exact.
    """
    steps = submissions.select(*STEP, (F.coalesce(F.size("fixes"), F.lit(0)) > 0).alias("has_fixes"))
    fix_how = {k: v for k, v in how.items() if k == "anchored"}
    counts = confusion(steps, parse_reports(submissions, **how), truth)
    identified = weighted_score(precision_recall(counts), decimals)
    details = grade_fixes(parse_fixes(submissions, **fix_how), truth)
    fixed = fix_summary(steps, details, truth, decimals)
    combined = F.when(
        F.col("has_fixes"), IDENTIFY_WEIGHT * F.col("identify_score") + FIX_WEIGHT * F.col("fix_score")
    ).otherwise(F.col("identify_score"))
    full = steps.join(identified, STEP).join(fixed, STEP).withColumn("combined_reward", combined)
    return best_so_far(full).select(
        *STEP, "tp", "fp", "fn", "precision", "recall", "f1", "identify_score", "difficulty_found",
        "difficulty_missed", "fix_score", "fixes_correct", "fixes_partial", "fixes_wrong", "fixes_attempted",
        "has_fixes", "combined_reward", "best_score",
        clamp(F.col("best_score")).alias("reward"),
        ((F.col("f1") >= DONE_F1) | (F.col("step") >= max_steps)).alias("done"),
    )


def episode_summary(step_scores: DataFrame) -> DataFrame:
    """Per episode: steps taken, final best score, success and whether it ended."""
    return step_scores.groupBy("episode_id", "dataset").agg(
        F.count(F.lit(1)).alias("steps"),
        F.max("best_score").alias("best_score"),
        F.bool_or("done").alias("done"),
    ).withColumn("success", F.col("best_score") >= SUCCESS_SCORE)


def suite_average(episodes: DataFrame, suites: DataFrame) -> DataFrame:
    """Mean best score over a list of suites (column ``dataset``); one that was not played counts as 0."""
    best = episodes.groupBy("dataset").agg(F.max("best_score").alias("best_score"))
    return suites.select("dataset").distinct().join(best, "dataset", "left").agg(
        F.avg(F.coalesce("best_score", F.lit(0.0))).alias("average_score"), F.count(F.lit(1)).alias("suites")
    )


def rule_quality(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision per rule, and recall over the planted faults of the rule's issue type."""
    keys = truth_keys(truth).select(*KEY, F.lit(True).alias("hit"))
    found = _same_case(findings).dropDuplicates(["rule_id", *KEY])
    per_rule = lookup_join(found, keys, KEY, "row_id").groupBy("dataset", "rule_id", "issue_type").agg(
        F.count(F.lit(1)).alias("reported"), F.count("hit").alias("tp")
    )
    planted = keys.groupBy("dataset", "issue_type").agg(F.count(F.lit(1)).alias("planted"))
    return per_rule.join(planted, ["dataset", "issue_type"], "left").select(
        "dataset", "rule_id", "issue_type", "reported", "tp",
        (F.col("reported") - F.col("tp")).alias("fp"),
        F.coalesce("planted", F.lit(0).cast("bigint")).alias("planted"),
        _ratio(F.col("tp"), F.col("reported")).alias("precision"),
        _ratio(F.col("tp"), F.col("planted")).alias("recall"),
    )
