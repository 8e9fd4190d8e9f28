"""Catalogue: reading reports, scoring them, and review.

Submissions are derived from the events (one submission per event, the user is the episode), the truth from faults
planted in the customers.  Reports come in several spellings, with repeats and unreadable ones among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plain_decimal
from ..operators import parse, review, rules, score
from ..operators.contaminate import Fault, contaminate
from .base import query, s_money, s_picked, table
from .detect import DIRTY_ORDERS_SQL, ORDER_FAULTS, dirty_orders, order_suite

FAULTS = [
    Fault("missing_value", "c_name", rate=0.2), Fault("whitespace_value", "c_mktsegment", rate=0.2),
    Fault("negative_value", "c_acctbal", rate=0.2, difficulty=1.5),
]


def planted(spark, sf) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf, "customer").withColumn("c_acctbal", plain_decimal(F.col("c_acctbal")))
    return contaminate(customers, FAULTS, "c_custkey", F.concat(F.lit("d"), (F.col("c_custkey") % 25).cast("string")))


def truth_of(spark, sf) -> DataFrame:
    return planted(spark, sf)[1]


def submissions(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    u = F.col("user_id") % 25
    text = lambda c: c.cast("string")
    e = e.select(
        text(F.col("user_id")).alias("episode_id"), (F.col("event_id") + 1).cast("int").alias("step"),
        F.concat(F.lit("d"), text(u)).alias("dataset"), "event_type", "value",
        text(u + 25 * (F.col("k") % 60)).alias("a"),
        text(u + 25 * ((F.col("k") * 7 + F.col("user_id")) % 60)).alias("b"),
        text(u + 25 * ((F.col("k") * 13 + 5) % 60)).alias("c"),
    )
    issues = F.array(
        F.concat(F.lit("row:"), "a", F.lit(",col:c_name,issue:missing_value")),
        F.concat(F.lit("Row = "), "b", F.lit(" ; Col = C_ACCTBAL ; Issue = Out_Of_Range")),
        F.concat(F.lit(" row: "), "c", F.lit(", col: c_mktsegment, issue: missing_value ")),
        F.when(F.col("event_type") == "error", F.concat(F.lit("row "), "a", F.lit(" looks odd")))
        .otherwise(F.concat(F.lit("ROW:"), "a", F.lit(",COLUMN:c_name,ISSUE:Missing_Value"))),
    )
    fixes = F.array(
        F.concat(F.lit("row:"), "b", F.lit(",col:c_acctbal,fix:"), text(F.col("value"))),
        F.concat(F.lit("Row="), "a", F.lit("; Column=C_Name; Fix = customer#"), F.lpad("a", 9, "0")),
        F.concat(F.lit("row:"), "c", F.lit(",col:c_mktsegment,fix:AUTOMOBILE")),
        F.concat(F.lit("row:"), "b", F.lit(",col:c_acctbal,fix:none")),
    )
    none = F.array().cast("array<string>")
    return e.select(
        "episode_id", "step", "dataset", issues.alias("issues"),
        F.when(F.col("event_type").isin("purchase", "click"), fixes)
        .when(F.col("event_type") == "view", F.array(F.lit("nothing to fix"))).otherwise(none).alias("fixes"),
    )


_T = {i: s_picked("c_custkey", f"{i}:{c}", 0.2) for i, c in enumerate(["c_name", "c_mktsegment", "c_acctbal"])}
_D = "'d' || CAST(c_custkey % 25 AS VARCHAR)"
TRUTH = f"""
truth AS (
  SELECT {_D} AS dataset, c_custkey AS row_id, 'c_name' AS col, 'missing_value' AS issue_type, 1.0::DOUBLE AS d, c_name AS clean, 'Empty c_name field' AS descr FROM customer WHERE {_T[0]}
  UNION ALL SELECT {_D}, c_custkey, 'c_mktsegment', 'missing_value', 2.5, c_mktsegment, 'Whitespace-only c_mktsegment field' FROM customer WHERE {_T[1]}
  UNION ALL SELECT {_D}, c_custkey, 'c_acctbal', 'out_of_range', 1.5, {s_money('c_acctbal')}, 'Negative c_acctbal' FROM customer WHERE {_T[2]}),
tot AS (SELECT dataset, count(*) AS n, sum(d) AS w FROM truth GROUP BY 1)"""
SUBS = """
ev AS (SELECT CAST(user_id AS VARCHAR) AS episode_id, CAST(event_id + 1 AS INTEGER) AS step, 'd' || CAST(user_id % 25 AS VARCHAR) AS dataset, event_type, value,
  CAST(user_id % 25 + 25 * (k % 60) AS VARCHAR) AS a, CAST(user_id % 25 + 25 * ((k * 7 + user_id) % 60) AS VARCHAR) AS b,
  CAST(user_id % 25 + 25 * ((k * 13 + 5) % 60) AS VARCHAR) AS c
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
sub AS (SELECT episode_id, step, dataset,
  ['row:' || a || ',col:c_name,issue:missing_value', 'Row = ' || b || ' ; Col = C_ACCTBAL ; Issue = Out_Of_Range',
   ' row: ' || c || ', col: c_mktsegment, issue: missing_value ',
   CASE WHEN event_type = 'error' THEN 'row ' || a || ' looks odd' ELSE 'ROW:' || a || ',COLUMN:c_name,ISSUE:Missing_Value' END] AS issues,
  CASE WHEN event_type IN ('purchase', 'click') THEN ['row:' || b || ',col:c_acctbal,fix:' || CAST(value AS VARCHAR),
     'Row=' || a || '; Column=C_Name; Fix = customer#' || lpad(a, 9, '0'), 'row:' || c || ',col:c_mktsegment,fix:AUTOMOBILE',
     'row:' || b || ',col:c_acctbal,fix:none']
   WHEN event_type = 'view' THEN ['nothing to fix'] ELSE []::VARCHAR[] END AS fixes FROM ev)"""
_RX = {"row": "row\\s*[:=]\\s*(\\d+)", "col": "col(?:umn)?\\s*[:=]\\s*(\\w+)", "issue": "issue\\s*[:=]\\s*(\\w+)", "fix": "(?i)fix\\s*[:=]\\s*(.+?)$"}
REPS = f"""
pi AS (SELECT episode_id, step, dataset, seq, x, regexp_extract(lower(trim(x)), '{_RX['row']}', 1) AS r, regexp_extract(lower(trim(x)), '{_RX['col']}', 1) AS col,
       regexp_extract(lower(trim(x)), '{_RX['issue']}', 1) AS issue_type
       FROM (SELECT *, unnest(issues) AS x, generate_subscripts(issues, 1) - 1 AS seq FROM sub)),
rep AS (SELECT DISTINCT episode_id, step, dataset, CAST(r AS BIGINT) AS row_id, col, issue_type FROM pi WHERE r <> '' AND col <> '' AND issue_type <> '')"""
FIXES = f"""
pf AS (SELECT episode_id, step, dataset, seq, x, regexp_extract(lower(trim(x)), '{_RX['row']}', 1) AS r, regexp_extract(lower(trim(x)), '{_RX['col']}', 1) AS col,
       trim(regexp_extract(trim(x), '{_RX['fix']}', 1)) AS proposed
       FROM (SELECT *, unnest(fixes) AS x, generate_subscripts(fixes, 1) - 1 AS seq FROM sub)),
fx AS (SELECT episode_id, step, dataset, CAST(seq AS INTEGER) AS seq, CAST(r AS BIGINT) AS row_id, col, proposed FROM pf WHERE r <> '' AND col <> '' AND proposed <> ''),
nf AS (SELECT fx.*, t.issue_type, t.clean, t.d, TRY_CAST(proposed AS DOUBLE) AS p, TRY_CAST(clean AS DOUBLE) AS c FROM fx LEFT JOIN truth t USING (dataset, row_id, col)),
gr AS (SELECT *, CASE WHEN issue_type IS NULL THEN 'not an issue cell' WHEN lower(proposed) = lower(clean) THEN 'exact match'
   WHEN issue_type = 'missing_value' THEN 'valid fix (non-empty value for missing field)'
   WHEN p IS NULL OR c IS NULL THEN 'correct cell, wrong value'
   WHEN c <> 0 AND abs(p - c) / abs(c) <= 0.5 THEN 'valid fix (in reasonable range)'
   WHEN p > 0 AND c > 0 THEN 'partially valid (right direction)' ELSE 'fix still out of reasonable range' END AS reason FROM nf),
gd AS (SELECT *, CASE reason WHEN 'not an issue cell' THEN 0.0 WHEN 'exact match' THEN 1.0 WHEN 'correct cell, wrong value' THEN 0.1
   WHEN 'fix still out of reasonable range' THEN 0.1 WHEN 'partially valid (right direction)' THEN 0.4 ELSE 0.8 END::DOUBLE AS score,
   CASE reason WHEN 'not an issue cell' THEN 'wrong' WHEN 'exact match' THEN 'correct' ELSE 'partial' END AS verdict FROM gr)"""
SCORES = f"""
{SUBS}, {REPS}, {TRUTH}, {FIXES},
hit AS (SELECT rep.*, t.d, t.row_id IS NOT NULL AS hit FROM rep LEFT JOIN truth t USING (dataset, row_id, col, issue_type)),
cnt AS (SELECT episode_id, step, count(*) AS reported, count(*) FILTER (hit) AS tp, coalesce(sum(d), 0) AS found FROM hit GROUP BY 1, 2),
cell AS (SELECT episode_id, step, row_id, col, max(score) AS best, max(d) AS d, count(*) FILTER (verdict = 'correct') AS ok,
   count(*) FILTER (verdict = 'partial') AS part, count(*) FILTER (verdict = 'wrong') AS bad FROM gd GROUP BY 1, 2, 3, 4),
fsum AS (SELECT episode_id, step, sum(best * coalesce(d, 0)) AS earned, sum(ok) AS ok, sum(part) AS part, sum(bad) AS bad FROM cell GROUP BY 1, 2),
base AS (SELECT s.episode_id, s.step, s.dataset, len(s.fixes) > 0 AS has_fixes, coalesce(reported, 0) AS reported, coalesce(tp, 0) AS tp,
   coalesce(found, 0) AS found, coalesce(n, 0) AS n, coalesce(w, 0)::DOUBLE AS w, coalesce(earned, 0)::DOUBLE AS earned,
   CAST(coalesce(ok, 0) AS BIGINT) AS fixes_correct, CAST(coalesce(part, 0) AS BIGINT) AS fixes_partial, CAST(coalesce(bad, 0) AS BIGINT) AS fixes_wrong
   FROM sub s LEFT JOIN cnt USING (episode_id, step) LEFT JOIN tot USING (dataset) LEFT JOIN fsum USING (episode_id, step)),
pr AS (SELECT *, reported - tp AS fp, n - tp AS fn, CASE WHEN reported > 0 THEN tp / reported ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS r,
   CASE WHEN w > 0 THEN found / w ELSE 0 END AS wr, CASE WHEN found > 0 THEN found / (found + (reported - tp) * w / n) ELSE 0 END AS wp,
   CASE WHEN w > 0 THEN least(greatest(earned / w, 0), 1) WHEN fixes_correct + fixes_partial + fixes_wrong = 0 THEN 1 ELSE 0 END AS fix_score FROM base),
sc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, CASE WHEN wp + wr > 0 THEN 2 * wp * wr / (wp + wr) ELSE 0 END AS identify_score FROM pr),
cb AS (SELECT *, CASE WHEN has_fixes THEN 0.6::DOUBLE * identify_score + 0.4::DOUBLE * fix_score ELSE identify_score END AS combined_reward FROM sc),
sheet AS (SELECT *, max(combined_reward) OVER (PARTITION BY episode_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_score FROM cb)"""


def _sheet(spark, sf) -> DataFrame:
    return score.score_steps(submissions(spark, sf), truth_of(spark, sf), decimals=None)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- reading ------------------------------------------------------------------------------------------------------------

@query("parse_issue_reports", f"WITH {SUBS}, {REPS} SELECT episode_id, step, row_id, col, issue_type FROM rep")
def parse_issue_reports(spark, sf):
    return parse.parse_reports(submissions(spark, sf)).drop("dataset")


@query("parse_fix_reports", f"WITH {SUBS}, {TRUTH}, {FIXES} SELECT episode_id, step, seq, row_id, col, proposed FROM fx")
def parse_fix_reports(spark, sf):
    return parse.parse_fixes(submissions(spark, sf)).drop("dataset")


@query("parse_errors", f"""
WITH {SUBS}, {REPS}, {TRUTH}, {FIXES}
SELECT episode_id, step, 'issue' AS kind, CAST(seq AS INTEGER) AS seq, 'Could not parse issue: ''' || x || '''' AS reason FROM pi WHERE r = '' OR col = '' OR issue_type = ''
UNION ALL SELECT episode_id, step, 'fix', CAST(seq AS INTEGER), 'Could not parse fix: ''' || x || '''' FROM pf WHERE r = '' OR col = '' OR proposed = ''
""")
def parse_errors(spark, sf):
    return parse.parse_errors(submissions(spark, sf)).drop("dataset", "raw")


@query("parse_issue_keys", f"""
WITH {SUBS}, {REPS} SELECT DISTINCT 'row:' || row_id || ',col:' || col || ',issue:' || issue_type AS issue_key, row_id, col, issue_type FROM rep
""")
def parse_issue_keys(spark, sf):
    """Format keys and read them back."""
    reports = parse.parse_reports(submissions(spark, sf))
    key = parse.issue_key(F.col("row_id"), F.col("col"), F.col("issue_type"))
    return reports.select(key.alias("issue_key")).distinct().withColumn("k", parse.split_issue_key(F.col("issue_key"))).select(
        "issue_key", "k.*"
    )


def reply_text():
    """Free text as a model would write it: list marks, mixed case, prose in between."""
    t = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("Here is what I found:\n1. row:"), t("event_id"), F.lit(", col:value, issue:out_of_range\n - ROW: "), t("user_id"),
        F.lit(" ; Column: Event_Type ; Issue: Format_Violation\n\n2) row="), t("event_id"), F.lit(" col=props issue=wrong_type\n* row:"),
        t("user_id"), F.lit(", column: "), F.col("event_type"), F.lit(", fix: "), t("value"), F.lit(" USD  \nrow: x, col: y, issue: z"),
    )


_REPLY = """
SELECT 'Here is what I found:\n1. row:' || event_id || ', col:value, issue:out_of_range\n - ROW: ' || user_id || ' ; Column: Event_Type ; Issue: Format_Violation\n\n2) row='
  || event_id || ' col=props issue=wrong_type\n* row:' || user_id || ', column: ' || event_type || ', fix: ' || CAST(value AS VARCHAR) || ' USD  \nrow: x, col: y, issue: z' AS reply, event_id
FROM events"""
_REPLY_LINES = f"""
x AS ({_REPLY}), l AS (SELECT event_id, unnest(string_split(reply, chr(10))) AS raw FROM x),
m AS (SELECT event_id, trim(regexp_replace(regexp_replace(trim(raw), '^\\s*\\d+[.)]\\s*', ''), '^\\s*[-*]\\s*', '')) AS s FROM l)"""
_LINE = "(?i)row\\s*[:=]\\s*(\\d+)\\s*[,;\\s]+col(?:umn)?\\s*[:=]\\s*(\\w+)\\s*[,;\\s]+"


@query("parse_reply_issues", f"""
WITH {_REPLY_LINES} SELECT event_id, CAST(regexp_extract(s, '{_LINE}issue\\s*[:=]\\s*(\\w+)', 1) AS BIGINT) AS row_id,
 lower(regexp_extract(s, '{_LINE}issue\\s*[:=]\\s*(\\w+)', 2)) AS col, lower(regexp_extract(s, '{_LINE}issue\\s*[:=]\\s*(\\w+)', 3)) AS issue_type
FROM m WHERE regexp_matches(s, '{_LINE}issue\\s*[:=]\\s*(\\w+)')
""")
def parse_reply_issues(spark, sf):
    replies = table(spark, sf, "events").select("event_id", reply_text().alias("reply"))
    return replies.select("event_id", F.explode(parse.parse_issue_lines(F.col("reply"))).alias("r")).select("event_id", "r.*")


@query("parse_reply_fixes", f"""
WITH {_REPLY_LINES} SELECT event_id, CAST(regexp_extract(s, '{_LINE}fix\\s*[:=]\\s*(.+?)$', 1) AS BIGINT) AS row_id,
 lower(regexp_extract(s, '{_LINE}fix\\s*[:=]\\s*(.+?)$', 2)) AS col, trim(regexp_extract(s, '{_LINE}fix\\s*[:=]\\s*(.+?)$', 3)) AS proposed
FROM m WHERE regexp_matches(s, '{_LINE}fix\\s*[:=]\\s*(.+?)$')
""")
def parse_reply_fixes(spark, sf):
    replies = table(spark, sf, "events").select("event_id", reply_text().alias("reply"))
    return replies.select("event_id", F.explode(parse.parse_fix_lines(F.col("reply"))).alias("r")).select("event_id", "r.*")


# --- scores -------------------------------------------------------------------------------------------------------------

@query("identify_score", f"""
WITH {SCORES} SELECT episode_id, step, dataset, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
 round(p, 6)::DOUBLE AS precision_, round(r, 6)::DOUBLE AS recall_, round(f1, 6)::DOUBLE AS f1 FROM sheet
""")
def identify_score(spark, sf):
    subs = submissions(spark, sf)
    counts = score.precision_recall(score.confusion(subs, parse.parse_reports(subs), truth_of(spark, sf)))
    return _rounded(counts, "precision", "recall", "f1").select(
        "episode_id", "step", "dataset", "tp", "fp", "fn", F.col("precision").alias("precision_"),
        F.col("recall").alias("recall_"), "f1",
    )


@query("weighted_score", f"""
WITH {SCORES} SELECT episode_id, step, round(identify_score, 6)::DOUBLE AS identify_score, found::DOUBLE AS difficulty_found, (w - found)::DOUBLE AS difficulty_missed FROM sheet
""")
def weighted_score(spark, sf):
    subs = submissions(spark, sf)
    scored = score.weighted_score(score.confusion(subs, parse.parse_reports(subs), truth_of(spark, sf)))
    return _rounded(scored, "identify_score").select("episode_id", "step", "identify_score", "difficulty_found", "difficulty_missed")


@query("fix_grading", f"WITH {SUBS}, {TRUTH}, {FIXES} SELECT episode_id, step, seq, row_id, col, proposed, score, verdict, reason FROM gd")
def fix_grading(spark, sf):
    details = score.grade_fixes(parse.parse_fixes(submissions(spark, sf)), truth_of(spark, sf))
    return details.select("episode_id", "step", "seq", "row_id", "col", "proposed", "score", "verdict", "reason")


@query("fix_summary", f"""
WITH {SCORES} SELECT episode_id, step, round(fix_score, 6)::DOUBLE AS fix_score, fixes_correct, fixes_partial, fixes_wrong, fixes_correct + fixes_partial + fixes_wrong AS fixes_attempted FROM sheet
""")
def fix_summary(spark, sf):
    subs, truth = submissions(spark, sf), truth_of(spark, sf)
    details = score.grade_fixes(parse.parse_fixes(subs), truth)
    return _rounded(score.fix_summary(subs, details, truth), "fix_score").drop("dataset")


@query("combined_reward", f"""
WITH {SCORES} SELECT episode_id, step, has_fixes, round(combined_reward, 6)::DOUBLE AS combined_reward, round(greatest(0.001, least(0.999, best_score)), 6)::DOUBLE AS reward,
 f1 >= 0.999 OR step >= 3 AS done FROM sheet
""")
def combined_reward(spark, sf):
    return _rounded(_sheet(spark, sf), "combined_reward", "reward").select(
        "episode_id", "step", "has_fixes", "combined_reward", "reward", "done"
    )


@query("best_so_far", f"WITH {SCORES} SELECT episode_id, step, round(best_score, 6)::DOUBLE AS best_score FROM sheet")
def best_so_far(spark, sf):
    return _rounded(_sheet(spark, sf), "best_score").select("episode_id", "step", "best_score")


@query("episode_summary", f"""
WITH {SCORES} SELECT episode_id, dataset, count(*) AS steps, round(max(best_score), 6)::DOUBLE AS best_score, bool_or(f1 >= 0.999 OR step >= 3) AS done,
 max(best_score) >= 0.5 AS success FROM sheet GROUP BY 1, 2
""")
def episode_summary(spark, sf):
    return _rounded(score.episode_summary(_sheet(spark, sf)), "best_score")


@query("suite_average", f"""
WITH {SCORES}, b AS (SELECT dataset, max(best_score) AS s FROM sheet GROUP BY 1), d AS (SELECT DISTINCT dataset FROM truth)
SELECT round(avg(coalesce(s, 0)), 6)::DOUBLE AS average_score, count(*) AS suites FROM d LEFT JOIN b USING (dataset)
""")
def suite_average(spark, sf):
    episodes = score.episode_summary(_sheet(spark, sf))
    return _rounded(score.suite_average(episodes, truth_of(spark, sf)), "average_score")


def _order_truth_sql() -> str:
    parts = []
    for i, f in enumerate(ORDER_FAULTS):
        kind = f.resolve().issue_type
        extra = ""
        if f.rule == "extra_decimal":  # does not apply where the text already replaced the number
            extra = f" AND NOT {s_picked('o_orderkey', '1:o_totalprice', 0.01)}"
        parts.append(f"SELECT o_orderkey AS row_id, '{f.col}' AS col, '{kind}' AS issue_type FROM orders WHERE "
                     f"{s_picked('o_orderkey', f'{i}:{f.col}', f.rate)}{extra}")
    return " UNION ALL ".join(parts)


@query("rule_quality", f"""
WITH {DIRTY_ORDERS_SQL}, truth AS ({_order_truth_sql()}), pl AS (SELECT issue_type, count(*) AS planted FROM truth GROUP BY 1),
q AS (SELECT rule_id, f.issue_type, count(*) AS reported, count(t.row_id) AS tp FROM found f LEFT JOIN truth t USING (row_id, col, issue_type) GROUP BY 1, 2)
SELECT 'orders' AS dataset, rule_id, issue_type, reported, tp, reported - tp AS fp, coalesce(planted, 0) AS planted,
 round(tp / reported, 6)::DOUBLE AS precision_, round(CASE WHEN planted > 0 THEN tp / planted ELSE 0 END, 6)::DOUBLE AS recall_
FROM q LEFT JOIN pl USING (issue_type)
""")
def rule_quality(spark, sf):
    """Which rule finds what it should, on orders with five kinds of planted faults."""
    dirty, truth = dirty_orders(spark, sf)
    found = rules.run_rules(dirty, order_suite(), "o_orderkey", "orders")
    return _rounded(score.rule_quality(found, truth), "precision", "recall").withColumnRenamed("precision", "precision_").withColumnRenamed(
        "recall", "recall_"
    )


# --- review -------------------------------------------------------------------------------------------------------------

@query("review_unplanted", f"""
WITH {SCORES} SELECT episode_id, step, 'possible_unplanted_issue' AS type, 'row:' || row_id || ',col:' || col || ',issue:' || issue_type AS item FROM hit WHERE NOT hit
""")
def review_unplanted(spark, sf):
    return review.unplanted_flags(parse.parse_reports(submissions(spark, sf)), truth_of(spark, sf)).drop("dataset", "reason")


@query("review_partial_fixes", f"""
WITH {SUBS}, {TRUTH}, {FIXES} SELECT episode_id, step, 'row:' || row_id || ',col:' || col AS item,
 'repair graded ' || printf('%.2f', score) || ': ' || reason || '; accept or reject by hand' AS reason FROM gd WHERE score > 0 AND score < 0.99
""")
def review_partial_fixes(spark, sf):
    details = score.grade_fixes(parse.parse_fixes(submissions(spark, sf)), truth_of(spark, sf))
    return review.partial_fix_flags(details).drop("dataset", "type")


@query("review_missed_hard", f"""
WITH {SUBS}, {REPS}, {TRUTH}, m AS (
 SELECT s.episode_id, s.step, t.row_id, t.col, t.issue_type, t.descr FROM sub s JOIN truth t USING (dataset) WHERE t.d >= 2.5
 EXCEPT SELECT episode_id, step, rep.row_id, rep.col, rep.issue_type, t.descr FROM rep JOIN truth t USING (dataset, row_id, col, issue_type))
SELECT episode_id, count(*) AS flags, min('row:' || row_id || ',col:' || col || ',issue:' || issue_type) AS first_item,
 max('hard fault not found, difficulty 2.5: ' || descr) AS reason FROM m GROUP BY 1
""")
def review_missed_hard(spark, sf):
    """Flags of missed hard faults, counted per episode."""
    subs = submissions(spark, sf)
    return review.missed_hard_flags(subs, parse.parse_reports(subs), truth_of(spark, sf), per="episode_id")


@query("cell_status", f"""
WITH {SCORES},
ce AS (SELECT episode_id, step, row_id, col, CASE WHEN hit THEN 3 ELSE 2 END AS k, NULL AS f, NULL AS p, -1 AS seq FROM hit
  UNION ALL SELECT episode_id, step, row_id, col, 0, CASE WHEN score >= 0.99 THEN 'FIX' WHEN score > 0 THEN '~FIX' ELSE 'WRONG' END, proposed, seq FROM gd),
g AS (SELECT episode_id, step, row_id, col, max(k) AS k, arg_max(f, seq) FILTER (f IS NOT NULL) AS fix_status, arg_max(p, seq) FILTER (f IS NOT NULL) AS proposed FROM ce GROUP BY 1, 2, 3, 4)
SELECT episode_id, step, row_id, col, CASE k WHEN 3 THEN 'TP' WHEN 2 THEN 'FP' END AS status, fix_status, proposed FROM g
""")
def cell_status(spark, sf):
    """States of reported and repaired cells while the episodes run (no step counts as the last one)."""
    subs, truth = submissions(spark, sf), truth_of(spark, sf)
    running = subs.select("episode_id", "step", "dataset", F.lit(False).alias("done"))
    return review.cell_status(subs, truth, running).drop("dataset")


@query("cell_status_missed", f"""
WITH {SCORES}, last AS (SELECT episode_id, max(step) AS step FROM sub GROUP BY 1),
m AS (SELECT s.episode_id, t.row_id, t.col FROM sub s JOIN last USING (episode_id, step) JOIN truth t USING (dataset)
  EXCEPT SELECT episode_id, row_id, col FROM hit JOIN last USING (episode_id, step) WHERE hit)
SELECT episode_id, count(*) AS missed FROM m WHERE (episode_id, row_id, col) NOT IN (SELECT (episode_id, row_id, col) FROM hit JOIN last USING (episode_id, step)) GROUP BY 1
""")
def cell_status_missed(spark, sf):
    """Cells left unreported in the last step of every episode."""
    subs, truth = submissions(spark, sf), truth_of(spark, sf)
    last = subs.groupBy("episode_id").agg(F.max("step").alias("step"))
    final = subs.join(last, ["episode_id", "step"])
    ended = final.select("episode_id", "step", "dataset", F.lit(True).alias("done"))
    states = review.cell_status(final, truth, ended, per="episode_id")
    return states.where("status = 'MISS'").select("episode_id", F.col("cells").alias("missed"))


@query("episode_replay", f"""
WITH {SCORES}
SELECT episode_id, step, CASE WHEN has_fixes THEN 'identify + fix' ELSE 'identify only' END AS label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
 round(identify_score, 6)::DOUBLE AS identify, round(fix_score, 6)::DOUBLE AS fix FROM sheet
UNION ALL SELECT DISTINCT episode_id, 0, 'initial', 0, 0, n, 0, 0 FROM sheet
""")
def episode_replay(spark, sf):
    replay = review.episode_replay(_sheet(spark, sf), truth_of(spark, sf))
    return _rounded(replay, "identify", "fix").select("episode_id", "step", "label", "tp", "fp", "fn", "identify", "fix")


@query("step_feedback")
def step_feedback(spark, sf):
    """The whole feedback text per submission."""
    subs, truth = submissions(spark, sf), truth_of(spark, sf)
    return review.step_feedback(subs, truth, score.score_steps(subs, truth))
