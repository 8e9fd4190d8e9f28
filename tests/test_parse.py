import pytest
from pyspark.sql import functions as F

from tablewarden.operators import parse


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text, want", [
    ("row:3,col:salary,issue:missing_value", (3, "salary", "missing_value")),
    ("  ROW = 3 ; COL = Salary ; ISSUE = Missing_Value ", (3, "salary", "missing_value")),
    ("issue:wrong_type col:a row:12", (12, "a", "wrong_type")),
    ("row:3,column:salary,issue:missing_value", (3, "salary", "missing_value")),
    ("row:007,col:a,issue:b", (7, "a", "b")),
    ("row:x,col:a,issue:b", None), ("row:1,col:a", None), ("", None), (None, None), ("row:99999999999999999999,col:a,issue:b", None),
])
def test_issue(spark, text, want):
    got = one(spark, text, parse.parse_issue)
    assert (tuple(got) if got else None) == want


def test_unanchored_and_anchored(spark):
    text = "arrow:3,pcol:x,issue:y"
    assert tuple(one(spark, text, parse.parse_issue)) == (3, "x", "y")
    assert one(spark, text, lambda c: parse.parse_issue(c, anchored=True)) is None
    assert one(spark, "row:1,column:a,issue:b", lambda c: parse.parse_issue(c, short_col_only=True)) is None


@pytest.mark.parametrize("text, want", [
    ("row:4,col:name,fix:David Kim", (4, "name", "David Kim")),
    ("ROW=4; Column=Name; FIX =  a, b: c ", (4, "name", "a, b: c")),
    ("row:007,col:a,fix:x", (7, "a", "x")), ("row:4,col:name", None), ("row:4,fix:x", None), ("row:4,col:a,fix:", None),
    ("row:4,col:a,fix:x\ny", None), ("row:4,col:a,fix:x\ry", (4, "a", "x\ry")),
])
def test_fix(spark, text, want):
    got = one(spark, text, parse.parse_fix)
    assert (tuple(got) if got else None) == want


def test_lines(spark):
    text = "Found:\n1. row:1, col:a, issue:x\n2) Row=2 Column=B Issue=Y\n\n- row:3; col:c; issue:z\n* row:1, col:a, issue:x\nrow 5 is bad"
    got = [tuple(r) for r in one(spark, text, parse.parse_issue_lines)]
    assert got == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (1, "a", "x")]
    got = [tuple(r) for r in one(spark, "- row:1, col:A, fix: New Value \nnothing\nrow:2,column:b,fix:7", parse.parse_fix_lines)]
    assert got == [(1, "a", "New Value"), (2, "b", "7")]


def test_key_round_trip(spark):
    df = spark.createDataFrame([(7, "my_col", "wrong_type")], "row_id long, col string, issue_type string")
    key = parse.issue_key(F.col("row_id"), F.col("col"), F.col("issue_type"))
    row = df.select(key.alias("k"), parse.split_issue_key(key).alias("s")).first()
    assert row.k == "row:7,col:my_col,issue:wrong_type" and tuple(row.s) == (7, "my_col", "wrong_type")


def test_reports_drop_repeats_and_keep_errors(spark):
    subs = spark.createDataFrame(
        [("e", 1, "d", ["row:1,col:a,issue:x", "ROW:1,COL:A,ISSUE:X", "??"], ["row:1,col:a,fix:2", "!!"])],
        "episode_id string, step int, dataset string, issues array<string>, fixes array<string>",
    )
    assert parse.parse_reports(subs).count() == 1
    errors = [(r.kind, r.seq, r.reason) for r in parse.parse_errors(subs).orderBy("kind").collect()]
    assert errors == [("fix", 1, "Could not parse fix: '!!'"), ("issue", 2, "Could not parse issue: '??'")]


def test_every_pattern_is_named_once_and_reads_as_the_plain_form(spark):
    """Expressions over array elements are worked out wherever they are named."""
    raw = ["row:1,col:A,issue:x", " Row = 2 ; Column = b ; Issue = Y ", "row:1,col:a,issue:X", None, "row:,col:a,issue:x", "row:99999999999999999999,col:a,issue:x", ""]
    fix = ["row:1,col:A,fix: B ", "row:1,col:a,fix:", "row:1,col:a,fix:  ", None, "col:a,fix:b", "Row=3;Column=C;Fix = d;e"]
    subs = spark.createDataFrame([("e", 1, "d", raw, fix), ("f", 1, "d", None, None), ("g", 1, "d", [], [])], "episode_id string, step int, dataset string, issues array<string>, fixes array<string>")
    reports, fixes = parse.parse_reports(subs), parse.parse_fixes(subs)
    for df, most in ((reports, 3), (fixes, 3)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= most
    plain = subs.select(F.explode("issues").alias("x")).select(parse.parse_issue(F.col("x")).alias("r")).where("r IS NOT NULL").distinct().select("r.*")
    assert sorted(map(tuple, reports.select("row_id", "col", "issue_type").collect())) == sorted(map(tuple, plain.collect()))
    plain = subs.select(F.posexplode("fixes").alias("seq", "x")).select("seq", parse.parse_fix(F.col("x")).alias("r")).where("r IS NOT NULL").select("seq", "r.*")
    assert sorted(map(tuple, fixes.select("seq", "row_id", "col", "proposed").collect())) == sorted(map(tuple, plain.collect()))
