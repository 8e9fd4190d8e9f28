"""Faults planted against another column, the row before or another group; and brackets by nesting."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import code, ordered, related, rules
from tablewarden.operators.contaminate import Fault, contaminate


def events(spark):
    draw = random.Random(6)
    rows, at = [], {}
    for i in range(900):
        user = draw.choice([0, 0, 0, 1, 2])
        at[user] = at.get(user, 0) + draw.randint(0, 90)
        rows.append((i, user, at[user] if draw.random() > 0.05 else None))
    return spark.createDataFrame(rows, "row_id long, user long, s long").select("row_id", "user", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("size", [10 << 20, -1])
def test_planted_times_are_the_late_ones_and_no_others(spark, size):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size))
    try:
        clean = events(spark)
        assert ordered.chronological(clean, "ts", "row_id", partition_by=["user"]).count() == 0
        dirty, truth = related.before_previous(clean, "ts", "row_id", partition_by=["user"], rate=0.3)
        planted = {r["row_id"] for r in truth.collect()}
        assert len(planted) > 80
        assert {r["row_id"] for r in ordered.chronological(dirty, "ts", "row_id", partition_by=["user"]).collect()} == planted
        again, _ = related.before_previous(clean.repartition(7), "ts", "row_id", partition_by=["user"], rate=0.3)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, dirty.collect()))
        assert dirty.columns == clean.columns and dirty.schema["ts"].dataType == clean.schema["ts"].dataType
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values_below_their_partner_are_the_ones_compared_wrong(spark):
    df = spark.createDataFrame([(i, str(20 + i), str(10 + i), "2024-03-02", "2024-03-01") for i in range(400)] + [(900, "5", "none", "2024-01-01", "x")],
                               "row_id long, price string, cost string, ended string, began string")
    dirty, truth = contaminate(df, [Fault(related.below_column("cost"), "price", rate=0.2), Fault(related.before_column("began"), "ended", rate=0.2)])
    planted = {(r["row_id"], r["col"]) for r in truth.collect()}
    wrong = {(r["row_id"], "price") for r in dirty.where("cast(price as double) < try_cast(cost as double)").collect()}
    wrong |= {(r["row_id"], "ended") for r in dirty.where("ended < began and began <> 'x'").collect()}
    assert wrong == planted and (900, "price") not in planted


def test_donors_are_of_another_group(spark):
    draw = random.Random(2)
    rows = [(i, f"text {i}", draw.choice(["en"] * 20 + ["de", "fr", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, text string, lang string")
    dirty, truth = related.copy_from_other_group(df, "text", "lang", rate=0.3, slots=16)
    lang, planted = {t: g for _, t, g in rows}, {r["row_id"] for r in truth.collect()}
    changed = {r["row_id"] for r in dirty.collect() if r["text"] != f"text {r['row_id']}"}
    assert changed == planted and len(planted) > 300
    assert all(r["lang"] is not None and lang[r["text"]] not in (None, r["lang"]) for r in dirty.collect() if r["row_id"] in planted)
    again, _ = related.copy_from_other_group(df.repartition(9), "text", "lang", rate=0.3, slots=16)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, dirty.collect()), key=str)
    assert related.copy_from_other_group(df.where("lang = 'en'"), "text", "lang", rate=0.3)[1].count() == 0
    assert related.copy_from_other_group(df.where("false"), "text", "lang")[0].count() == 0


def plain_nesting(text, comment=None):
    import re

    skip = r"'[^'\n]*'|\"[^\"\n]*\"" + (f"|{comment}" if comment else "")
    stack = []
    for m in re.finditer(rf"(?P<s>{skip})|(?s:.)", text):
        ch = m[0]
        if m["s"] is None and ch in "([{":
            stack.append(ch)
        elif m["s"] is None and ch in ")]}":
            if not stack or stack[-1] != "([{"[")]}".index(ch)]:
                return m.end(), len(stack)
            stack.pop()
    return 0, len(stack)


def test_nesting_equals_a_stack(spark):
    draw = random.Random(3)
    texts = [")(", "([)]", "(')')", "a # (\n)", "// {", "{'(': [1, (2)]}", "", "it's (open", '"a\n(" )', None]
    texts += ["".join(draw.choices("()[]{}ab'\"\n#/-", k=draw.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(draw.choices("([{", k=n)) for n in (19, 20, 21, 40, 41, 61)]
    for n in (20, 21, 60, 500):
        opened = "".join(draw.choices("([{", k=n))
        closed = opened[::-1].translate(str.maketrans("([{", ")]}"))
        texts += [opened + closed, opened + closed[:-1], opened + "x" + closed[:-3] + ")" + closed[-2:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    for comment in (None, r"#[^\n]*|//[^\n]*"):
        got = df.select("row_id", code.bracket_nesting(F.col("t"), comment).alias("n")).collect()
        for r in got:
            if texts[r["row_id"]] is None:
                assert r["n"] is None
            else:
                assert tuple(r["n"]) == plain_nesting(texts[r["row_id"]], comment), texts[r["row_id"]]
    assert "Python" not in rules.run_rules(df, [code.misnested_brackets("t")])._jdf.queryExecution().executedPlan().toString()


def test_very_long_code(spark):
    n = 50_000
    texts = ["(" * n + ")" * n, "([" * (n // 2) + "])" * (n // 2), "[](){}" * (n // 3), "(" * n + ")" * (n - 1) + "]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    got = {r["row_id"]: tuple(r["n"]) for r in df.select("row_id", code.bracket_nesting(F.col("t")).alias("n")).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (2 * n, 1)}
