import pytest
from pyspark.sql import functions as F

from tablewarden import build_check, register_check
from tablewarden.operators import code, keyed, labels, repair, rules, statistics, text, tools


def table(spark, header, rows):
    cols = header.split(",")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "row_id long, " + ", ".join(f"{c} string" for c in cols))


def hits(df, *checks):
    return {(r.row_id, r.col) for r in rules.run_rules(df, checks).collect()}


def rows_hit(df, *checks):
    return {r for r, _ in hits(df, *checks)}


def test_one_scan_for_many_rules(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    table(spark, "a,b,c", [("1", "", "x"), ("-5", "y", None)]).write.parquet(path)
    df = spark.read.parquet(path)
    found = rules.run_rules(df, [rules.missing_value("b"), rules.out_of_range("a", 0), rules.wrong_type("a", "int")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert "ReadSchema: struct<row_id:bigint,a:string,b:string>" in plan


def test_blank_cells_raise_only_missing_values(spark):
    df = table(spark, "a", [("",), ("  ",), (None,), ("x",)])
    others = [rules.wrong_type("a", "int"), rules.in_set("a", ["1"]), rules.matches("a", "^[0-9]+$"), rules.date_format("a")]
    assert rows_hit(df, rules.missing_value("a")) == {1, 2, 3}
    for check in others:
        assert rows_hit(df, check) == {4}


def test_types_ranges_dates_decimals(spark):
    df = table(spark, "v", [("12",), ("1.5",), ("12d",), ("nan",), ("2024-02-30",), ("2024-02-29",), ("02/03/2024",), ("24.999",), ("1000",), (" true ",)])
    assert rows_hit(df, rules.wrong_type("v", "int")) == {2, 3, 4, 5, 6, 7, 8, 10}
    assert rows_hit(df, rules.wrong_type("v", "float")) == {3, 5, 6, 7, 10}
    assert rows_hit(df, rules.wrong_type("v", "bool")) == set(range(1, 10))
    assert rows_hit(df, rules.out_of_range("v", 0, 100)) == {9}
    assert rows_hit(df, rules.out_of_range("v", 2)) == {2}
    assert 6 not in rows_hit(df, rules.date_format("v")) and 5 in rows_hit(df, rules.date_format("v"))
    assert rows_hit(df, rules.date_range("v", "2024-03-01", "2025-01-01")) == {6}
    assert rows_hit(df, rules.max_decimals("v", 2)) == {8}


def test_row_relations(spark):
    df = table(spark, "q,p,total", [("2", "3", "6"), ("2", "3", "6.009"), ("2", "3", "6.02"), ("2", "x", "9"), ("2", "3", "")])
    from tablewarden.functions import as_number

    product = as_number(F.col("q")) * as_number(F.col("p"))
    assert rows_hit(df, rules.row_expression("total", product, 0.01)) == {3}
    assert rows_hit(df, rules.power_of_two("q")) == set()
    assert rows_hit(df, rules.power_of_two("p")) == {1, 2, 3, 5}


def test_misspelling_of_a_few_words(spark):
    df = table(spark, "d", [("Engneering",), ("Engineering",), ("Fitness",), ("HRR",), ("",)])
    found = rules.run_rules(df, [rules.misspelling("d", ["Engineering", "HR", "Sales"])]).collect()
    assert {(r.row_id, r.expected) for r in found} == {(1, "Engineering"), (4, "HR")}
    many = ["Engineering", "HR", "Sales", *(f"wordnumber{i}" for i in range(100))]
    assert {(r.row_id, r.expected) for r in rules.run_rules(df, [rules.misspelling("d", many)]).collect()} == {(1, "Engineering"), (4, "HR")}
    assert rules.run_rules(df, [rules.misspelling("d", [])]).count() == 0


def test_table_and_list_forms_of_nearest_value_agree(spark):
    words, given = ["bat", "hat", "Sports", "Books"], ["cat", "batt", "Fitness", "Bookz", "hat", None]
    df = table(spark, "d", [(g,) for g in given])
    listed = df.select("row_id", repair.nearest_value("d", words, aliases={"Fitness": "Sports"}).alias("p")).where("p IS NOT NULL").collect()
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    found = repair.nearest_value_from(df, "d", dictionary, aliases={"Fitness": "Sports"}).collect()
    assert {(r.row_id, r.p) for r in listed} == {(r.row_id, r.proposed) for r in found} == {(2, "bat"), (3, "Sports"), (4, "Books")}


def test_bad_cells_never_stop_a_numeric_check(spark):
    from tablewarden.operators import ordered, statistics

    df = table(spark, "v,w,k", [("1", "2", "a"), ("abc", "0", "a"), ("", "x", "a"), ("3.5", "1", "b"), (None, None, None), ("1e400", "1", "b"), (" 2 ", "1", "a")])
    for test in (statistics.outlier_zscore, statistics.outlier_iqr, statistics.outlier_mad):
        assert test(df, "v", "k").count() >= 0
    assert statistics.outlier_ratio(df, F.col("v"), F.col("w"), "v").count() >= 0
    limits = spark.createDataFrame([("a", 0.0, 1.5)], "category string, lo double, hi double")
    assert {r.row_id for r in statistics.context_bound(df, "v", "k", limits).collect()} == {7}
    assert ordered.id_profile(df, "v").first()["n_distinct"] == 2
    assert {r.row_id for r in ordered.sequential_id(df, "v").collect()} == set()


def test_implication_and_context(spark):
    df = table(spark, "child,parent,kind,v", [("1", "0", "a", "5"), ("1", "1", "a", "50"), ("0", "0", "b", "500"), ("1", None, "b", "1")])
    assert hits(df, rules.label_implication("child", "parent")) == {(1, "parent"), (4, "parent")}
    assert rows_hit(df, rules.context_bound("v", "kind", {"a": (0, 10)})) == {2}


def test_named_checks(spark):
    register_check("shout", lambda col: rules.Rule(f"shout:{col}", col, "format_violation", F.col(col) == F.upper(F.col(col))))
    df = table(spark, "a", [("ABC",), ("abc",)])
    assert rows_hit(df, *build_check("shout", "a")) == {1}
    with pytest.raises(ValueError, match="Unknown check"):
        build_check("no_such_check")


def test_text_checks(spark):
    df = table(spark, "t,lang", [
        ("[SYSTEM] You are a helpful AI. Fine.", "en"), ("The cat sat on the mat and it was in the sun.", "en"),
        ("The cat sat on the", "en"), ("Le chat est dans la maison et il est sur le lit.", "en"), ("Done.\"", "en"), ("", "en"),
    ])
    assert rows_hit(df, text.leaked_prompt("t")) == {1}
    assert rows_hit(df, text.truncated("t")) == {3}
    assert rows_hit(text.with_language(df, "t"), text.language_mismatch("t", "lang")) == {4}


def test_personal_data(spark):
    df = table(spark, "t", [("write to a.b@mail.example.com or c@d.org",), ("call 555-123-4567",), ("none",), ("id 123-45-6789",)])
    got = {(r.row_id, r.kind): r.hits for r in text.pii_counts(df, "t").collect()}
    assert got[(1, "email")] == 2 and got[(4, "ssn")] == 1 and not any(r == 3 for r, _ in got)


def test_topic_and_score(spark):
    df = table(spark, "p,r,flag,score", [
        ("Describe copper pipes used inside harbour buildings", "Copper pipes last long inside harbour buildings.", "0", "4"),
        ("Describe copper pipes used inside harbour buildings", "Bananas grow quickly.", "1", "4"), ("Hi", "Bananas grow.", "1", "1"),
    ])
    assert rows_hit(df, text.off_topic("p", "r")) == {2}
    assert rows_hit(df, text.flagged_but_high_score("flag", "score", 3)) == {2}


def test_code_checks(spark):
    df = table(spark, "c,lang,ok", [
        ("def f(x):\n    return x", "python", "true"), ("def f(x):\n    return (x", "python", "true"),
        ("print('(')", "python", "true"), ("function f(x) {\n  const y = x;\n}", "python", "true"),
        ("SELECT a FROM t WHERE b > 1 ORDER BY a", "python", "true"), ("def f(x):\n    return eval(x)", "python", "true"),
        ("def f(x):\n    return eval(x)", "python", "false"), ("def f(x):\n    y = x +", "python", "true"),
    ])
    assert rows_hit(df, code.unbalanced_brackets("c")) == {2}
    assert rows_hit(df, code.truncated_code("c")) == {2, 8}
    assert rows_hit(df, code.code_language_mismatch("c", "lang")) == {4, 5}
    assert rows_hit(df, code.unsafe_pattern("c", F.col("ok") == "true")) == {6}


SCHEMA = '{"id": "string (key)", "n": "integer", "x": "number", "on": "boolean", "tags": "array"}'


@pytest.mark.parametrize("args, required, unknown, types", [
    ('{"id": "a", "n": 1, "x": 1, "on": true, "tags": []}', False, False, False), ('{"n": 1}', True, False, False),
    ('{"id": "a", "zz": 1}', False, True, False), ('{"id": 5}', False, False, True), ('{"id": "a", "n": "high"}', False, False, True),
    ('{"id": "a", "n": 1.5}', False, False, True), ('{"id": "a", "x": 1.5}', False, False, False), ('{"id": "a", "on": "yes"}', False, False, True),
    ('{"id": ', False, False, False),
])
def test_tool_call_arguments(spark, args, required, unknown, types):
    df = spark.createDataFrame([(1, f'{{"arguments": {args}}}', SCHEMA, "id, ")], "row_id long, c string, s string, req string")
    checks = [tools.required_keys("c", "$.arguments", "req"), tools.unknown_keys("c", "$.arguments", "s"), tools.json_arg_types("c", "$.arguments", "s")]
    assert [bool(rows_hit(df, k)) for k in checks] == [required, unknown, types]
    assert bool(rows_hit(df, tools.valid_json("c"))) == args.endswith(": ")


def test_tool_call_name_and_type(spark):
    df = table(spark, "call,f,out,kind", [('{"function": "a"}', "a", "[1]", "array"), ('{"function": "b"}', "a", "[1]", "object"), ("{}", "a", "oops", "object")])
    assert rows_hit(df, tools.json_field_equals("call", "$.function", "f")) == {2, 3}
    assert hits(df, tools.json_root_type_matches("out", "kind")) == {(2, "kind")}


def test_labels_and_peers(spark):
    df = table(spark, "t,l", [("you idiot", "0"), ("hello", "1"), ("hello", "0"), ("hello", "0"), ("bye", "2")])
    both = rules.run_rules(df, labels.lexicon_vs_label("t", "l", ["Idiot"])).collect()
    assert {(r.row_id, r.rule_id) for r in both} == {(1, "lexicon_unflagged:l"), (2, "lexicon_flagged:l")}
    assert hits(df, *labels.binary_labels(["l"])) == {(5, "l")}
    assert {r.row_id for r in keyed.label_conflict(df, F.col("t"), ["l"]).collect()} == {2, 3, 4}
    assert [(r.row_id, r.expected) for r in keyed.label_by_peer(df, F.col("t"), "l").collect()] == [(2, "0")]


def test_copies(spark):
    df = table(spark, "p,r", [("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", ""), ("e", "")])
    assert {r.row_id for r in keyed.duplicate_row(df, "p").collect()} == {2}
    assert {r.row_id for r in keyed.copied_response(df, "p", "r").collect()} == {3}
    assert {r.row_id for r in keyed.duplicate_text(df, "r").collect()} == {2, 3}
    assert {r.row_id for r in keyed.keep_first(df, ["r"]).collect()} == {1, 4, 5}


def test_completeness(spark):
    df = table(spark, "a,b", [("1", ""), ("2", None), (" ", "x"), ("4", "y")])
    got = {r.col: (r.n_missing, r.missing_share) for r in statistics.completeness(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 0.25), "b": (2, 0.5)}


@pytest.mark.parametrize("test, k", [("zscore", 3.0), ("iqr", 1.5), ("mad", 5.0)])
def test_outliers_per_group(spark, test, k):
    rows = [(i, "a", float(i % 7)) for i in range(60)] + [(60, "a", 500.0)] + [(100 + i, "b", 500.0 + i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, g string, v double").repartition(6)
    found = statistics.OUTLIER_TESTS[test](df, "v", "g", k)
    assert {r.row_id for r in found.collect()} == {60}


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build("v").alias("x")).first().x


@pytest.mark.parametrize("value, build, want", [
    ("seventy-five thousand", repair.from_words, "75000"), ("1O", repair.ocr_digits, "10"), ("abc", repair.ocr_digits, None),
    ("Engneering", lambda c: repair.nearest_value(c, ["Engineering", "Sales"]), "Engineering"),
    ("Fitness", lambda c: repair.nearest_value(c, ["Sports", "Books"]), None),
    ("Fitness", lambda c: repair.nearest_value(c, ["Sports", "Books"], aliases={"Fitness": "Sports"}), "Sports"),
    ("cat", lambda c: repair.nearest_value(c, ["bat", "hat"]), None),
    ("11-03-2022", repair.reformat_date, "2022-11-03"), ("26/01/2024", repair.reformat_date, "2024-01-26"), ("2024-01-26", repair.reformat_date, None),
    ("-72.0", lambda c: repair.flip_sign(c, 0), "72.0"), ("-72.0", lambda c: repair.flip_sign(c, 0, 50), None), ("5", repair.flip_sign, None),
    ("250", repair.nearest_power_of_two, "256"), ("24.999", repair.truncate_to, "24.99"),
    ("[SYSTEM] x. Hello", lambda c: repair.strip_marker(c, r"\[SYSTEM\][^.]*\."), "Hello"),
    ("3", repair.clamp_flag, "0"), ("1", repair.clamp_flag, None), ("david.kim@company.com", repair.name_from_email, "David Kim"),
])
def test_repairs(spark, value, build, want):
    assert one(spark, value, build) == want


def test_imputing_and_patching(spark):
    df = table(spark, "g,v", [("a", "1"), ("a", "1"), ("a", "3"), ("a", ""), ("b", "5"), ("b", "8"), ("b", None)])
    mode = {r.row_id: r.proposed for r in repair.impute(df, "v", "g").collect()}
    assert mode == {4: "1", 7: "5"}
    median = repair.impute(df, "v", "g", "median")
    assert {r.row_id: float(r.proposed) for r in median.collect()} == {4: 1.0, 7: 6.5}
    patched = {r.row_id: r.v for r in repair.apply_fixes(df, median, ["v"]).collect()}
    assert patched[4] == "1.0" and patched[7] == "6.5" and patched[5] == "5" and len(patched) == 7
