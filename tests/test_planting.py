import pytest
from pyspark.sql import functions as F

import tablewarden as tw
from tablewarden.operators.contaminate import Fault, added_key, append_copies, constant, contaminate, copy_from_donor, dropped_key
from tablewarden.sources import attach_clean_values, cell_value, from_tuples, read_table, with_row_id, write_table


@pytest.fixture
def people(spark):
    return from_tuples(spark, ["id", "name", "score"], [(1, "Alice", 95), (2, "Bob", 87), (3, "Carol", 92), (4, "Dave", 78)])


def dirty_and_truth(people, faults):
    dirty, truth = contaminate(people, faults)
    return {r.row_id: r for r in dirty.collect()}, {(r.row_id, r.col, r.seq): r for r in truth.collect()}


def test_named_rules(people):
    dirty, truth = dirty_and_truth(people, [
        Fault("missing_value", "name", rows=(1,)), Fault("whitespace_value", "name", rows=(2,)),
        Fault("negative_value", "score", rows=(3,)), Fault("wrong_type_text", "score", rows=(4,), difficulty=2.0),
    ])
    assert dirty[1].name == "" and dirty[2].name == " " and dirty[3].score == "-92.0"
    assert dirty[4].score in ("not-a-number", "N/A", "null", "undefined")
    assert truth[(1, "name", 0)].difficulty == 1.0 and truth[(2, "name", 1)].difficulty == 2.5
    assert truth[(4, "score", 3)].difficulty == 2.0 and truth[(4, "score", 3)].clean_value == "78"
    assert truth[(3, "score", 2)].issue_type == "out_of_range" and truth[(3, "score", 2)].description == "Negative score"


def test_faults_are_applied_in_order(people):
    dirty, truth = dirty_and_truth(people, [Fault("missing_value", "score", rows=(1,)), Fault("negative_value", "score", rows=(1,))])
    assert dirty[1].score == "-1" and len(truth) == 2 and truth[(1, "score", 1)].clean_value == "95"


def test_a_rule_that_does_not_apply_plants_nothing(people):
    dirty, truth = dirty_and_truth(people, [Fault("negative_value", "name", rows=(1,))])
    assert dirty[1].name == "Alice" and not truth


def test_rules_given_in_place_and_by_name(spark, people):
    tw.register_contamination_rule("reversed", lambda v, luck: F.reverse(v), "format_violation", 2.0)
    dirty, truth = dirty_and_truth(people, [Fault("reversed", "name", rows=(1,)), Fault(lambda v, luck: F.upper(v), "name", rows=(2,))])
    assert dirty[1].name == "ecilA" and dirty[2].name == "BOB"
    assert truth[(1, "name", 0)].issue_type == "format_violation" and truth[(2, "name", 1)].issue_type == "inconsistent_value"
    with pytest.raises(ValueError, match="Unknown contamination rule"):
        contaminate(people, [Fault("no_such_rule", "name", rows=(1,))])


def test_python_code_as_a_rule(spark, people):
    import pandas as pd

    @F.pandas_udf("string")
    def swap(s: pd.Series) -> pd.Series:
        return s.str.swapcase()

    dirty, _ = dirty_and_truth(people, [Fault(lambda v, luck: swap(v), "name", rows=(1,))])
    assert dirty[1].name == "aLICE"


def test_seeded_rates_ignore_partitioning(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("some text").alias("a"))
    fault = [Fault("typo", "a", rate=0.1)]
    runs = [sorted(map(tuple, contaminate(df.repartition(n), fault)[0].collect())) for n in (1, 17)]
    assert runs[0] == runs[1]
    n = contaminate(df, fault)[1].count()
    assert 400 < n < 600
    assert contaminate(df, fault, seed=7)[1].select("row_id").exceptAll(contaminate(df, fault)[1].select("row_id")).count() > 100
    assert all(r.a != "some text" for r in contaminate(df, fault)[0].join(contaminate(df, fault)[1].select("row_id"), "row_id").collect())


def test_copies_and_donors(people):
    dirty, truth = append_copies(people, "id", rows=(2,))
    last = {r.row_id: r for r in dirty.collect()}[5]
    mark = truth.first()
    assert (last.id, last.name) == ("2", "Bob") and mark.row_id == 5 and mark.clean_value is None and mark.issue_type == "duplicate_row"
    dirty, truth = copy_from_donor(people, "name", 2, rows=(1, 4))
    assert {r.row_id: r.name for r in dirty.collect()} == {1: "Alice", 2: "Bob", 3: "Carol", 4: "Bob"}
    assert [(r.row_id, r.clean_value) for r in truth.collect()] == [(4, "Dave")]


def test_json_edits(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "{}")], "row_id long, j string")
    dirty, _ = contaminate(df, [Fault(dropped_key("a"), "j", rows=(1,)), Fault(added_key("c", "true"), "j", rows=(1, 2))])
    assert {r.row_id: r.j for r in dirty.collect()} == {1: '{"b":"x", "c": true}', 2: '{"c": true}'}


def test_truth_comes_without_a_shuffle(spark, people):
    dirty, truth = contaminate(people, [Fault("missing_value", "name", rate=0.5)])
    for df in (dirty, truth):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_suite_from_config(spark, people):
    config = {"name": "mine", "contaminations": [
        {"rule": "missing_value", "row": 0, "col": 1, "difficulty": 1.5}, {"rule": "negative_value", "row": 2, "col": 2},
        {"rule": lambda v, luck: F.lit("?"), "row": 3, "col": "name"},
    ], "columns": [tw.ColumnSpec("name"), tw.ColumnSpec("score", "float", lo=0)]}
    tw.register_suite("mine", lambda: tw.suite_from_config(config, lambda s: people))
    suite = tw.get_suite("mine")
    clean, dirty, truth = suite.load(spark)
    assert "mine" in tw.list_suites() and truth.count() == 3
    assert {(r.row_id, r.col, r.issue_type) for r in suite.detect(dirty).collect()} == {(1, "name", "missing_value"), (3, "score", "out_of_range")}
    assert suite.detect(clean).count() == 0
    with pytest.raises(ValueError, match="Unknown suite"):
        tw.get_suite("none")
    with pytest.raises(ValueError, match="Unknown contamination rule"):
        tw.suite_from_config({"name": "x", "contaminations": [{"rule": "zzz", "row": 0, "col": 0}]}, lambda s: people)


def test_cells(spark, people):
    cells = spark.createDataFrame([(1, " NAME "), (2, "score"), (3, "nope"), (9, "name")], "row_id long, col string")
    got = {(r.row_id, r.col): r.value for r in cell_value(people, cells).collect()}
    assert got == {(1, " NAME "): "Alice", (2, "score"): "87", (3, "nope"): None, (9, "name"): None}
    _, truth = contaminate(people, [Fault(constant("x"), "name", rows=(2,))])
    assert attach_clean_values(truth.withColumn("clean_value", F.lit(None)), people).first().clean_value == "Bob"


def test_row_ids_are_contiguous(spark):
    df = spark.range(0, 1000, 1, 13).select((F.col("id") * 7).alias("x"))
    got = with_row_id(df)
    assert sorted(r.row_id for r in got.collect()) == list(range(1, 1001))
    assert [r.row_id for r in with_row_id(df.where("x < 0")).collect()] == []
    assert with_row_id(df, "x").where("row_id <> x").count() == 0


def test_csv_keeps_quotes_commas_line_ends_and_empty_cells(spark, tmp_path):
    rows = [('{"a": "x,y"}', "line\nend", ""), ('say "hi"', None, " ")]
    df = from_tuples(spark, ["a", "b", "c"], rows).drop("row_id").coalesce(1)
    path = str(tmp_path / "csv")
    write_table(df, path, "csv")
    back = [tuple(r) for r in read_table(spark, path, "csv", multiline=True, ignoreLeadingWhiteSpace=False).collect()]
    assert sorted(back, key=str) == sorted([('{"a": "x,y"}', "line\nend", None), ('say "hi"', None, " ")], key=str)
