import math

import pytest
from pyspark.sql import functions as F

from tablewarden.functions import (
    as_number, digits_for_letters, is_blank, is_json, json_root_type, number_from_words, strip, truncate_decimals,
)


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return [r.v for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers_are_read_like_python_reads_them(spark):
    texts = ["12", "-3.5", "1e3", ".5", "5.", "1_000", " 7 ", " 8 ", "12d", "1.5f", "1O", "", "1__0", "_1", "0x10",
             "N/A", "1e", "+2", "1e400", "1 2", "1,000", "--1"]
    for text, got in zip(texts, values(spark, texts, as_number)):
        try:
            want = float(text)
        except ValueError:
            want = None
        assert got == want, text


def test_special_numbers(spark):
    got = values(spark, ["nan", "-NaN", "inf", "-Infinity", "+inf", "infinit", None], as_number)
    assert math.isnan(got[0]) and math.isnan(got[1])
    assert got[2:] == [math.inf, -math.inf, math.inf, None, None]


def test_blank_and_strip(spark):
    assert values(spark, ["", " ", " \t", "a", None], is_blank) == [True, True, True, False, True]
    assert values(spark, ["  a b \n"], strip) == ["a b"]


@pytest.mark.parametrize("text, ok", [
    ('{"a": 1}', True), ('[1, "x"]', True), ("5", True), ("null", True), ('{"a": 1} x', False), ('{"a": ', False),
    ("1, 2", False), ('1}, {"a": 2', False), ('"a": 1', False), ("", False), ('{"a": "x\ny"}', False),
])
def test_strict_json(spark, text, ok):
    assert values(spark, [text], is_json) == [ok]


def test_json_types(spark):
    texts = ['{"a": 1}', "[1]", '"s"', "1.5", "true", "null", "oops"]
    assert values(spark, texts, json_root_type) == ["object", "array", "string", "number", "boolean", "null", None]


def test_number_words(spark):
    texts = ["seventy-five thousand", "one million two hundred thousand", "nineteen", "one hundred and five", "three cats", "", None,
             "two hundred"]
    assert values(spark, texts, number_from_words) == [75000, 1200000, 19, 105, None, None, None, 200]


def test_letters_for_digits(spark):
    assert values(spark, ["1O", "l2", "12", "abc", None], digits_for_letters) == ["10", "12", None, None, None]


def test_decimals_are_cut_not_rounded(spark):
    got = values(spark, ["24.999", "-1.239", "3", "x"], lambda c: truncate_decimals(c, 2).cast("string"))
    assert got == ["24.99", "-1.23", "3.00", None]
