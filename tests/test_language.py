"""Languages by a trained model: plain counts, held-out accuracy on prose and code, and the cases at the edge."""

import collections
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import language

FOLDER = "/root/testdata/sf0.01"
LANGS = ["en", "fr", "de", "es"]


def grams(text, buckets):
    bare = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    bare = f" {bare} " if bare else ""
    return collections.Counter(
        ((ord(a) * language.MIX + ord(b)) * language.MIX + ord(c)) % buckets for a, b, c in zip(bare, bare[1:], bare[2:])
    )


ROWS = [
    (1, "The cat, the dog!", "en"), (2, "le chat et le chien 12", "fr"), (3, None, "en"), (4, "", "fr"), (5, "?! 99", "en"),
    (6, "the 😀 thé", None), (7, "der Hund", "xx"), (8, "The cat, the dog!", "en"), (9, "le the", "fr"), (10, "a", "fr"),
]


def test_scores_equal_plain_sums(spark):
    df = spark.createDataFrame(ROWS, "row_id long, text string, lang string").withColumn("score", F.lit("clash")).repartition(3)
    langs = ["en", "fr"]
    model = language.fit_language_model(df, "text", "lang", langs, buckets=64)
    counts = {lang: collections.Counter() for lang in langs}
    for _, text, lang in ROWS:
        if lang in counts:
            counts[lang] += grams(text, 64)
    assert [dict(counts[lang]) for lang in langs] == [{int(b): int(n) for b, n in enumerate(c) if n} for c in model.counts]
    got = {r.row_id: r.by_model for r in language.with_language_scores(df, "text", model, counted_as="lang").collect()}
    for row_id, text, lang in ROWS:
        own = grams(text, 64)
        assert got[row_id].grams == sum(own.values())
        if not own:
            assert got[row_id].lang is None and got[row_id].score is None
            continue
        scores = []
        for k in langs:
            taken = own if k == lang else collections.Counter()
            total = sum(counts[k].values()) - sum(taken.values()) + 64.0
            scores.append(sum(n * math.floor(1e6 * math.log((counts[k][b] - taken[b] + 1.0) / total) + 0.5) for b, n in own.items()))
        assert (got[row_id].lang, got[row_id].score) == (langs[scores.index(max(scores))], max(scores))
        assert got[row_id].lead == max(scores) - min(scores)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " " + "abc défg ñ " * 50
    whole = language.gram_counts(text, 128)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.gram_counts(text, 128) == whole).all() and whole.sum() == len(text) - 2
    assert not language.gram_counts("", 128).any() and not language.gram_counts(" a", 128).any()


def test_empty_table_and_bad_labels(spark):
    none = spark.createDataFrame([], "row_id long, text string, lang string")
    model = language.fit_language_model(none, "text", "lang", LANGS)
    assert not model.counts.any() and language.with_language_scores(none, "text", model).count() == 0
    tie = spark.createDataFrame([("some words",)], "text string")
    told = language.with_language_scores(tie, "text", model).first().by_model
    assert (told.lang, told.lead) == ("en", 0)
    for langs in ([], ["en", "en"]):
        with pytest.raises(ValueError):
            language.language_counts(none, "text", "lang", langs)
    df = spark.createDataFrame([("never counted", "en")], "text string, lang string")
    with pytest.raises(Exception, match="not counted into the model"):
        language.with_language_scores(df, "text", model, counted_as="lang").collect()


def test_counts_of_parts_add_up(spark):
    df = spark.createDataFrame(ROWS, "row_id long, text string, lang string")
    halves = [language.language_counts(df.where(F.col("row_id") % 2 == i), "text", "lang", LANGS) for i in (0, 1)]
    model = language.load_language_model(halves[0].unionByName(halves[1]), LANGS)
    assert (model.counts == language.fit_language_model(df, "text", "lang", LANGS).counts).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(trim(text)) > 0")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.fit_language_model(train, "text", "lang", LANGS)
    by_lang = language.with_language_scores(held, "text", model).groupBy("lang").agg(
        F.avg((F.col("by_model.lang") == F.col("lang")).cast("double")).alias("right"), F.count("*").alias("n")
    ).collect()
    print({r["lang"]: (r["right"], r["n"]) for r in by_lang})
    assert len(by_lang) == 4 and all(r["right"] >= 0.95 for r in by_lang)


def snippet(lang, rng):
    a, b, n = (rng.choice(["rate", "total", "row", "price", "item", "node", "user", "path"]) for _ in range(3))
    return {
        "python": [f"def {a}(self, {b}):\n    return self.{n} + {b}\n", f"for {a} in {b}:\n    if {a} is None:\n        continue\n", f"import {a}\nfrom {b} import {n}\n",
                   f"with open({a}) as f:\n    {b} = [x for x in f]\n"],
        "javascript": [f"const {a} = ({b}) => {b}.{n};\n", f"function {a}({b}) {{ return {b} === {n}; }}\n", f"let {a} = {b} || null; console.log({a});\n",
                       f"{a}.forEach(({b}) => {{ {n}.push({b}); }});\n"],
        "sql": [f"SELECT {a}, {b} FROM {n} WHERE {a} > 3\n", f"INSERT INTO {a} ({b}) VALUES (1)\n", f"SELECT count(*) FROM {a} LEFT JOIN {b} ON {a}.{n} = {b}.{n}\n",
                f"UPDATE {a} SET {b} = 1 WHERE {n} IS NULL\n"],
    }[lang][rng.randrange(4)]


def test_held_out_accuracy_on_code(spark):
    rng = random.Random(3)
    rows = [(i, snippet(lang, rng), lang) for i, lang in enumerate(rng.choice(["python", "javascript", "sql"]) for _ in range(600))]
    df = spark.createDataFrame(rows, "row_id long, code string, lang string")
    langs = ["javascript", "python", "sql"]
    model = language.fit_language_model(df.where("row_id < 300"), "code", "lang", langs, language.CODE)
    told = language.with_model_language(df.where("row_id >= 300"), "code", model, min_lead=0).collect()
    right = sum(r.guessed_lang == r.lang for r in told) / sum(r.guessed_lang is not None for r in told)
    print(right)
    assert right >= 0.95 and sum(r.guessed_lang is not None for r in told) > 200


def test_wrong_labels_are_found(spark):
    docs = spark.createDataFrame(
        [(i, "the house of the king and the sea " * 3, "en" if i else "fr") for i in range(20)]
        + [(100 + i, "la maison du roi et la mer est dans les bois " * 3, "fr") for i in range(20)], "row_id long, text string, lang string")
    model = language.fit_language_model(docs, "text", "lang", ["en", "fr"])
    judged = language.with_model_language(docs, "text", model, counted_as="lang")
    assert [r.row_id for r in judged.where("guessed_lang <> lang").collect()] == [0]


def test_few_grams_are_counted_as_many_are():
    import numpy as np

    from tablewarden.operators import language

    for text in ["", " ", " a", " a ", " def f(x): return x ", " ünïcode 𝒳 " * 9, " aaaa " * 400, " some words " * 5000]:
        dense = language.gram_counts(text, 1 << 14)
        used, n = language.used_grams(text, 1 << 14)
        assert used.tolist() == np.flatnonzero(dense).tolist() and n.tolist() == dense[dense > 0].tolist()
