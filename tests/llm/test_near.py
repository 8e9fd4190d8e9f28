"""Near copies by five-word shingles against all pairs."""

import random

import pytest

import corpus_pipeline
from tablewarden.llm import near


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids and texts that no similar text of a smaller id takes away."""
    made = [(i, t, plain_shingles(t)) for i, t in sorted(set(rows), key=lambda r: (r[0], r[1] or ""))]
    close = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    return [(i, t) for i, t, a in made if not any(j < i and close(a, b) for j, _, b in made)]


@pytest.mark.parametrize("frequent", [0, 50_000])
def test_rows_equal_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(near, "FREQUENT", frequent)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeé", k=5)) for _ in range(400)]
    line = " ".join(draw.choices(words, k=12))
    rows = []
    for i in range(400):
        if rows and draw.random() < 0.6:
            body = draw.choice(rows)[1].split(" ")
            for _ in range(draw.randint(1, 3)):
                body[draw.randrange(len(body))] = draw.choice(words)
        else:
            body = draw.choices(words, k=draw.choice([1, 3, 5, 6, 30, 120, 400]))
        rows.append((10 + i, " ".join(body) + f" {line}" * (draw.random() < 0.3)))
    rows += [(5, rows[20][1]), (900, None), (901, " \n"), (902, "one two"), (903, "One  two")]
    kept = near.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == plain_kept(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (None, "a b c d e f")]
    kept = near.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f"), (1, "u v w x y z"), (None, "a b c d e f"), (None, "a b c d e f")], key=str)


def test_the_stage_leaves_no_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "/root/testdata/sf0.001").select("doc_id", "text")
    assert sorted(map(tuple, kept.collect())) == plain_kept(rows)


def test_the_stage_drops_what_op1_groups_as_well(spark):
    """Fingerprints count repeats, sets do not: such texts are one group of ``op1`` and no near copies by their sets."""
    many = "a b c " * 60
    rows = [(2, many + "one two three four five six"), (3, many + "seven eight nine ten eleven twelve"), (4, "quite another text of some words"), (1, None)]
    assert [i for i, _ in plain_kept(rows)] == [1, 2, 3, 4]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [1, 2, 4]
