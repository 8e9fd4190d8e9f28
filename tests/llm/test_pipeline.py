"""The pipeline on a small fixture against stages worked out one by one, without Spark where that is exact."""

import random

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tablewarden.llm import quality, secrets
from test_bpe import expected
from test_decontaminate import plain as plain_items
from test_near import plain_kept

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with near copies, repeated rows, one id for two texts, nulls and columns of clashing names."""
    made = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    draw, rows = random.Random(2), docs.select("doc_id", "text", "lang", "source").collect()
    planted = []
    for i, row in enumerate(draw.sample([r for r in rows if len(r["text"].split()) > 80], 12)):
        words = row["text"].split(" ")
        words[len(words) // 2] = "changed"
        planted += [(10_000 + i, " ".join(words), row["lang"], row["source"])] * (1 + i % 2)
    planted += [(rows[0]["doc_id"], "another text of the same id, " + rows[3]["text"], None, None), (20_000, None, "en", "src1"), (20_001, "", None, "src1"), (20_002, " \n", "en", None)]
    more = spark.createDataFrame([(*p, len(p[1] or "")) for p in planted], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).union(more)
    extra = every.withColumns({"id": F.lit("x"), "own": F.lit(1), "quality": F.lit(0.5), "bits": F.lit("y"), "text_hash": F.lit(3), "n_tokens": F.lit(None).cast("int")})
    extra.repartition(3, "doc_id").write.parquet(f"{made}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{TABLES}/{name}.parquet").write.parquet(f"{made}/{name}.parquet")
    return made


def test_pipeline_equals_its_stages_by_brute_force(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    docs, items = read("documents"), [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    model = quality.train(docs, read("labels"))
    scored = quality.score(docs.drop("quality"), model).collect()
    rows = [(r["doc_id"], r["text"]) for r in scored if r["site_quality"]["quality"] >= 0.5]
    assert len(rows) < docs.count()
    kept = plain_kept(rows)
    assert len(kept) < len(set(rows))
    leaked = {r[:2] for r in plain_items(kept, items, texts=True)}
    rows = [r for r in kept if r not in leaked]
    chain = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = [(i, None if t is None else secrets._without(t, secrets.find_secrets(t, chain)[1], "[secret]")) for i, t in rows]
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, TABLES)
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.where("false"), TABLES).count() == 0, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
