import math
import random

from pyspark.sql import functions as F

from tablewarden.llm import topk


def plain(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 10 == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_rows_equal_brute_force(spark):
    draw = random.Random(6)
    rows = [(i, [draw.choice([0.0, 0.25, -0.5, draw.uniform(-1, 1)]) for _ in range(draw.choice([6, 6, 6, 3, 0]))]) for i in range(150)]
    rows += [(200, None), (210, [1.0, None]), (220, [float("nan")]), (230, [float("inf")]), (None, [1.0]), (40, rows[40][1]), (7, rows[7][1]), (-10, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 3, 1.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    vectors = topk.usable(df)
    for k, size in [(10, 16), (3, 4096), (1000, 64)]:
        got = topk.top_k(vectors, vectors.where(F.col("vec_id") % 10 == 0), k, rows_per_block=size, queries_per_block=4)
        assert sorted(map(tuple, got.collect())) == plain(rows, k)


def test_empty_tables(spark):
    vectors = topk.usable(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors).count() == 0
    assert topk.top_k(vectors.where("false"), vectors).count() == 0
    assert topk.top_k(vectors, vectors.where("false")).count() == 0


def test_large_components_take_part(spark):
    rows = [(i, [float(3 * 2**18 + i), 0.5 * i, -float(2**40) if i == 5 else 1.0]) for i in range(30)]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(vectors, vectors.where("vec_id in (10, 20)"), 4)
    assert sorted(map(tuple, got.collect())) == [r for r in plain(rows, 4) if r[0] in (10, 20)]
