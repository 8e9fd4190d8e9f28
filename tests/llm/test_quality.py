import math
from collections import defaultdict

import numpy as np
import pytest

from tablewarden.llm import quality

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")


def test_held_out_labels_are_told_apart(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "site_quality").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["site_quality"]["quality"] >= 0.5 for r in good) / len(good) > 0.98
    assert sum(r["site_quality"]["quality"] < 0.5 for r in bad) / len(bad) > 0.95


def plain(rows, model):
    """Posterior of every row, worked out with loops."""
    import pandas as pd

    expit = lambda z: 1 / (1 + math.exp(-z))
    own = [float(model.logits(pd.Series([t]))[0]) for _, t, _, _ in rows]
    path_n, path_s, host_n, host_s = (defaultdict(float) for _ in range(4))
    for (_, _, path, host), z in zip(rows, own):
        path_n[host, path] += 1
        path_s[host, path] += expit(z)
        host_n[host] += 1
        host_s[host] += expit(z)
    n = sum(host_n.values())
    mean = min(max(sum(host_s.values()) / n, 0.001), 0.999)
    k = quality.strength(len(host_n), n, sum(v * v for v in host_n.values()), sum(v * (host_s[h] / v - mean) ** 2 for h, v in host_n.items()), mean)
    rate = {h: (k * mean + host_s[h]) / (k + v) for h, v in host_n.items()}
    k2 = quality.strength(len(path_n), n, sum(v * v for v in path_n.values()), sum(v * (path_s[key] / v - rate[key[0]]) ** 2 for key, v in path_n.items()), mean)
    base = math.log(model.base / (1 - model.base))
    out = []
    for (i, _, path, host), z in zip(rows, own):
        around = (k * mean + host_s[host] - expit(z)) / (k + host_n[host] - 1)
        prior = (k2 * around + path_s[host, path] - expit(z)) / (k2 + path_n[host, path] - 1)
        prior = min(max(prior, 0.02), 0.98)
        out.append((i, expit(z - base + math.log(prior / (1 - prior)))))
    return sorted(out, key=str)


def test_posteriors_equal_the_plain_sums(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").limit(150).collect()]
    rows += [(5, None, None, None), (None, "", "en", None), (7, "a | b | c", "en", "new"), (7, "a | b | c", "en", "new")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, lang string, source string, own int, quality string")
    scored = quality.score(df, model)
    assert scored.columns == [*df.columns, "site_quality"]
    got = sorted(((r["doc_id"], r["site_quality"]["quality"]) for r in scored.collect()), key=lambda r: str(r[0]))
    want = sorted(plain(rows, model), key=lambda r: str(r[0]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(sorted(g[1] for g in got), sorted(w[1] for w in want))
    assert quality.score(df.where("false"), model).count() == 0
    assert quality.keep_good(df, model).columns == df.columns


def test_labels_of_one_kind_or_none_give_a_flat_model(spark, tables):
    docs, labels = tables
    for some in [labels.where("false"), labels.where("quality = 1")]:
        model = quality.train(docs, some)
        import pandas as pd

        assert len(set(model.logits(pd.Series(["a", "b c d", None])))) == 1


def test_sparse_sites_stay_near_the_global_share():
    assert quality.strength(10, 1000, 100_000, 0.0, 0.8) == pytest.approx(999)
    assert quality.strength(2, 1000, 500_000, 1000 * 0.16, 0.8) == pytest.approx(1)
