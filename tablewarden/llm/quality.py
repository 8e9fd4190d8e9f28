"""Quality classifier by hierarchical empirical Bayes.

A logistic model of the text's shape, trained on labelled rows, gives each document its own evidence.  Grouped sums of its
probabilities give every host, and every path within a host, a share of good documents; sparse hosts are shrunk toward the
global share and sparse paths toward their host, by strengths estimated from the spread between groups.  A document's
posterior joins its evidence with the prior of its path, from which its own part is taken out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_small, rows_of, split_words

MARKS = "#$%&*|!?;:<>{}[]()=_~^/\\@+"
SHAPES = ["words", "distinct", "repeats", "top_word", "word_length", "lone", "stops", "commas", "digits", "marks", "mark_kinds", "line_length"]


def shape(text: str | None) -> list[float]:
    """Features of a whole text; null and empty texts give zeros."""
    words = split_words(text or "")
    if not words:
        return [0.0] * len(SHAPES)
    n, chars, counts = len(words), len(text), Counter(words)
    marks = [text.count(m) for m in MARKS]
    return [
        math.log1p(n), len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, math.log(sum(map(len, words)) / n),
        sum(not w[0].isalnum() and len(w) == 1 for w in counts) / len(counts), text.count(".") / n, text.count(",") / n, sum(map(text.count, "0123456789")) / chars,
        sum(marks) / n, sum(m > 0.01 * n for m in marks), math.log1p(chars / (text.count("\n") + 1)),
    ]


@dataclass(frozen=True)
class ShapeModel:
    """Logistic model on standardised shapes; ``base`` is the share of good rows it was trained on."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    base: float

    def logits(self, texts: pd.Series) -> np.ndarray:
        if len(texts) == 0:
            return np.zeros(0)
        x = (np.array([shape(t) for t in texts]) - self.centre) / self.spread
        return np.clip(np.column_stack([np.ones(len(x)), x, np.minimum(x * x, 25)]) @ self.weights, -30, 30)


def fit_shapes(shapes: np.ndarray, good: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> ShapeModel:
    """Penalised maximum likelihood by Newton steps.  Without rows of both kinds the model says the smoothed share of good ones."""
    base = (good.sum() + 1) / (len(good) + 2)
    width = 2 * len(SHAPES) + 1
    start = np.zeros(width)
    start[0] = math.log(base / (1 - base))
    if len(good) == 0 or good.min() == good.max():
        return ShapeModel(np.zeros(len(SHAPES)), np.ones(len(SHAPES)), start, base)
    centre, spread = shapes.mean(0), shapes.std(0) + 1e-9
    z = (shapes - centre) / spread
    x, w = np.column_stack([np.ones(len(z)), z, np.minimum(z * z, 25)]), start
    ridge = np.diag([1e-6] + [penalty] * (width - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (good - p) - ridge @ w)
        w = w + step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return ShapeModel(centre, spread, w, base)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 10_000) -> ShapeModel:
    """Fit on at most ``most`` labelled documents: those whose id hashes lowest, a draw that depends on the ids alone.

    Rows with null id or label are left out; an id labelled both ways counts for both.
    """
    marked = rows_of(labels, doc_id=F.col(id_col).cast("bigint"), good=F.col(label_col).cast("double")).dropna().distinct()
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most)

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"good": frame["good"], "x": [shape(t) for t in frame["text"]]})

    found = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=text_col).join(F.broadcast(drawn), "doc_id").mapInPandas(shapes, "good double, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(SHAPES))
    return fit_shapes(x, found["good"].to_numpy(dtype=float))


def strength(groups: float, n: float, n2: float, gap: float, mean: float) -> float:
    """Pseudo-documents of a beta prior: from the weighted squared gap between group shares and their prior mean (moments)."""
    room = mean * (1 - mean)
    free = n - n2 / n - (groups - 1) if n else 0
    rho = (gap - (groups - 1) * room) / (room * free) if room * free > 0 else 0.0
    rho = min(max(rho, 0.001), 0.5)
    return 1 / rho - 1


def site_priors(scored: DataFrame) -> DataFrame:
    """From ``host, path, p`` per document: ``host, path, n, s``, ``host_n, host_s`` and the two strengths ``host_strength, strength`` per
    path, with the share ``mean`` of all (a stored table).

    The sums are partial before they are shuffled, so a host with a third of all rows costs one row per task.
    """
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.count(F.lit(1)).alias("g"), F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = (total["s"] or 0.0) / total["n"] if total["n"] else 0.5
    mean = min(max(mean, 0.001), 0.999)
    spread = lambda df, n, s, prior: df.agg(
        F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(F.col(n).cast("double") * F.col(n)).alias("n2"),
        F.sum(n * (F.col(s) / F.col(n) - prior) ** 2 if isinstance(n, Column) else F.col(n) * (F.col(s) / F.col(n) - prior) ** 2).alias("gap")).first()
    at_hosts = spread(hosts, "host_n", "host_s", F.lit(mean))
    k_host = strength(at_hosts["g"], at_hosts["n"] or 0, at_hosts["n2"] or 0.0, at_hosts["gap"] or 0.0, mean)
    below = cut_lineage(paths.join(hosts, "host").withColumn("host_rate", (k_host * mean + F.col("host_s")) / (k_host + F.col("host_n"))))
    at_paths = spread(below, "n", "s", F.col("host_rate"))
    k_path = strength(at_paths["g"], at_paths["n"] or 0, at_paths["n2"] or 0.0, at_paths["gap"] or 0.0, mean)
    return below.drop("host_rate").withColumns({"strength": F.lit(k_path), "host_strength": F.lit(k_host), "mean": F.lit(mean)})


def score(docs: DataFrame, model: ShapeModel, host_col: str | Column = "source", path_col: str | Column = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the struct ``site_quality``: ``doc_score`` (the model's own probability), ``host_rate``
    and ``path_rate`` (its host's and its path's share, both without its own part) and ``quality`` (the posterior).

    ``host_col`` and ``path_col`` may be expressions, such as parts of a URL.  Null hosts and paths form groups of their own;
    null and empty texts get the model's verdict on an empty text; repeated rows count each.  An empty table gives no rows.
    """
    @F.pandas_udf("double")
    def own_logit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.logits(texts))

    own_logit = own_logit.asNondeterministic()  # else a filter on the verdict scores every text once more
    key = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\0"))
    expit = lambda c: 1 / (1 + F.exp(-c))
    scored = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key(host_col).alias("host"), key(path_col).alias("path"), own_logit(F.col(text_col)).alias("own"))
    sites = site_priors(scored.select("host", "path", expit(F.col("own")).alias("p")))
    joined = join_small(scored, sites, ["host", "path"], "inner")
    rate = (F.col("host_strength") * F.col("mean") + F.col("host_s") - expit(F.col("own"))) / (F.col("host_strength") + F.col("host_n") - 1)
    prior = (F.col("strength") * rate + F.col("s") - expit(F.col("own"))) / (F.col("strength") + F.col("n") - 1)
    prior = F.least(F.greatest(prior, F.lit(0.02)), F.lit(0.98))
    base = math.log(model.base / (1 - model.base))
    made = F.struct(expit(F.col("own")).alias("doc_score"), rate.alias("host_rate"), prior.alias("path_rate"), expit(F.col("own") - base + F.log(prior / (1 - prior))).alias("quality"))
    return joined.select("row.*", made.alias("site_quality"))


def keep_good(docs: DataFrame, model: ShapeModel, least: float = 0.5, **where: str) -> DataFrame:
    """The documents whose posterior is at least ``least``, with their own columns only."""
    return score(docs, model, **where).where(F.col("site_quality.quality") >= least).drop("site_quality")
