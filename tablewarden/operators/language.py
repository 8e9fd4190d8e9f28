"""Languages of texts by a trained model, in place of word lists.

A text is lower-cased, everything but letters becomes one space, and every three neighbouring characters are a gram.  Grams are hashed to
a fixed number of buckets and counted per label: the model is that table, at most ``len(langs) * buckets`` numbers whatever the input.
A text gets the label under which its grams are likeliest (multinomial, one added to every count, labels equally likely beforehand).
The same works for source code, with another pattern for what is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROSE = r"[^\p{L}]+"  # what becomes one space in prose
CODE = r"[\s0-9]+"  # and in source code, where signs tell much
BUCKETS = 1 << 14
MIX = 1009  # bucket of a gram: ((a * MIX + b) * MIX + c) % buckets over its code points
UNIT = 1e6  # scores are whole millionths of a natural logarithm, so sums do not depend on their order
MOST_LABELS = 256
PIECE = 1 << 20  # characters hashed at once


@dataclass(frozen=True)
class LanguageModel:
    """Gram counts, one row per label of ``langs``."""

    langs: tuple[str, ...]
    counts: np.ndarray
    fold: str = PROSE

    @property
    def buckets(self) -> int:
        return self.counts.shape[1]


def folded(text: Column, fold: str = PROSE) -> Column:
    """The text as the model sees it, with a space at either end; empty if nothing is left of it."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), fold, " "))
    return F.when(bare != "", F.concat(F.lit(" "), bare, F.lit(" "))).otherwise("")


def gram_counts(text: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in a folded text, which is read in pieces."""
    found = np.zeros(buckets, np.int64)
    for at in range(0, max(len(text) - 2, 0), PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found += np.bincount(((c[:-2] * MIX + c[1:-1]) * MIX + c[2:]) % buckets, minlength=buckets)
    return found


def used_grams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a folded text, ascending, and how often each occurs; a text of few grams does not touch the others."""
    if len(text) > buckets // 4:
        found = gram_counts(text, buckets)
        used = np.flatnonzero(found)
        return used, found[used]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(((c[:-2] * MIX + c[1:-1]) * MIX + c[2:]) % buckets, return_counts=True)


def language_counts(
    df: DataFrame, text: str, label: str, langs: list[str], fold: str = PROSE, buckets: int = BUCKETS
) -> DataFrame:
    """``lang, bucket, n`` over all rows whose label is one of ``langs``; only non-zero counts.

    Every task sums its own rows first, so what is shuffled is at most ``len(langs) * buckets`` rows a task, and a label that most rows
    share costs no more than a rare one.  A null text counts as empty.
    """
    if not 0 < len(langs) <= MOST_LABELS or len(set(langs)) < len(langs):
        raise ValueError(f"between 1 and {MOST_LABELS} different labels are needed")
    given = df.where(F.col(label).isin(langs)).select(F.col(label).alias("lang"), folded(F.col(text), fold).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, body in zip(batch["lang"], batch["text"]):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                used, n = used_grams(body, buckets)
                sums[lang][used] += n
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": n[used]})

    return given.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def load_language_model(
    counts: DataFrame, langs: list[str], fold: str = PROSE, buckets: int = BUCKETS
) -> LanguageModel:
    """The model from counts, as made by :func:`language_counts` or read back; at most ``len(langs) * buckets`` rows reach the driver.

    Counts of several parts of the data may be appended to one another: equal keys are summed.
    """
    kept = counts.where(F.col("lang").isin(langs) & F.col("bucket").between(0, buckets - 1))
    rows = kept.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(langs), buckets), np.int64)
    table[rows["lang"].map({lang: i for i, lang in enumerate(langs)}).astype(int), rows["bucket"]] = rows["n"]
    return LanguageModel(tuple(langs), table, fold)


def fit_language_model(
    df: DataFrame, text: str, label: str, langs: list[str], fold: str = PROSE, buckets: int = BUCKETS
) -> LanguageModel:
    return load_language_model(language_counts(df, text, label, langs, fold, buckets), langs, fold, buckets)


def _millionths(share: np.ndarray) -> np.ndarray:
    return np.floor(UNIT * np.log(share) + 0.5).astype(np.int64)


def with_language_scores(
    df: DataFrame, text: str, model: LanguageModel, out: str = "by_model", counted_as: str | None = None
) -> DataFrame:
    """Add the struct ``out`` of ``lang`` (likeliest label, ties to the one listed first), ``score`` (its log likelihood in millionths),
    ``lead`` (how far the next label lies behind) and ``grams``.

    ``counted_as`` names the label column if these very rows were counted into the model: a row's own grams then leave the counts of its
    label before it is judged, so a wrong label does not speak for itself.  Texts without a gram have no ``lang``, ``score`` and
    ``lead``.  Whole texts are judged; there is no shuffle.
    """
    langs, buckets, table = model.langs, model.buckets, model.counts
    place = {lang: i for i, lang in enumerate(langs)}

    def told(texts: pd.Series, labels: pd.Series) -> pd.DataFrame:
        totals = table.sum(axis=1)
        weights = _millionths((table + 1.0) / (totals[:, None] + float(buckets)))
        rows = []
        for body, label in zip(texts, labels):
            used, n = used_grams(body, buckets)
            if not len(used):
                rows.append((None, None, None, 0))
                continue
            scores = weights[:, used] @ n
            own = place.get(label)
            if own is not None:
                left = table[own, used] - n
                if left.min() < 0:
                    raise ValueError(f"a text labelled {label} was not counted into the model")
                scores[own] = _millionths((left + 1.0) / (totals[own] - n.sum() + float(buckets))) @ n
            best = int(np.argmax(scores))
            behind = np.delete(scores, best)
            rows.append((langs[best], int(scores[best]), int(scores[best] - behind.max()) if len(behind) else 0, int(n.sum())))
        made = pd.DataFrame(rows, columns=["lang", "score", "lead", "grams"])
        return made.astype({"lang": object, "score": "Int64", "lead": "Int64", "grams": "int64"})

    judge = F.pandas_udf(told, "lang string, score bigint, lead bigint, grams bigint")
    label = F.col(counted_as) if counted_as else F.lit(None)
    return df.withColumn(out, judge(folded(F.col(text), model.fold), label.cast("string")))


def with_model_language(
    df: DataFrame, text: str, model: LanguageModel, out: str = "guessed_lang", counted_as: str | None = None,
    min_grams: int = 20, min_lead: float = 5.0,
) -> DataFrame:
    """Add the likeliest label, as ``text.with_language`` does; NULL for texts of fewer than ``min_grams`` grams, or where the next label
    is less than ``min_lead`` behind (a difference of log likelihoods)."""
    scored = with_language_scores(df, text, model, "__told", counted_as)
    clear = (F.col("__told.grams") >= min_grams) & (F.col("__told.lead") >= int(min_lead * UNIT))
    return scored.withColumn(out, F.when(clear, F.col("__told.lang"))).drop("__told")
