"""Scoring submissions as they arrive.

A submission is scored inside its row against the truth of its dataset, so the only state is one small record per
episode: steps taken, best score, done.  A truth table too large to sit beside the rows is joined with what was reported, key by
key, and the submission is put together again where its episode's state is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.parse import reported_issues
from ..operators.score import DONE_F1, MAX_STEPS, clamp, score_steps, truth_keys
from ..session import cut_lineage, fresh_path

TRUTH_ROWS = 50_000  # most planted faults that are folded and broadcast beside a stream; more are joined


def broadcast_truth(truth: DataFrame) -> DataFrame:
    """Truth folded to one row per dataset.  For tables of known small size; ``stream_episodes`` counts before it does so."""
    keys = truth_keys(truth).groupBy("dataset").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("row_id", "col", "issue_type"), "difficulty"))).alias("keys")
    )
    totals = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("difficulty").alias("total"))
    return keys.join(totals, "dataset")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_rows(submissions: DataFrame, folded: DataFrame) -> DataFrame:
    """Identification scores of every submission, without any shuffle of the stream."""
    reported = reported_issues(F.col("issues"))
    joined = submissions.withColumn("reported", reported).join(F.broadcast(folded), "dataset", "left")
    hits = F.filter("reported", lambda r: F.coalesce(F.map_contains_key("keys", r), F.lit(False)))
    counted = joined.withColumn("hits", hits).withColumn(
        "found", F.aggregate("hits", F.lit(0.0), lambda acc, r: acc + F.try_element_at(F.col("keys"), r))
    ).withColumns({
        "tp": F.size("hits").cast("bigint"), "n_reported": F.size("reported").cast("bigint"),
        "n_keys": F.coalesce(F.size(F.map_keys("keys")), F.lit(0)).cast("bigint"), "n": F.coalesce("n", F.lit(0)),
        "total": F.coalesce("total", F.lit(0.0)),
    })
    p, r = _ratio(F.col("tp"), F.col("n_reported")), _ratio(F.col("tp"), F.col("n_keys"))
    wr = _ratio(F.col("found"), F.col("total"))
    wp = _ratio(F.col("found"), F.col("found") + (F.col("n_reported") - F.col("tp")) * _ratio(F.col("total"), F.col("n")))
    clean = (F.col("n_reported") == 0) & (F.col("n") == 0)
    return counted.select(
        "episode_id", "step", "dataset", "issues", "fixes", "tp", (F.col("n_reported") - F.col("tp")).alias("fp"),
        (F.col("n_keys") - F.col("tp")).alias("fn"),
        F.when(clean, 1.0).otherwise(_ratio(2 * p * r, p + r)).alias("f1"),
        F.when(clean, 1.0).otherwise(_ratio(2 * wp * wr, wp + wr)).alias("identify_score"),
    )


class _Episode(StatefulProcessor):
    """Running best of one episode, in order of arrival; submissions that arrive together are taken by step."""

    max_steps = MAX_STEPS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode", "steps bigint, best double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        steps, best, done = self.state.get() if self.state.exists() else (0, 0.0, False)
        for batch in rows:
            batch = batch.sort_values("step", kind="stable")
            running = batch["score"].cummax().clip(lower=best)
            taken = steps + pd.RangeIndex(1, len(batch) + 1).to_numpy()
            ended = (batch["f1"].to_numpy() >= DONE_F1) | (taken >= self.max_steps)
            yield pd.DataFrame({
                "episode_id": key[0], "step": batch["step"].astype("Int32").array, "score": batch["score"].to_numpy(),
                "steps_taken": taken, "best_score": running.to_numpy(), "done": ended,
            })
            steps, best, done = int(taken[-1]), float(running.iloc[-1]), bool(done or ended.any())
        self.state.update((steps, best, done))

    def close(self) -> None:
        pass


class _EpisodeWithin(_Episode):
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode", "steps bigint, best double, done boolean", ttlDurationMs=self.ttl_ms)


class _EpisodeOfReports(_EpisodeWithin):
    """The same from one row per reported key: the counts of each submission, named by an id of its own, are summed here first."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sums = pd.concat([
            part.groupby(["step", "submission"], dropna=False).agg(n_reported=("reported", "sum"), tp=("hit", "sum"), found=("difficulty", "sum"), n_keys=("n_keys", "max"), n=("n", "max"), total=("total", "max"))
            for part in rows])
        sums = sums.groupby(level=[0, 1], dropna=False).agg({"n_reported": "sum", "tp": "sum", "found": "sum", "n_keys": "max", "n": "max", "total": "max"})
        ratio = lambda a, b: (a / b.where(b != 0)).fillna(0.0)
        p, r, wr = ratio(sums.tp, sums.n_reported), ratio(sums.tp, sums.n_keys), ratio(sums.found, sums.total)
        wp = ratio(sums.found, sums.found + (sums.n_reported - sums.tp) * ratio(sums.total, sums.n))
        clean = (sums.n_reported == 0) & (sums.n == 0)
        scored = pd.DataFrame({
            "step": pd.array(pd.to_numeric(sums.index.get_level_values(0)), dtype="Int32"), "score": ratio(2 * wp * wr, wp + wr).mask(clean, 1.0).to_numpy(), "f1": ratio(2 * p * r, p + r).mask(clean, 1.0).to_numpy(),
        })
        yield from super().handleInputRows(key, iter([scored]), timer_values)


def report_rows(submissions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per submission and distinct reported key, at least one per submission, joined with the truth of any size."""
    reported = reported_issues(F.col("issues"))
    named = submissions.select("episode_id", "step", "dataset", F.expr("uuid()").alias("submission"), reported.alias("reported"))
    rows = named.select("episode_id", "step", "dataset", "submission", F.explode_outer("reported").alias("r")).select("episode_id", "step", "dataset", "submission", "r.*", F.col("r").isNotNull().cast("bigint").alias("reported"))
    keys = truth_keys(truth).select("dataset", "row_id", "col", "issue_type", F.col("difficulty").cast("double").alias("difficulty"), F.lit(1).cast("bigint").alias("hit"))
    counts = truth_keys(truth).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_keys"))
    totals = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("difficulty").cast("double").alias("total")).join(counts, "dataset")
    joined = rows.join(keys, ["dataset", "row_id", "col", "issue_type"], "left").join(totals, "dataset", "left")
    return joined.select(
        "episode_id", "step", "submission", "reported", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("hit", "bigint"), ("difficulty", "double"), ("n_keys", "bigint"), ("n", "bigint"), ("total", "double"))])


def stream_episodes(
    submissions: DataFrame, truth: DataFrame, ttl_ms: int | None = None, max_steps: int = MAX_STEPS, broadcast_rows: int = TRUTH_ROWS
) -> DataFrame:
    """Running best, step count and end of every episode over a stream of identification reports.

    Needs the RocksDB state store.  With ``ttl_ms`` episodes that have been silent for so long are dropped; give it wherever a
    stream goes on for good.  A stream with it follows the clock and does not end by itself under ``availableNow``, so it is not
    the default.
    The truth may have any size: up to ``broadcast_rows`` planted faults, counted here, are broadcast; more are joined.
    """
    if truth.limit(broadcast_rows + 1).count() <= broadcast_rows:
        scored = score_rows(submissions, broadcast_truth(truth)).select("episode_id", "step", F.col("identify_score").alias("score"), "f1")
        processor = _EpisodeWithin()
    else:
        scored, processor = report_rows(submissions, truth), _EpisodeOfReports()
    processor.ttl_ms, processor.max_steps = ttl_ms, max_steps
    return scored.groupBy("episode_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="episode_id string, step int, score double, steps_taken bigint, best_score double, done boolean",
        outputMode="append", timeMode="processingTime" if ttl_ms else "none",
    )


def score_batches(
    truth: DataFrame, write: Callable[[DataFrame, int], None], state: str | None = None, **how
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that scores each micro-batch with the table scorer, fixes included.

    The best score of every episode so far is kept in the folder ``state`` (a fresh shared one by default), one table per batch
    number, so ``best_score`` and ``reward`` are those of one table that holds all batches; name the folder to go on after a
    restart.  ``write`` gets the scores and the batch number; a batch may be run again after a failure, so it should overwrite
    what it wrote for that number, as is done with the state.
    """
    place = state

    def run(batch: DataFrame, batch_id: int) -> None:
        nonlocal place
        spark = batch.sparkSession
        place = place or fresh_path(spark, "episodes")
        scored = score_steps(batch, truth, **how)
        kind = scored.schema["best_score"].dataType.simpleString()
        schema = f"episode_id {scored.schema['episode_id'].dataType.simpleString()}, before {kind}"
        if batch_id:
            before = spark.read.schema(schema).parquet(f"{place}/batch={batch_id - 1}")
        else:
            before = spark.createDataFrame([], schema)
        best = F.greatest("best_score", "before")
        full = cut_lineage(scored.join(before, "episode_id", "left").withColumn("best_score", best).withColumn("reward", clamp(F.col("best_score"))).select(*scored.columns))
        write(full, batch_id)
        now = full.groupBy("episode_id").agg(F.max("best_score").alias("before"))
        now.unionByName(before).groupBy("episode_id").agg(F.max("before").alias("before")).write.mode("overwrite").parquet(f"{place}/batch={batch_id}")

    return run


def keep_until_done(step_scores: DataFrame) -> DataFrame:
    """The submissions of a score sheet up to and with the first that ended its episode; what came after it does not count."""
    ends = step_scores.where("done").groupBy("episode_id").agg(F.min("step").alias("__end"))
    return step_scores.join(ends, "episode_id", "left").where("__end IS NULL OR step <= __end").drop("__end")
