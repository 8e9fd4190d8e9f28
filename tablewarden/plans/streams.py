"""Catalogue: the streaming forms, run over the stored tables until their input is used up.

Results go to files in the shared folder and are read back from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..session import fresh_path
from ..streaming import findings_stream, repeated_keys, score_batches, sink_findings, stream_episodes, windowed_quality
from .base import query, s_finding
from .scoring import SCORES, submissions, truth_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events_stream(spark, sf) -> DataFrame:
    """The events file as a stream; the glob keeps other tables of the folder out."""
    schema = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(stream: DataFrame) -> DataFrame:
    """Run a stream over everything that is there, and return what it wrote."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _with_rocksdb(spark, make) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        return make()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@query("stream_findings", f"""
SELECT {s_finding('event_id', 'value', 'out_of_range')} FROM events WHERE value > 200
UNION ALL SELECT {s_finding('event_id', 'event_type', 'format_violation')} FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
""")
def stream_findings(spark, sf):
    checks = [rules.numeric_out_of_range("value", None, 200), rules.in_set("event_type", ["click", "view", "purchase", "signup"])]
    found = findings_stream(_events_stream(spark, sf), checks, "event_id")
    path = fresh_path(spark, "findings")
    sink_findings(found, path, path + "-state").awaitTermination()
    return spark.read.schema(found.schema).parquet(path).select("row_id", "col", "issue_type")


@query("stream_windowed_quality", """
WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(*) FILTER (value > 100) AS v, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1),
done AS (SELECT * FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, n AS n_rows, 'out_of_range:value' AS rule_id, v AS findings FROM done
UNION ALL SELECT strftime(h, '%Y-%m-%d %H:%M:%S'), n, 'error_event', e FROM done
""")
def stream_windowed_quality(spark, sf):
    """Hourly findings per rule; only windows that the watermark has closed are written."""
    checks = [rules.numeric_out_of_range("value", None, 100), rules.column_compare("event_type", F.col("event_type") != "error", "error_event")]
    counts = windowed_quality(_events_stream(spark, sf), checks, "ts", "1 hour", "10 minutes")
    return _drain(counts).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_rows", "rule_id", "findings")


@query("stream_repeated_keys", """
SELECT user_id, event_type, count(*) - 1 AS later_copies FROM events GROUP BY 1, 2 HAVING count(*) > 1
""")
def stream_repeated_keys(spark, sf):
    """Later rows of every (user, event type), counted per key; the keys keep their state on the executors."""
    events = _events_stream(spark, sf)
    found = _with_rocksdb(spark, lambda: _drain(repeated_keys(events, ["user_id", "event_type"], "event_id")))
    ids = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select(F.col("event_id").alias("row_id"), "user_id", "event_type")
    return found.join(ids, "row_id").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("later_copies"))


def _submission_stream(spark, sf) -> DataFrame:
    """The submissions as files that arrive at once."""
    path = fresh_path(spark, "submissions")
    made = submissions(spark, sf)
    made.write.parquet(path)
    return spark.readStream.schema(made.schema).parquet(path)


def _arrivals(made: DataFrame, batches: int, follow) -> None:
    """The submissions arrive in order of step, in several batches of any number of files; ``follow`` takes the stream of them on to the
    end of what is there after each, so that a batch is one micro-batch and is written and read by many tasks."""
    spark, path = made.sparkSession, fresh_path(made.sparkSession, "submissions")
    last = made.agg(F.max("step")).first()[0] or 1
    for i in range(batches):
        made.where(F.col("step").between(last * i // batches + 1, last * (i + 1) // batches)).write.mode("append").parquet(path)
        follow(spark.readStream.schema(made.schema).parquet(path))


@query("stream_episode_best", f"""
WITH {SCORES}, b AS (SELECT episode_id, max(identify_score) AS s, count(*) AS n FROM sheet GROUP BY 1)
SELECT episode_id, n AS steps_taken, round(s, 6)::DOUBLE AS best_score FROM b
""")
def stream_episode_best(spark, sf):
    """Steps taken and best identification score of every episode, kept as state while submissions stream in."""
    truth = truth_of(spark, sf)
    out = _with_rocksdb(spark, lambda: _drain(stream_episodes(_submission_stream(spark, sf), truth)))
    return out.groupBy("episode_id").agg(
        F.max("steps_taken").alias("steps_taken"), F.round(F.max("best_score"), 6).alias("best_score")
    )


@query("stream_batch_scores", f"""
WITH {SCORES} SELECT episode_id, step, round(combined_reward, 6)::DOUBLE AS combined_reward, round(best_score, 6)::DOUBLE AS best_score,
 round(greatest(0.001, least(0.999, best_score)), 6)::DOUBLE AS reward, f1 >= 0.999 OR step >= 3 AS done FROM sheet
""")
def stream_batch_scores(spark, sf):
    """Full scores, fixes included, over several micro-batches; the best score of an episode is carried from batch to batch."""
    truth, path = truth_of(spark, sf), fresh_path(spark, "scores")
    write = score_batches(truth, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), decimals=None)
    _arrivals(submissions(spark, sf), 3, lambda stream: stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination())
    rounded = [F.round(c, 6).alias(c) for c in ("combined_reward", "best_score", "reward")]
    return spark.read.parquet(path).select("episode_id", "step", *rounded, "done")


