import pytest
from pyspark.sql import functions as F

from tablewarden.operators import rules, score
from tablewarden.plans.streams import ROCKS
from tablewarden.streaming import broadcast_truth, findings_stream, first_rows, repeated_keys, score_rows, stream_episodes, windowed_quality
from tablewarden.types import SUBMISSIONS, TRUTH


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drain(stream, tmp_path, mode="append"):
    name = "out_" + tmp_path.name.replace("-", "_")
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode(mode)
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def files(spark, tmp_path, batches, schema):
    """One file per batch, read one by one in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_findings_on_a_stream(spark, tmp_path):
    src = files(spark, tmp_path, [[(1, "x"), (2, "")], [(3, " ")]], "row_id long, a string")
    assert {r.row_id for r in drain(findings_stream(src, [rules.missing_value("a")]), tmp_path)} == {2, 3}


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    day = "2024-01-01 "
    batches = [[(1, day + "00:10:00", 5), (2, day + "00:20:00", -1)], [(3, day + "03:00:00", 1)], [(6, day + "03:05:00", 1)], [(4, day + "00:30:00", -1)], [(5, day + "06:00:00", 1)]]
    src = files(spark, tmp_path, batches, "row_id long, t string, v long").withColumn("t", F.to_timestamp("t"))
    out = drain(windowed_quality(src, [rules.numeric_out_of_range("v", 0)], "t"), tmp_path)
    assert [(r.window_start.hour, r.n_rows, r.findings) for r in sorted(out, key=lambda r: r.window_start)][:1] == [(0, 2, 1)]


def test_repeated_keys_are_remembered_between_batches(rocks, tmp_path):
    src = files(rocks, tmp_path, [[(1, "a"), (2, "b")], [(3, "a")], [(4, "a"), (5, "c")]], "row_id long, k string")
    got = {(r.row_id, r.first_id) for r in drain(repeated_keys(src, ["k"]), tmp_path)}
    assert got == {(3, 1), (4, 1)}


def test_repeated_keys_without_a_row_id(rocks, tmp_path):
    big = (1 << 60) + 1
    src = files(rocks, tmp_path, [[(None, "a"), (big, "b")], [(3, "a"), (None, "b")], [(big + 1, "b")]], "row_id long, k string")
    got = {(r.row_id, r.first_id) for r in drain(repeated_keys(src, ["k"]), tmp_path)}
    assert got == {(3, None), (None, big), (big + 1, big)}


def test_only_the_first_row_of_a_key_stays(rocks, tmp_path):
    day = "2024-01-01T00:{:02d}:00"
    src = files(rocks, tmp_path, [[(1, "a", day.format(0)), (2, "b", day.format(1))], [(3, "a", day.format(2)), (4, "c", day.format(3))], [(5, "b", day.format(4))]], "row_id long, k string, ts string")
    got = sorted(r.row_id for r in drain(first_rows(src, ["k"], "ts", "1 hour"), tmp_path))
    assert got == [1, 2, 4]


@pytest.fixture
def truth(spark):
    return spark.createDataFrame([("d", 1, "a", "missing_value", "t", 1.0, "x", 0), ("d", 2, "b", "wrong_type", "t", 3.0, "1", 1)], TRUTH)


SUBS = [
    [("e", 1, "d", ["row:2,col:b,issue:wrong_type"], []), ("f", 1, "d", [], [])],
    [("e", 2, "d", ["row:9,col:b,issue:wrong_type"], [])],
    [("e", 3, "d", ["row:1,col:a,issue:missing_value", "row:2,col:b,issue:wrong_type"], [])],
]


def test_row_scores_equal_table_scores(spark, truth):
    subs = spark.createDataFrame([s for batch in SUBS for s in batch], SUBMISSIONS)
    rows = {(r.episode_id, r.step): (r.tp, r.fp, r.fn, r.f1, r.identify_score) for r in score_rows(subs, broadcast_truth(truth)).collect()}
    table = {(r.episode_id, r.step): (r.tp, r.fp, r.fn, r.f1, r.identify_score) for r in score.score_steps(subs, truth, decimals=None).collect()}
    assert rows.keys() == table.keys()
    for k in rows:
        assert rows[k] == pytest.approx(table[k])


def test_episodes_keep_their_best_between_batches(rocks, tmp_path, truth):
    out = drain(stream_episodes(files(rocks, tmp_path, SUBS, SUBMISSIONS), truth), tmp_path)
    e = {r.step: r for r in out if r.episode_id == "e"}
    first = e[1].best_score
    assert 0 < first < 1 and e[2].score == 0 and e[2].best_score == first and not e[2].done
    assert e[3].best_score == 1.0 and e[3].done and e[3].steps_taken == 3
    assert [r.best_score for r in out if r.episode_id == "f"] == [0.0]


def test_episodes_score_alike_when_the_truth_is_joined(rocks, tmp_path, truth):
    subs = files(rocks, tmp_path, SUBS, SUBMISSIONS)
    joined = drain(stream_episodes(subs, truth, broadcast_rows=0), tmp_path / "a")
    folded = drain(stream_episodes(subs, truth), tmp_path / "b")
    values = lambda rows: sorted((r.episode_id, r.step, r.steps_taken, round(r.best_score, 9), round(r.score, 9), r.done) for r in rows)
    assert values(joined) == values(folded) and len(joined) == 4


def test_batches_carry_the_best_score(spark, truth):
    from tablewarden.streaming import keep_until_done, score_batches

    whole = score.score_steps(spark.createDataFrame([s for batch in SUBS for s in batch], SUBMISSIONS), truth)
    written = {}
    run = score_batches(truth, lambda df, n: written.update({n: df.collect()}))
    for n in (0, 1, 1, 2):  # one batch is run again
        run(spark.createDataFrame(SUBS[n], SUBMISSIONS), n)
    got = {(r.episode_id, r.step): (r.best_score, r.reward, r.done) for rows in written.values() for r in rows}
    assert got == {(r.episode_id, r.step): (r.best_score, r.reward, r.done) for r in whole.collect()}
    sheet = spark.createDataFrame([("e", 1, False), ("e", 2, True), ("e", 3, True), ("f", 1, False)], "episode_id string, step int, done boolean")
    assert sorted((r.episode_id, r.step) for r in keep_until_done(sheet).collect()) == [("e", 1), ("e", 2), ("f", 1)]


def test_repeated_and_null_steps_score_alike(rocks, tmp_path, truth):
    at = [c.split()[0] for c in SUBMISSIONS.split(", ")].index("step")
    rows = [(*r[:at], step, *r[at + 1 :]) for batch in SUBS for r in batch for step in (1, None)]
    subs = files(rocks, tmp_path, [rows], SUBMISSIONS)
    joined = drain(stream_episodes(subs, truth, broadcast_rows=0), tmp_path / "a")
    folded = drain(stream_episodes(subs, truth), tmp_path / "b")
    values = lambda out: sorted((r.episode_id, str(r.step), round(r.score, 9)) for r in out)
    taken = lambda out: sorted((r.episode_id, r.steps_taken) for r in out)
    assert values(joined) == values(folded) and taken(joined) == taken(folded) and len(joined) == len(rows)


def test_a_batch_arrives_in_many_files_and_in_order_of_step(spark, tmp_path):
    from pyspark.sql import functions as F

    from tablewarden.plans import streams

    made, seen = spark.range(1, 91, 1, 4).select(F.col("id").cast("int").alias("step")), []

    def take(df, n):
        seen.append((n, *df.agg(F.min("step"), F.max("step"), F.count(F.lit(1))).first(), df.select(F.input_file_name()).distinct().count()))

    streams._arrivals(made, 3, lambda stream: stream.writeStream.foreachBatch(take).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    assert [s[:4] for s in seen] == [(0, 1, 30, 30), (1, 31, 60, 30), (2, 61, 90, 30)]
    assert all(s[4] >= 2 for s in seen[:1])
