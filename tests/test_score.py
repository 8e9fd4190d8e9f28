import random

import pytest
from plain import identify, points
from pyspark.sql import functions as F

from tablewarden import get_suite
from tablewarden.operators import parse, review, score
from tablewarden.types import SUBMISSIONS, TRUTH

TYPES = ["missing_value", "wrong_type", "out_of_range", "format_violation", "inconsistent_value", "statistical_outlier", "duplicate_row"]
VALUES = ["", " ", "5", "5.02", "4.2", "3", "9", "-5", "0", "nan", "inf", "abc", "a longer text", "2024-01-02x", "1_0", "12d", "ABC"]


@pytest.mark.parametrize("kind", [*TYPES, None])
def test_grades_match_plain_python(spark, kind):
    cases = [(p, c) for p in VALUES for c in ["5", "0", "abc", "2024-01-02", "-5", None, "nan", ""]]
    rows = [(i, p, c, kind) for i, (p, c) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, proposed string, clean_value string, issue_type string").repartition(5)
    got = {r.i: r.score for r in score.with_grades(df).collect()}
    for i, p, c, _ in rows:
        assert got[i] == points(kind, p, c), (kind, p, c)


def test_random_submissions_match_plain_python(spark):
    rng = random.Random(7)
    truth, plans = [], []
    for d in ("a", "b", "empty"):
        cells = [] if d == "empty" else rng.sample([(r, c) for r in range(1, 8) for c in ("x", "Y")], 6)
        for seq, (r, c) in enumerate(cells):
            truth.append((d, r, c, rng.choice(TYPES), "t", rng.choice([1.0, 1.5, 2.5, 3.0]), rng.choice(["5", "abc", None]), seq))
    subs = []
    for e in range(40):
        d = rng.choice(["a", "b", "empty"])
        for step in (1, 2, 3):
            due = [t for t in truth if t[0] == d]
            said = [(t[1], t[2].lower(), t[3]) for t in rng.sample(due, rng.randint(0, len(due)))]
            said += [(rng.randint(1, 9), "x", rng.choice(TYPES)) for _ in range(rng.randint(0, 2))]
            fixes = [(rng.randint(1, 8), rng.choice("xy"), rng.choice(VALUES).strip()) for _ in range(rng.choice([0, 0, 3, 6]))]
            issues = [f"row:{r},col:{c},issue:{k}" for r, c, k in said] + ["junk"]
            subs.append((f"e{e}", step, d, issues, [f"row:{r},col:{c},fix:{v}" for r, c, v in fixes]))
            plans.append((f"e{e}", step, d, set(said), [f for f in fixes if f[2]], bool(fixes)))
    t = spark.createDataFrame(truth, TRUTH)
    s = spark.createDataFrame(subs, SUBMISSIONS)
    for df in (s.repartition(1), s.repartition(17)):
        got = {(r.episode_id, r.step): r for r in score.score_steps(df, t, decimals=None).collect()}
        best = {}
        assert len(got) == len(subs)
        for e, step, d, said, fixes, has in plans:
            due = [x for x in truth if x[0] == d]
            want = identify(said, [((x[1], x[2].lower(), x[3]), x[5]) for x in due])
            cell = {(x[1], x[2].lower()): x for x in due}
            top = {}
            for r, c, v in fixes:
                x = cell.get((r, c))
                p = points(x[3] if x else None, v, x[6] if x else None)
                top[(r, c)] = max(p, top.get((r, c), 0.0))
            total = sum(x[5] for x in due)
            fix = sum(p * cell[k][5] for k, p in top.items() if k in cell) / total if total else (0.0 if fixes else 1.0)
            reward = 0.6 * want["score"] + 0.4 * fix if has else want["score"]
            best[e] = max(best.get(e, 0.0), reward)
            row = got[(e, step)]
            assert (row.tp, row.fp, row.fn) == (want["tp"], want["fp"], want["fn"])
            assert row.f1 == pytest.approx(want["f1"]) and row.identify_score == pytest.approx(want["score"])
            assert row.fix_score == pytest.approx(fix) and row.combined_reward == pytest.approx(reward)
            assert row.best_score == pytest.approx(best[e]) and 0.001 <= row.reward <= 0.999
            assert row.done == (want["f1"] >= 0.999 or step >= 3)


def keys(truth, skip=()):
    return [f"row:{r.row_id},col:{r.col},issue:{r.issue_type}" for r in truth if (r.row_id, r.col) not in skip]


# What two demonstration steps report and repair, and the scores they earn.
DEMOS = {
    "easy": dict(
        first=[(4, "name"), (7, "salary"), (11, "department"), (15, "email")], wrong=["row:3,col:email,issue:format_violation"],
        fixes=[(4, "name", "David Kim"), (7, "salary", "75000"), (11, "department", "Engineering"),
               (15, "email", "oscar.rivera@company.com"), (12, "start_date", "2022-11-03")],
        scores=(0.6792, 1.0, 0.8, 0.92, 0.92)),
    "medium": dict(
        first=[(5, "total"), (10, "category"), (10, "quantity"), (12, "order_date"), (29, "product_name"), (24, "status")], wrong=[],
        fixes=[(5, "total", "42.00"), (10, "category", "Sports"), (10, "quantity", "10"), (12, "order_date", "2024-01-26"),
               (24, "status", "delivered"), (29, "product_name", "Wireless Charger"), (21, "unit_price", "24.99")],
        scores=(0.85, 1.0, 0.8435, 0.9374, 0.9374)),
    "hard": dict(
        first=[(14, "training_time_hours"), (13, "learning_rate"), (9, "batch_size"), (10, "train_size")],
        wrong=["row:15,col:model_name,issue:missing_value"], both=True, skip=[(15, "model_name")],
        fixes=[(9, "batch_size", "256"), (14, "training_time_hours", "72.0"), (15, "model_name", "whisper-small")],
        scores=(0.4235, 0.9172, 0.2045, 0.6321, 0.6321)),
    "alignment": dict(
        first=[(6, "response"), (15, "response"), (28, "prompt"), (20, "response"), (7, "prompt"), (25, "response"), (3, "response")],
        wrong=[], fixes=[(4, "response", None), (3, "response", None)], scores=(0.6875, 1.0, 0.1746, 0.6698, 0.6875)),
    "moderation": dict(
        first=[(16, "hate"), (17, "harassment"), (20, "violence"), (13, "violence"), (15, "text"), (30, "text")], wrong=[],
        fixes=[(16, "hate", "1"), (17, "harassment", "1"), (20, "violence", "1"), (22, "self_harm", "1"), (5, "hate", "0"),
               (24, "hate", "1"), (25, "violence", "0"), (13, "violence", "0")],
        scores=(0.6667, 1.0, 0.8421, 0.9368, 0.9368)),
}


@pytest.mark.parametrize("name", DEMOS)
def test_demonstrations_earn_the_known_scores(spark, name):
    demo, (_, _, truth) = DEMOS[name], get_suite(name).load(spark)
    rows = truth.collect()
    clean = {(r.row_id, r.col): r.clean_value for r in rows}
    first = [k for r, k in zip(rows, keys(rows)) if (r.row_id, r.col) in demo["first"]] + demo["wrong"]
    second = keys(rows, demo.get("skip", ())) + (demo["wrong"] if demo.get("both") else [])
    fixes = [f"row:{r},col:{c},fix:{clean[(r, c)] if v is None else v}" for r, c, v in demo["fixes"]]
    subs = spark.createDataFrame([("demo", 1, name, first, []), ("demo", 2, name, second, fixes)], SUBMISSIONS)
    one, two = score.score_steps(subs, truth).orderBy("step").collect()
    got = (one.identify_score, two.identify_score, two.fix_score, two.combined_reward, two.best_score)
    assert got == pytest.approx(demo["scores"], abs=1e-4)


@pytest.fixture
def small(spark):
    truth = spark.createDataFrame([
        ("d", 1, "a", "missing_value", "empty a", 1.0, "x", 0), ("d", 2, "b", "out_of_range", "b too large", 3.0, "10", 1),
    ], TRUTH)
    subs = spark.createDataFrame([
        ("e", 1, "d", ["row:1,col:a,issue:missing_value", "row:9,col:a,issue:wrong_type", "row:9,col:a,issue:odd", "?"],
         ["row:1,col:a,fix:y", "row:5,col:a,fix:z"]),
        ("e", 2, "d", ["row:1,col:a,issue:missing_value", "row:2,col:b,issue:out_of_range"], []),
    ], SUBMISSIONS)
    return subs, truth


def test_flags(small):
    subs, truth = small
    got = {(r.step, r.type, r.item) for r in review.review_flags(subs, truth).collect()}
    assert got == {
        (1, "possible_unplanted_issue", "row:9,col:a,issue:wrong_type"), (1, "partial_fix", "row:1,col:a"),
        (1, "missed_hard_issue", "row:2,col:b,issue:out_of_range"),
    }


def test_feedback_names_right_wrong_and_missed(small):
    subs, truth = small
    texts = {r.step: r.feedback for r in review.step_feedback(subs, truth, score.score_steps(subs, truth)).collect()}
    assert texts[1].startswith("submission 1 of at most 3\n\n== faults reported ==\n3 reported: 1 right, 2 wrong; 1 planted ones not found\n")
    assert "right: row:1,col:a,issue:missing_value\n" in texts[1]
    assert "wrong: row:9,col:a,issue:odd, row:9,col:a,issue:wrong_type\n" in texts[1]
    assert "  row:1,col:a: in part, valid fix (non-empty value for missing field)" in texts[1]
    assert "  row:5,col:a: none, not an issue cell" in texts[1]
    assert "Parse errors (1): Could not parse issue: '?'" in texts[1] and "still hidden: 1\n" in texts[1]
    assert "== for a reviewer: 3 ==" in texts[1] and "no repairs proposed" not in texts[1]
    assert "episode ended, best reward 1.000" in texts[2] and "no repairs proposed" in texts[2]


def test_cell_states_and_replay(small):
    subs, truth = small
    sheet = score.score_steps(subs, truth)
    states = {(r.step, r.row_id, r.col): (r.status, r.fix_status, r.proposed) for r in review.cell_status(subs, truth, sheet).collect()}
    assert states[(1, 1, "a")] == ("TP", "~FIX", "y") and states[(1, 9, "a")] == ("FP", None, None)
    assert states[(1, 5, "a")] == (None, "WRONG", "z") and (1, 2, "b") not in states
    replay = review.episode_replay(sheet, truth).orderBy("step").collect()
    assert [(r.step, r.label, r.tp, r.fn) for r in replay] == [(0, "initial", 0, 2), (1, "identify + fix", 1, 1), (2, "identify only", 2, 0)]


def test_missed_cells_show_once_the_episode_is_done(spark, small):
    subs, truth = small
    third = subs.where("step = 1").withColumn("step", F.lit(3))
    sheet = score.score_steps(third, truth)
    states = {(r.row_id, r.col): r.status for r in review.cell_status(third, truth, sheet).collect()}
    assert sheet.first().done and states[(2, "b")] == "MISS"


def test_missed_faults_of_a_large_truth_table(no_broadcast, small):
    subs, truth = small
    got = {(r.step, r.item) for r in review.review_flags(subs, truth).where("type = 'missed_hard_issue'").collect()}
    assert got == {(1, "row:2,col:b,issue:out_of_range")}


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_missed_faults_per_episode_equal_the_flags_counted(spark, limit):
    """Also for keys that every submission of an episode named, repeated submissions, and episodes, steps and datasets without a name."""
    draw = random.Random(3)
    truth = [(d, i, c, "missing_value", f"{c} of {i % 5}", draw.choice([1.0, 2.5, 3.0]), "x", n) for n, (d, i, c) in enumerate((d, i, c) for d in "pq" for i in range(12) for c in "ab")]
    subs = []
    for e in ["e1", "e2", "e3", None]:
        for step in [1, 2, 2, None]:
            d = draw.choice(["p", "q", "r", None])
            named = [f"row:{i},col:a,issue:missing_value" for i in range(draw.choice([0, 3, 12]))] + [f"row:{i},col:b,issue:missing_value" for i in draw.sample(range(12), 5)]
            subs.append((e, step, d, named, []))
    subs += [("all", 1, "p", [f"row:{i},col:{c},issue:missing_value" for i in range(12) for c in "ab"], [])]
    truth, subs = spark.createDataFrame(truth, TRUTH), spark.createDataFrame(subs, SUBMISSIONS)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        reports = parse.parse_reports(subs)
        flags = review.missed_hard_flags(subs, reports, truth)
        want = flags.groupBy("episode_id").agg(F.count(F.lit(1)), F.min("item"), F.max("reason")).collect()
        got = review.missed_hard_flags(subs, reports, truth, per="episode_id").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and "all" not in {r[0] for r in got} and len(got) > 2
    finally:
        spark.conf.set(key, before)


def test_missed_cells_are_not_grouped_again(spark, small, monkeypatch):
    """Cells that nobody touched are as many as submissions times faults: they come out of the layout as they are."""
    subs, truth = small
    third = subs.where("step = 1").withColumn("step", F.lit(3))
    laid = []
    keep = review._laid_out
    monkeypatch.setattr(review, "_laid_out", lambda *a: laid.append(keep(*a)) or laid[-1])
    states = review.cell_status(third.unionByName(third), truth, third.select("episode_id", "step", "dataset", F.lit(True).alias("done")))
    assert [(r.row_id, r.col) for r in laid[0].collect()] == [(2, "b")]
    assert sorted((r.row_id, r.col, r.status) for r in states.collect() if r.status) == [(1, "a", "TP"), (2, "b", "MISS"), (9, "a", "FP")]


def odd_submissions(spark):
    """Truth and submissions with repeats, and with rows, episodes, steps and datasets without a name."""
    draw = random.Random(5)
    truth = [(d, i, c, "missing_value", None if i == 7 else f"{c} of {(i or 0) % 5}", draw.choice([1.0, 2.5, 3.0]), "x", n) for n, (d, i, c) in enumerate((d, i, c) for d in "pq" for i in [*range(12), None] for c in "ab")]
    subs = []
    for e in ["e1", "e2", "e3", None]:
        for step in [1, 2, 2, None]:
            d = draw.choice(["p", "q", "r", None])
            named = [f"row:{i},col:{c},issue:{draw.choice(['missing_value', 'wrong_type'])}" for i in draw.sample(range(14), draw.choice([0, 3, 12])) for c in "ab"]
            subs += [(e, step, d, named, [f"row:{draw.randrange(12)},col:a,fix:y"])] * draw.choice([1, 2])
    return spark.createDataFrame(subs, SUBMISSIONS), spark.createDataFrame(truth, TRUTH)


@pytest.fixture(params=["10485760", "-1"])
def limited(spark, request):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield spark
    spark.conf.set(key, before)


def test_counted_cells_equal_the_cells_laid_out(limited, monkeypatch):
    """Counted states need no row per submission and planted cell."""
    subs, truth = odd_submissions(limited)
    ended = subs.select("episode_id", "step", "dataset", (F.col("step") > 1).alias("done"))
    want = review.cell_status(subs, truth, ended).groupBy("episode_id", "status").agg(F.count(F.lit(1))).collect()
    monkeypatch.setattr(review, "_laid_out", lambda *a: pytest.fail("laid out"))
    got = review.cell_status(subs, truth, ended, per="episode_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and any(r.status == "MISS" for r in got)


def test_feedback_lists_the_flags_without_laying_them_out(limited, monkeypatch):
    """Lines of missed faults come from one list per dataset; no row per submission and fault is made."""
    subs, truth = odd_submissions(limited)
    kinds, lines = ["possible_unplanted_issue", "partial_fix", "missed_hard_issue"], {}
    for r in review.review_flags(subs, truth).collect():
        line = None if r.reason is None else f"  [{r.type}] {r.item}: {r.reason}"
        lines.setdefault((r.episode_id, r.step, r.dataset), []).append((kinds.index(r.type), line))
    monkeypatch.setattr(review, "_laid_out", lambda *a: pytest.fail("laid out"))
    told = 0
    for r in review.step_feedback(subs, truth, score.score_steps(subs, truth)).collect():
        at = (r.episode_id, r.step, r.dataset)
        some = lines.get(at, []) if None not in at else []
        _, mark, tail = r.feedback.partition("\n== for a reviewer: ")
        assert bool(mark) == bool(some)
        if some:
            told += 1
            assert tail == f"{len(some)} ==\n" + "\n".join(line for _, line in sorted(x for x in some if x[1] is not None))
    assert told > 3


def test_suite_average_counts_unplayed_suites_as_zero(spark):
    episodes = spark.createDataFrame([("e", "a", 0.8)], "episode_id string, dataset string, best_score double")
    suites = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert score.suite_average(episodes, suites).first().average_score == pytest.approx(0.4)
