import random

from pyspark.sql import functions as F

from tablewarden.llm import chat

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "\\0", "\\1", "\n", "a", "é😀", "<", "[", "s>", "INST]", " "]
SCHEMA = "conv_id long, turn long, role string, text string, turns string, pieces int"


def told(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return {r["conv_id"]: r for r in chat.read_back(chat.examples(turns)).collect()}


def order(rows):
    return sorted(((t is not None, t, r or "", x or "") for _, t, r, x in rows), key=lambda k: (k[0], k[1] or 0, k[2], k[3]))


def test_all_turns_and_replies_come_back(spark):
    draw = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "assistant", "system", None, "", "odd\n<s>\\0", "assistant "])
            rows.append((conv, draw.choice([turn, turn, 2, None]), role, draw.choice([None, "".join(draw.choices(BITS, k=draw.randint(0, 12)))])))
    rows += [(900, 0, "user", "x" * 300_000), (900, 1, "assistant", "y" * 300_000), (901, 0, "assistant", ""), (902, 0, "user", "q"), (902, 0, "user", "q")]
    got = told(spark, rows)
    for conv in {r[0] for r in rows}:
        expect = order([r for r in rows if r[0] == conv])
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, _, r, x in expect]
        assert got[conv]["replies"] == "".join(x for _, _, r, x in expect if r == "assistant")
    assert len(got) == len({r[0] for r in rows})


def test_every_reply_is_one_example_with_all_turns_before_it(spark):
    rows = [(1, 0, "system", "be [INST] good"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s>"), (1, 3, "user", "more"), (1, 4, "assistant", "é"), (1, 5, "user", "bye")]
    made = chat.examples(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).orderBy("example").collect()
    head = "<s>system\nbe [\\INST] good</s><s>user\nhi</s>"
    assert [r["text"] for r in made] == [
        head + "<s>assistant\n<\\/s></s>", head + "<s>assistant\n<\\/s></s><s>user\nmore</s><s>assistant\né</s>",
        head + "<s>assistant\n<\\/s></s><s>user\nmore</s><s>assistant\né</s><s>user\nbye</s>"]
    assert [r["text"][r["loss_start"] : r["loss_stop"]] for r in made[:2]] == ["<\\/s>", "é"]
    assert made[2]["loss_start"] is None and [r["whole"] for r in made] == [False, False, True]


def test_an_escaped_text_holds_no_control_string_and_comes_back(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choices(BITS, k=draw.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert row["b"] == row["t"] and not any(c in row["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_an_empty_table_gives_no_rows_and_no_python_runs(spark):
    turns = spark.createDataFrame([], SCHEMA)
    made = chat.digests(chat.read_back(chat.examples(turns)))
    assert made.count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1
