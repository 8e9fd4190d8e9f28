import math
import random
import re
import unicodedata

from tablewarden.llm import decontaminate


def grams(text, length=5):
    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    assert all(unicodedata.category(c)[0] in "LN" for w in words for c in w)
    if not words:
        return set()
    length = min(length, len(words))
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def plain(docs, items, texts=False):
    found = set()
    for doc_id, text in docs:
        words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
        for item_id, item in items:
            want = grams(item)
            if not want:
                continue
            length = len(next(iter(want)))
            have = {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}
            if len(want & have) >= math.ceil(round(0.8 * len(want), 9)):
                found.add((doc_id, text, item_id, len(want & have), len(want)))
    return found if texts else sorted(((d, i, n, m) for d, _, i, n, m in found), key=str)


def case():
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefé", k=3)) for _ in range(400)]
    some = lambda k: " ".join(draw.choices(words, k=k))
    items = [(i, some(draw.choice([5, 6, 7, 9, 12, 20, 40, 64]))) for i in range(60)] + [(60, None), (61, ""), (62, "!!"), (63, "just three words"), (64, "Single"), (None, some(9)), (5, some(8))]
    docs = []
    for i in range(250):
        parts = [some(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            item = (draw.choice(items)[1] or "").split(" ")
            for _ in range(draw.randint(0, 2)):
                item[draw.randrange(len(item))] = draw.choice(words)
            cut = draw.randint(0, len(item))
            parts += [" ".join(item[:cut]), some(draw.choice([0, 0, 3])), " ".join(item[cut:]).upper(), some(20)]
        docs.append((i, draw.choice([" ", ", ", "\n\t"]).join(" ".join(parts).split(" "))))
    docs += [(900, None), (901, ""), (902, "single"), (None, "x " + items[0][1]), (3, items[1][1]), (3, items[1][1]), (903, some(30_000) + " " + items[2][1] + " " + some(30_000))]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, item_id int, code string"),
            spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"))


def test_rows_equal_brute_force(spark):
    docs, items = case()
    found = decontaminate.contained(*frames(spark, docs, items))
    assert sorted(map(tuple, found.select("doc_id", "item_id", "n_shared", "n_item").collect()), key=str) == plain(docs, items)


def test_nothing_is_found_twice_without_broadcast(spark, no_broadcast, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(decontaminate, "join_small", lambda a, b, on, how: a.join(b.hint("shuffle_merge"), on, how))
    found = decontaminate.contained(*frames(spark, docs, items))
    assert sorted(map(tuple, found.select("doc_id", "item_id", "n_shared", "n_item").collect()), key=str) == plain(docs, items)


def test_only_contaminated_documents_go(spark):
    docs, items = case()
    gone = {r[:2] for r in plain(docs, items, texts=True)}
    kept = decontaminate.drop_contaminated(*frames(spark, docs, items))
    assert kept.columns == ["doc_id", "text", "item_id", "code"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted((d for d in docs if d not in gone), key=str)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c d e f")], [(1, "a b c d e f")])
    assert decontaminate.contained(docs, items.where("false")).count() == 0
    assert decontaminate.contained(docs.where("false"), items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.where("false")).count() == 1
