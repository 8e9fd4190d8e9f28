import random
import re

import pytest

from tablewarden.llm import repeats


def plain(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for at in range(len(words) - 12):
            key = tuple(words[at : at + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - 12):
            if i is not None and first[tuple(words[at : at + 13])] < i:
                gone |= set(range(at, at + 13))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def case():
    draw = random.Random(4)
    words = ["".join(draw.choices("abé", k=2)) for _ in range(30)]
    some = lambda k: draw.choices(words, k=k)
    passages = [some(draw.choice([12, 13, 14, 30, 60])) for _ in range(25)]
    rows = []
    for i in range(300):
        body = []
        for _ in range(draw.randint(0, 4)):
            body += draw.choice([some(draw.randint(0, 30)), draw.choice(passages), draw.choice(passages)[3:] + some(2)])
        rows.append((draw.choice([i, i, i, 300 - i]), draw.choice([" ", "\n", " \t "]).join(body)))
    rows += [(800, None), (801, ""), (802, "a\x1cb " * 20), (803, "a\x1cb " * 20), (None, " ".join(passages[3])), (-5, " ".join(passages[4] * 2)), (7, "same " * 40), (8, "same " * 400), (804, " ".join(some(20_000) + passages[5]))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_chars,shard", [(400, 50_000), (10**7, 40)])
def test_rows_equal_brute_force(spark, monkeypatch, block_chars, shard):
    from tablewarden.session import cut_lineage

    monkeypatch.setattr(repeats, "SHARD_WORDS", shard)
    rows = case()
    docs = cut_lineage(spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, n_words int, block string").repartition(3))
    got = repeats.remove_repeats(docs, block_chars=block_chars).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3]).decode()) for r in got), key=str) == plain(rows)


def test_automaton_finds_every_window():
    draw = random.Random(1)
    pieces = [[draw.choice("ab") for _ in range(draw.randint(3, 12))] for _ in range(60)]
    automaton = repeats.Automaton()
    for i, piece in enumerate(pieces):
        automaton.add(piece, 100 - i)
    automaton.close()
    for words in pieces + [[draw.choice("abc") for _ in range(30)] for _ in range(20)]:
        want = []
        for at in range(len(words) - 3):
            own = words[at : at + 4]
            want.append(min((100 - i for i, p in enumerate(pieces) if any(p[k : k + 4] == own for k in range(len(p) - 3))), default=None))
        assert automaton.stream(words, 4) == want


def test_an_empty_table_gives_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block_chars", [400, 10**7])
def test_crowded_minimizers_are_dealt_by_window(spark, block_chars):
    from tablewarden.session import cut_lineage

    rows = case()
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = repeats.remove_repeats(docs, block_chars=block_chars, most_pieces=2).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3]).decode()) for r in got), key=str) == plain(rows)


def test_pieces_split_into_single_windows():
    draw = random.Random(6)
    text = " ".join(draw.choices("abcdefgh", k=60))
    pieces, whole = repeats.Pieces([text, "x " + text]), repeats.Pieces([text])
    crowded = repeats._signed(pieces.minimizer)
    pieces.split(crowded)
    assert (pieces.last == pieces.first).all() and len(pieces.first) == 48 + 49
    assert (pieces.hash[:48] == pieces.hash[49:]).all() and len(set(pieces.hash.tolist())) == 49
    assert whole.text(0).split() == text.encode().split()[: whole.last[0] + 13]


def test_words_that_no_piece_has_match_nothing():
    automaton = repeats.Automaton()
    automaton.add(list("aaa"), 0)
    automaton.close()
    assert automaton.stream(list("xbba"), 3) == [None, None]
