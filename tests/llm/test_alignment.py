import hashlib
import random
from collections import Counter

import pytest

from tablewarden.llm import alignment
from tablewarden.llm.queries import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
BITS = ["the ", "Haus", "été", " ", "  ", "\n", "\t", "日本", "😀", "▁", "<0x0A>", "<s>", "</s>", "<|endoftext|>", "12", "'s", "!", "ation", " ", "İ", "\x00"]


def plain(rows):
    """By sets of byte offsets and all pairs of tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    (_, a_bytes), (_, b_bytes) = alignment.byte_level(A), alignment.sentence_pieces(B)
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = one.encode(" " + (text or ""), add_special_tokens=False).ids, other.encode(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, made = 0, []
            for i in ids:
                made.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(made)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups = ["|".join(",".join(str(s[2]) for s in side if low < s[1] <= high) for side in spans) for low, high in zip([0, *ends], ends)]
        docs.append((doc_id, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(d, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, x in docs]


@pytest.mark.parametrize("block", [300, 10**7])
def test_groups_links_and_counts_equal_all_pairs(spark, block):
    draw = random.Random(4)
    rows = [(i, "".join(draw.choices(BITS, weights=[6] * 9 + [1] * 12, k=draw.randint(0, 30)))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "   "), (903, " lead"), (None, "no id"), (5, "again again"), (5, "again again"), (904, "long words here " * 300), (905, "x" * 700)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, n int").repartition(3)
    got = alignment.align_documents(docs, A, B, block_chars=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_a_full_memo_changes_nothing(spark, monkeypatch):
    rows = [(i, f"word{i % 7} and <{i}> été") for i in range(60)]
    monkeypatch.setattr(alignment, "MEMO", 3)
    aligner = alignment.Aligner(A, B)
    told = alignment.align_block(aligner, [i for i, _ in rows], [t for _, t in rows])
    assert [(r[1], r[2], r[3], r[4], r[5], r[6]) for r in told[:-1]] == [(*p[:5], p[7]) for p in plain(rows)]
    assert len(aligner.memo) <= max(3, len({w for _, _, runs in aligner.windows([t for _, t in rows]) for w in runs}))


def test_an_empty_table_gives_no_rows(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_the_rank_encoder_gives_the_ids_of_the_library_for_every_code_point():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    encode, _ = alignment.byte_level(A)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a{c}1 {c}{c} !{c} \n{c}  {c}" for c in letters]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert [ids.tolist() for ids in encode(part)] == [e.ids for e in library.encode_batch_fast([" " + t for t in part], add_special_tokens=False)]


def test_a_window_is_one_key_of_both_sides():
    import numpy as np

    aligner, texts = alignment.Aligner(A, B), ["one two  three", "é\n\tx 1234567 naïve", " ", "a"]
    for text, (n_a, n_b, windows) in zip(texts, aligner.windows(texts)):
        sides = [w.split(b"\xff\xff") for w in windows]  # no id holds these bytes
        a, b = ([i for side in half for i in np.frombuffer(side, "<u2").tolist()] for half in zip(*sides))
        assert (len(a), len(b)) == (n_a, n_b)
        assert b"".join(aligner.a_table[i] for i in a) == b"".join(aligner.b_table[i] for i in b) == b" " + text.encode()
