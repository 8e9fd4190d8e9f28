import hashlib
import random

import numpy as np
import pytest

from tablewarden.llm import bpe
from tablewarden.llm.queries import public_path
from tablewarden.session import cut_lineage

PATH = public_path("word_bpe_49k.json")
ODD = ["a", "ABC", "Zß", " ", "  ", "\n", "\t", "\x1c", " ", " ", "7", "12", "'s", "<|endoftext|>", "<|startoftext|>", "!", "é", "é", "日本", "😀", "_", "ΟΔΟΣ", "İ"]


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    made = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        made.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(made, key=str)


@pytest.mark.parametrize("block_chars", [200, 10**7])
def test_ids_and_texts_are_those_of_the_library(spark, block_chars):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices(ODD, k=draw.randint(0, 40)))) for i in range(800)]
    rows += [(900, None), (901, ""), (902, "   "), (None, "no id"), (5, "again again"), (5, "again again"), (903, "word " * 50_000), (904, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, "noise", 1) for i, t in rows], "doc_id long, text string, ids string, block int").repartition(3)
    got = bpe.digests(bpe.decode(bpe.encode(cut_lineage(docs), PATH, block_chars=block_chars), PATH))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    same = bpe.digests(bpe.encode(cut_lineage(docs), PATH, block_chars=block_chars, with_text=True))
    assert sorted(map(tuple, same.collect()), key=str) == expected(rows)


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).count() == 0


def test_codes_come_back():
    codes = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 5], np.int64)
    assert (bpe.from_varint(bpe.to_varint(codes)) == codes).all()
    assert len(bpe.from_varint(b"")) == 0


@pytest.mark.parametrize("most", [0, 200, 255, 256, 65_535, 65_536, 2**31])
def test_numbers_come_back_in_less_than_their_bytes(most):
    numbers = np.random.default_rng(2).integers(0, most + 1, size=5000)
    numbers[7] = most
    data = bpe._packed(numbers)
    assert (bpe._unpacked(data) == numbers).all()
    assert len(data) < 1.1 * len(numbers) * next(w for w in (1, 2, 4) if most < 1 << 8 * w)
    assert len(bpe._unpacked(bpe._packed(np.zeros(0, np.int64)))) == 0


def test_a_block_is_sent_in_fewer_bytes_than_its_codes_one_by_one(spark):
    """Sequences of real documents, as one packed row and as the varints that went before."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()
    table, codes = bpe._coded([r.text or "" for r in docs])
    assert len(table) < 1 << 16 and (bpe._unpacked(bpe._packed(np.concatenate(codes))) == np.concatenate(codes)).all()
    assert len(bpe._packed(np.concatenate(codes))) < 0.85 * sum(len(bpe.to_varint(c)) for c in codes)
