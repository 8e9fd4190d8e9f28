import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import codes
from tablewarden.llm.queries import public_path
from tablewarden.session import fresh_path

PATH = public_path("byte_bpe_50k.json")
ODD = ["a", "Zß", " ", "  ", "\n", "\t", "\x1c", " ", "　", "7", "12", "'s", "<|endoftext|>", "!", "é", "é", "日本", "😀", "_", "ab"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    draw = random.Random(5)
    texts = ["", " ", "  a", "a  ", "a \n b"] + ["".join(draw.choices(ODD, k=draw.randint(1, 30))) for _ in range(3000)]
    words = codes.WordCache(PATH, most=50)
    for text, got in zip(texts, words.ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_packed_ids_come_back_one_by_one_and_in_spans(n):
    ids = np.array(random.Random(n).choices([0, 1, 255, 256, 65535, 65536, 2**32 - 1], k=n), np.uint32)
    data = codes.pack(ids)
    got = codes.Codes(lambda at, size: data[at : at + size])
    assert [got.token(i) for i in range(0, n, 7)] == ids[::7].tolist()
    for a, b in [(0, n), (n // 3, n // 2), (n // 2, n), (n, n)]:
        assert (got.span(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        got.token(n)


def test_one_token_reads_few_bytes():
    data, read = codes.pack(np.full(100_000, 70_000, np.uint32)), []
    got = codes.Codes(lambda at, size: read.append(size) or data[at : at + size])
    got.token(77_777)
    assert sum(read) < 500


def test_files_hold_all_documents_in_order(spark, tokenizer):
    rows = [(3, "b b", 1), (1, None, 1), (None, "no id", 1), (2, "", 1), (2, "twice", 1), (2, "twice", 1), (9, "x " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = codes.token_files(spark, docs, PATH).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text, _) in zip(got, want, strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = fresh_path(spark, "codes")
    assert codes.read_codes(codes.write_codes(docs, PATH, folder), folder).where(F.col("n_tokens") > 0).count() == 0
