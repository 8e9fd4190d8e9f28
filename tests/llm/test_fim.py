import hashlib
import random
import re

import numpy as np
import pytest

from tablewarden.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
BITS = ["a", "Zß", " ", "  ", "\n", "\t\r", "日本", "😀", " ", "<", "P>", "<<", "S>", ">", "M"]


def plain(doc_id, text, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(tokens), "plain", None, None, text, text
    if h4 % 100 < spm:
        return doc_id, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


@pytest.mark.parametrize("rate, spm, block", [(50, 80, 50), (100, 50, 1 << 22), (0, 80, 1 << 22)])
def test_outputs_equal_plain_python_and_come_back(spark, monkeypatch, rate, spm, block):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices(BITS, k=draw.randint(0, 25)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, " \n "), (None, "no id here"), (3, "again"), (3, "again"), (703, "word  \n" * 40_000), (704, "x" * 9000), (705, "é" * 5 + " <P> b")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, h1 int").repartition(3)
    if block != fim.BLOCK:
        data = np.frombuffer("".join(t or "" for _, t in rows[:200]).encode(), np.uint8)
        assert len(data)
    made = fim.restore(fim.transform(docs, rate=rate, spm=spm)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert sorted(map(tuple, made.collect()), key=str) == sorted((plain(i, t, rate, spm) for i, t in rows), key=str)


def test_blocks_of_any_size_give_the_same_bytes():
    import pyarrow as pa

    texts = ["", "a b", "ç" * 40, "", "x" * 300, "end "]
    batch = pa.RecordBatch.from_pydict({"text": texts}).slice(1)
    for most in (1, 64, 1 << 20):
        told = [bytes(data[a:b]).decode() for _, data, at in fim.byte_blocks(batch, "text", most) for a, b in zip(at, at[1:])]
        assert told == texts[1:]


def test_an_output_without_marks_is_refused():
    text = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError):
        fim.gather(text, np.array([0, len(text)]), np.array([fim.PSM]))


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.restore(fim.transform(docs))).count() == 0
