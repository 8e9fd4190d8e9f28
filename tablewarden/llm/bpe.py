"""BPE encoding and decoding over a table of distinct words.

Documents are taken in blocks.  A pass over the texts gives every block's distinct words under short codes, in order of first
appearance; a second pass over the same blocks gives its documents as sequences of these codes, and the share of each code.  The words
of all blocks are brought together by a hash of the word, packed: one row holds the words of a block that belong to one share of the
word table, in the order of their codes.  Where a share is, each distinct word is encoded once, and the ids go back to the blocks, where
the sequences turn into ids by position.  So the text itself is never shuffled, a word is sent once per block however often it occurs,
and its code, which the share tells, not with it.

A word here is a run between ASCII white space.  The tokenizers this serves drop white space before they split, and none of
their tokens spans it, so the ids of a text are those of its words in order.
"""

from __future__ import annotations

import functools
import json
import math
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import plan_bytes
from .common import rows_of

BLOCK_CHARS = 1_500_000
SHARE_BYTES = 8 << 20  # of the documents as stored, for one share of the word table
MOST_SHARES = 1 << 20  # as many tasks as a stage well has; with more data a share only holds more words


def to_varint(codes: np.ndarray) -> bytes:
    """Codes below 2**28 in one to four bytes of seven bits, low bits first; the last byte of a code has its high bit clear."""
    sizes = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        has = sizes > k
        out[starts[has] + k] = (codes[has] >> (7 * k)) & 127 | np.where(sizes[has] > k + 1, 128, 0)
    return out.tobytes()


def from_varint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        has = ends - starts > k
        out[has] |= (raw[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in as many bytes each as the largest needs, compressed; the first byte tells how many."""
    import zstandard

    width = next(w for w in (1, 2, 4) if numbers.max(initial=0) < 1 << 8 * w)
    planes = numbers.astype(f"<u{width}").view(np.uint8)
    if width == 4:  # its high bytes hardly ever change
        planes = np.ascontiguousarray(planes.reshape(-1, 4).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    width = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    if width == 4:
        raw = np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1)
    return raw.view(f"<u{width}").astype(np.int64)


def _blocks(frames: Iterator[pd.DataFrame], most_chars: int) -> Iterator[tuple[int, list, list[str]]]:
    """Documents in blocks of about ``most_chars``: key, ids, texts.  The key is a hash of the block's texts."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
            ids.append(doc_id)
            texts.append(text)
            held += len(text) + 1
            if held >= most_chars:
                yield _key(texts), ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield _key(texts), ids, texts


def _key(texts: list[str]) -> int:
    digest = xxhash.xxh64()
    for text in texts:
        digest.update(text.encode("utf-8", "surrogatepass"))
        digest.update(b"\xff")
    return digest.intdigest() - (1 << 63)


def _coded(texts: list[str]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    table: dict[bytes, int] = defaultdict(count().__next__)
    sequences = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
        sequences.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
    return table, sequences


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
           with_text: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every document, as the tokenizer encodes its whole text without special tokens added.

    ``with_text`` adds ``decoded``, what ``decode`` makes of the ids, in the same pass.

    Null and empty texts give an empty array; repeated rows and null ids are kept; an empty table gives no rows.  ``docs`` is
    read twice and must give the same rows in the same order both times, as a stored table does; the key of a block is a hash
    of its texts, and a block whose two readings differ fails the job instead of giving wrong ids.
    """
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=F.coalesce(F.col(text_col), F.lit("")))

    size = plan_bytes(docs)
    wanted = math.ceil(size / SHARE_BYTES) if size < 1 << 60 else 0  # so large only where Spark has no estimate
    shares = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted), MOST_SHARES)

    def share_of(table: list[bytes]) -> np.ndarray:
        return (np.fromiter(map(xxhash.xxh64_intdigest, table), np.uint64, len(table)) % np.uint64(shares)).astype(np.int64)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for key, _, texts in _blocks(frames, block_chars):
            table = list(_coded(texts)[0])
            share = share_of(table)
            order = np.argsort(share, kind="stable")
            found, starts = np.unique(share[order], return_index=True)
            rows = [(key, int(own), pack.compress(b"\n".join([table[i] for i in codes])))
                    for own, codes in zip(found, np.split(order, starts[1:])) if len(codes)]
            yield pd.DataFrame(rows, columns=["block", "share", "words"])

    def sequences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, ids, texts in _blocks(frames, block_chars):
            table, codes = _coded(texts)
            own = pd.array(ids, dtype="Int64")
            yield pd.DataFrame({"block": [key], "doc_ids": [own.to_numpy(np.int64, na_value=0).tobytes()], "missing": [own.isna().tobytes()],
                                "sizes": [_packed(np.array([len(c) for c in codes]))], "codes": [_packed(np.concatenate(codes))], "shares": [_packed(share_of(list(table)))]})

    def encode_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        tokenizer = loaded(tokenizer_path)
        unpack = zstandard.ZstdDecompressor()
        now, known = None, {}
        for frame in frames:  # sorted by share, and one share of the word table is held at a time
            rows = []
            for block, share, packed in zip(frame["block"], frame["share"], frame["words"]):
                if share != now:
                    now, known = share, {}
                table = unpack.decompress(packed).split(b"\n")
                fresh = [w for w in table if w not in known]
                for at in range(0, len(fresh), 5_000):  # encodings are much larger than words
                    part = fresh[at : at + 5_000]
                    made = tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)
                    known.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in made)))
                ids = [known[w] for w in table]
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                rows.append((block, share, _packed(counts), _packed(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))))
            yield pd.DataFrame(rows, columns=["block", "share", "counts", "ids"])

    def place(parts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.drop_duplicates("share")  # blocks of equal texts are one block
        counts = [_unpacked(c) for c in known["counts"]]
        flat_ids = np.concatenate([np.zeros(0, np.int64), *(_unpacked(i) for i in known["ids"])]).astype(np.int32)
        made = []
        for ids, missing, lengths, codes, own in zip(parts["doc_ids"], parts["missing"], parts["sizes"], parts["codes"], parts["shares"]):
            shared = _unpacked(own)
            sizes, starts, begin = np.full(len(shared), -1), np.zeros(len(shared), np.int64), 0
            for share, n in zip(known["share"], counts):
                there = np.flatnonzero(shared == share)
                if len(there) != len(n):
                    raise RuntimeError("a block was read differently the second time")
                sizes[there], starts[there] = n, begin + np.cumsum(n) - n
                begin += int(n.sum())
            if (sizes < 0).any():
                raise RuntimeError("a block was read differently the second time")
            found = []
            for some in np.split(_unpacked(codes), np.cumsum(_unpacked(lengths))[:-1]):
                n = sizes[some]
                ends = np.cumsum(n)
                found.append(flat_ids[np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
            own_ids = pd.Series(np.frombuffer(ids, np.int64)).astype("Int64").mask(np.frombuffer(missing, bool))
            made.append(pd.DataFrame({"doc_id": own_ids, "ids": found}))
        if not made:
            raise RuntimeError("a block was read differently the second time")
        made = pd.concat(made, ignore_index=True)
        return made.assign(decoded=[text_of(ids, pieces(tokenizer_path)) for ids in made["ids"]]) if with_text else made

    table = flat.mapInPandas(words, "block bigint, share bigint, words binary").repartition(shares, "share").sortWithinPartitions("share")
    back = table.mapInPandas(encode_words, "block bigint, share bigint, counts binary, ids binary")
    coded = flat.mapInPandas(sequences, "block bigint, doc_ids binary, missing binary, sizes binary, codes binary, shares binary").repartition(shares, "block")
    return coded.groupBy("block").cogroup(back.repartition(shares, "block").groupBy("block")).applyInPandas(place, "doc_id bigint, ids array<int>" + (", decoded string" if with_text else ""))


@functools.cache
def loaded(tokenizer_path: str):
    """The tokenizer, read once in a worker's life."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def pieces(tokenizer_path: str) -> np.ndarray:
    """The id-to-piece table; its size is that of the vocabulary, whatever the corpus.  Read from the file itself: a worker that only
    decodes does not hold a tokenizer."""
    with open(tokenizer_path, encoding="utf-8") as file:
        told = json.load(file)
    vocabulary = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
    table = np.full(max(vocabulary.values()) + 1, None, object)
    for piece, i in vocabulary.items():
        table[i] = piece
    return table


def text_of(ids, table: np.ndarray) -> str:
    """Every id joined to its piece, in place; as the tokenizer has no decoder, the pieces stand with one space between them."""
    ids = np.zeros(0, np.int64) if ids is None else np.asarray(ids, np.int64)
    found = table[ids[(ids >= 0) & (ids < len(table))]].tolist()
    return " ".join(found if None not in found else [p for p in found if p is not None])


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with the text of its ``ids`` as ``decoded`` (see ``text_of``).  Ids that have no piece are left out, as the
    tokenizer does; no ids, or null, give an empty text."""
    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = pieces(tokenizer_path)
        for column in parts:
            yield pd.Series([text_of(ids, table) for ids in column], dtype=object)

    return encoded.withColumn("decoded", texts("ids"))


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of a table with ``ids`` and ``decoded``."""
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
