"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level 0 holds the lowest chunk of every id; a continuation bitmap says which
ids go on, and level 1 holds the next chunk of just these, and so on.  A rank directory over each bitmap counts the set bits
before every 512th, so the place of an id's next chunk is one directory entry and at most 64 bytes of bitmap away: any token is
read without decoding a block.  Frequent tokens, which have small ids, take fewer bytes.

File: magic, number of ids, number of levels, then per level its entries (length, offset of chunks, bitmap, directory), then the
parts themselves, all little-endian.  One file holds the documents of one range of ids, in order.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_size, cut_lineage, fresh_path, open_folder, rows_of, tasks_for, unique_name

MAGIC = b"DACv1\0\0\0"
HEAD = struct.Struct("<8sQQ")
LEVEL = struct.Struct("<QQQQ")
STEP = 512  # bits per directory entry


def pack(ids: np.ndarray) -> bytes:
    """The bytes of a file for unsigned 32-bit ids."""
    rest, levels = ids.astype("<u4"), []
    count = len(rest)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STEP // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, STEP // 8)).sum(1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, "<u8"), np.cumsum(ones, dtype="<u8")])
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    at = HEAD.size + LEVEL.size * len(levels)
    heads, parts = [], []
    for n, *pieces in levels:
        offsets = []
        for piece in pieces:
            offsets.append(at)
            at += len(piece)
        heads.append(LEVEL.pack(n, *offsets))
        parts += pieces
    return b"".join([HEAD.pack(MAGIC, count, len(levels)), *heads, *parts])


class Codes:
    """Reader of one file; ``read(offset, size)`` gives bytes of it, so only what a request needs is fetched."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read = read
        magic, self.count, n = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        table = read(HEAD.size, LEVEL.size * n)
        self._levels = [LEVEL.unpack_from(table, LEVEL.size * i) for i in range(n)]

    def _rank(self, level: int, at: int) -> int:
        """Set bits of the level's bitmap before position ``at``."""
        _, _, bits, ranks = self._levels[level]
        block = at // STEP
        (before,) = struct.unpack("<Q", self._read(ranks + 8 * block, 8))
        if at % STEP == 0:
            return before
        part = np.frombuffer(self._read(bits + block * STEP // 8, STEP // 8), np.uint8)
        return before + int(np.unpackbits(part, bitorder="little")[: at % STEP].sum())

    def token(self, at: int) -> int:
        """One id by its position."""
        if not 0 <= at < self.count:
            raise IndexError(at)
        value = 0
        for level, (_, chunks, bits, _) in enumerate(self._levels):
            value |= self._read(chunks + at, 1)[0] << (8 * level)
            if not self._read(bits + at // 8, 1)[0] >> (at % 8) & 1:
                break
            at = self._rank(level, at)
        return value

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions start..stop-1: in every level one contiguous piece."""
        stop = min(stop, self.count)
        out, where = np.zeros(max(stop - start, 0), np.uint32), None
        for level, (_, chunks, bits, _) in enumerate(self._levels):
            if stop <= start:
                break
            part = np.frombuffer(self._read(chunks + start, stop - start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            first = start // 8
            flags = np.unpackbits(np.frombuffer(self._read(bits + first, (stop + 7) // 8 - first), np.uint8), bitorder="little")
            flags = flags[start - 8 * first : stop - 8 * first].astype(bool)
            where = np.flatnonzero(flags) if where is None else where[flags]
            start, stop = self._rank(level, start), self._rank(level, stop)
        return out


class WordCache:
    """Ids of a text as bytes, from bounded tables of the pieces and words met so far.

    The text is cut before every space that a character other than white space follows.  The tokenizer's own split never joins
    two such pieces: white space before the cut ends in it, and nothing but white space spans one.  A new piece of Latin letters, ASCII and
    line ends is cut further as the tokenizer's own pattern does, and each new word goes to the tokenizer's model directly, which
    spares its offsets; any other piece is encoded whole.

    A table with more than ``most`` entries is emptied; that changes the time only, never the ids.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer, self._most = Tokenizer.from_file(path), most
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        tokenize, special = self._tokenizer.model.tokenize, re.compile("|".join(re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()) or r"\Z.")
        self._words = _Table(lambda word: _bytes([t.id for t in tokenize(word.translate(BYTES))]))

        def ids_of(piece: str) -> bytes:
            if LATIN.fullmatch(piece) and not special.search(piece):
                return b"".join(map(self._words.__getitem__, SPLIT.findall(piece)))
            return _bytes(self._tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids)

        self._known = _Table(ids_of)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            for table in (self._known, self._words):
                if len(table) > self._most:
                    table.clear()
            yield b"".join(map(self._known.__getitem__, _pieces(text)))


class _Table(dict):
    """A table that works out what it does not hold yet."""

    def __init__(self, make: Callable[[str], bytes]):
        self._make = make

    def __missing__(self, key: str) -> bytes:
        made = self[key] = self._make(key)
        return made


# The split pattern of the byte-level vocabulary, over the characters of ``LATIN`` alone.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN = re.compile(rf"[\n -~{LETTERS}]*")
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


def _byte_names() -> dict[int, str]:
    """Characters of ``LATIN`` as that vocabulary writes their bytes: the unprintable ones are counted on from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in [10, *range(0x20, 0x7F), *range(0xC0, 0x250)]}


BYTES = _byte_names()


def _bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


_GAP = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def _pieces(text: str) -> list[str]:
    """A space before white space, or at the end, is no cut; most texts have none and take the plain split."""
    first, *rest = _CUT.split(text) if _GAP.search(text) else text.split(" ")
    return ([first] if first else []) + [" " + piece for piece in rest]


def write_codes(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2,
                rows_per_file: int = 20_000, cache: int = 500_000) -> DataFrame:
    """Encode the texts, append ``end_id`` to each, write the ids below ``folder`` in ascending document order, and return the
    index: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``file``, ``at`` (place of its first id there).

    Null text counts as empty (only the end id).  Rows without id come first; rows with equal ids follow one another by text.
    An empty table gives no file and an empty index.  The index is stored before it is returned: a task that was run twice
    leaves a file that no index row names.  ``folder`` must be one that all executors reach.
    """
    spark = docs.sparkSession
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=F.coalesce(F.col(text_col), F.lit("")))
    n = tasks_for(spark, flat.count(), rows_per_file)
    ordered = flat.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = root = words = None
        for frame in batches_by_size(frames, "text", 8_000_000):
            if fs is None:
                fs, root = open_folder(folder)
                fs.create_dir(root, recursive=True)
                words = WordCache(tokenizer_path, cache)
            end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
            ids = [x + end for x in words.ids(frame["text"].tolist())]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            name = unique_name("ids", ".dac")
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(np.frombuffer(b"".join(ids), "<u4")))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_tokens": sizes, "file": name, "at": np.cumsum(sizes) - sizes})

    # Files of one partition follow one another in "piece"; partition and piece give the order of all files.
    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for piece, frame in enumerate(encode(frames)):
            yield frame.assign(part=part, piece=piece)

    index = cut_lineage(ordered.mapInPandas(numbered, "doc_id bigint, n_tokens bigint, file string, at bigint, part int, piece int"))
    sizes = index.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    before = _running(sizes)
    return index.join(before, ["part", "piece"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "file", "at")


def _running(sizes: DataFrame) -> DataFrame:
    """Ids before each file.  One row per partition reaches the driver: its number of files and their ids."""
    from pyspark.sql import Window

    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    bases, total = [], 0
    for part in sorted(totals):
        bases.append((part, total))
        total += totals[part]
    bases = sizes.sparkSession.createDataFrame(bases, "part int, part_base bigint")
    return sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(bases), "part").select(
        "part", "piece", (F.col("part_base") + F.col("inside")).alias("base"))


def read_codes(index: DataFrame, folder: str) -> DataFrame:
    """The ids of every index row, read back from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit).  Each row fetches only the pieces of the levels that hold its own ids."""
    n = tasks_for(index.sparkSession, index.count(), 20_000)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        name, handle, codes = None, None, None
        for frame in frames:
            for at in range(0, len(frame), 2_000):
                part, ids = frame.iloc[at : at + 2_000], []
                for file, first, size in zip(part["file"], part["at"], part["n_tokens"]):
                    if file != name:
                        if handle:
                            handle.close()
                        handle, name = fs.open_input_file(f"{root}/{file}"), file
                        codes = Codes(lambda offset, length, f=handle: f.read_at(length, offset))
                    ids.append(codes.span(first, first + size).astype("<u4").tobytes())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "start": part["start"], "n_tokens": part["n_tokens"], "ids": ids})
        if handle:
            handle.close()

    spread = index.repartition(n, "file").sortWithinPartitions("file", "at")
    return spread.mapInPandas(load, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents and read them back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, the last from the files."""
    folder = fresh_path(spark, "codes")
    back = read_codes(write_codes(docs, tokenizer_path, folder), folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
