"""Alignment of two tokenizers of the same text, by anchors at whitespace-marked tokens.

Both tokenizers encode whole texts.  Where a token of either starts with a space at the same byte, what lies before it has ended on
both sides: such verified places cut a document into windows, short pairs of id runs that mostly stand for a word.  A window's groups
and links depend on its ids alone, so each distinct window is aligned once and looked up by its ids from then on.

Link counts over the corpus: documents are taken in blocks.  A block stores its documents as sequences of window numbers, and the id
pairs of its windows with their counts.  The pairs of all blocks are summed by pair in Spark, the sums go back to the blocks by a
join, and the sequences turn into sums over links.  No text is shuffled and no table of pairs is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import from_varint, to_varint
from .common import cut_lineage, rows_of, tasks_for

BLOCK_CHARS = 4_000_000
ENCODE_CHARS = 500_000  # texts handed to the tokenizers at once
MEMO = 300_000  # windows remembered from block to block; the table starts anew beyond, which changes the time only
SPACE_MARK = "▁"


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def byte_level(path: str):
    """Encoder of texts to lists of ids, and the bytes of every id, of a byte-level vocabulary file.

    The pieces of such a vocabulary are numbered in the order of its merges, so they are ranks, and a rank encoder gives the ids
    that the file's own library gives (tested over all code points) in a quarter of the time.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    alphabet, added = _byte_alphabet(), {t["id"]: t["content"] for t in told["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in told["model"]["vocab"].items() if i not in added}
    table = [b""] * (max(told["model"]["vocab"].values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    encoder = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], table


@functools.cache
def sentence_pieces(path: str):
    """The same of a sentencepiece model, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), table


Window = bytes  # the ids of side a, ``BETWEEN``, the ids of side b, two bytes each: one object, hashed once
BETWEEN = 0xFFFF
Aligned = tuple[str, int, np.ndarray]  # groups as text, their number, links as a << 16 | b


def align(windows: list[Window], a_sizes: np.ndarray, b_sizes: np.ndarray, names: np.ndarray) -> list[Aligned]:
    """All windows at once: their tokens lie one after another on one line of bytes.  Between two neighbouring ends of tokens of
    either side lies exactly one link, and where ends of both sides meet a group ends.  ``names`` are all ids followed by , | and ;."""
    if not windows:
        return []
    line = np.frombuffer(b"".join(windows), "<u2").astype(np.int64)
    between, stops = np.flatnonzero(line == BETWEEN), np.cumsum(np.fromiter(map(len, windows), np.int64, len(windows)) // 2)
    in_a = np.repeat(np.tile([True, False], len(windows)), np.diff(np.column_stack([between, stops]).ravel(), prepend=0))
    in_b = ~in_a
    in_b[between] = False
    a, b = line[in_a], line[in_b]
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    a_stops, b_stops = np.cumsum(between - np.append(0, stops[:-1])), np.cumsum(stops - between - 1)
    ends = np.union1d(a_ends, b_ends)
    links = a[np.searchsorted(a_ends, ends)] << 16 | b[np.searchsorted(b_ends, ends)]
    line_ends = a_ends[a_stops - 1]
    met, a_met, b_met = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    # Every id with the mark that follows it, side a of a group before its side b.
    marked_a, marked_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    marked_a[a_met], marked_b[b_met] = 1, 2
    order = np.argsort(np.concatenate([2 * np.searchsorted(met, a_ends), 2 * np.searchsorted(met, b_ends) + 1]), kind="stable")
    told = names[np.concatenate([marked_a, marked_b]), np.concatenate([a, b])][order].tolist()
    to_name, to_link, to_group = ([0, *x.tolist()] for x in (a_stops + b_stops, np.searchsorted(ends, line_ends, "right"), np.searchsorted(met, line_ends, "right")))
    texts = map("".join, map(told.__getitem__, map(slice, to_name, to_name[1:])))
    return [(text[:-1], q - p, links[i:j]) for text, p, q, i, j in zip(texts, to_group, to_group[1:], to_link, to_link[1:])]


class Aligner:
    """Both tokenizers and the windows met so far."""

    def __init__(self, a_path: str, b_path: str):
        (self.a_encode, self.a_table), (self.b_encode, self.b_table) = byte_level(a_path), sentence_pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_table, self.b_table))
        self.a_space, self.b_space = (np.array([x.startswith(b" ") for x in t]) for t in (self.a_table, self.b_table))
        self.names = np.array([[f"{i}{mark}" for i in range(max(len(self.a_table), len(self.b_table)))] for mark in ",|;"], object)
        self.memo: dict[Window, Aligned] = {}

    def windows(self, texts: list[str]) -> Iterator[tuple[int, int, list[Window]]]:
        """Per text: numbers of tokens on both sides and the id runs of its windows; zeros and none if there is nothing to align."""
        a_all, b_all = self.a_encode(texts), self.b_encode(texts)
        for text, a_ids, b_ids in zip(texts, a_all, b_all):
            raw, a, b = b" " + text.encode("utf-8", "surrogatepass"), np.asarray(a_ids, np.int64), np.array(b_ids, np.int64)
            # Pieces of a byte-level vocabulary can only be those of the text itself, so their length tells.
            if not text or self.a_sizes[a].sum() != len(raw) or b"".join(map(self.b_table.__getitem__, b_ids)) != raw:
                yield 0, 0, []
                continue
            a_starts, b_starts = np.cumsum(self.a_sizes[a]) - self.a_sizes[a], np.cumsum(self.b_sizes[b]) - self.b_sizes[b]
            a_at = np.flatnonzero(self.a_space[a])
            met = np.searchsorted(b_starts, a_starts[a_at])
            inside = met < len(b)
            a_at, met = a_at[inside], met[inside]
            shared = (b_starts[met] == a_starts[a_at]) & self.b_space[b[met]]
            a_cuts, b_cuts = a_at[shared], met[shared]
            if not len(a_cuts) or a_cuts[0]:
                a_cuts, b_cuts = np.append(0, a_cuts), np.append(0, b_cuts)
            a_cuts, b_cuts = np.append(a_cuts, len(a)), np.append(b_cuts, len(b))
            number = np.arange(len(a_cuts) - 1)
            line = np.full(len(a) + len(b) + len(number), BETWEEN, "<u2")
            line[np.arange(len(a)) + np.repeat(b_cuts[:-1] + number, np.diff(a_cuts))] = a
            line[np.arange(len(b)) + np.repeat(a_cuts[1:] + number + 1, np.diff(b_cuts))] = b
            raw, cuts = line.tobytes(), ((a_cuts + b_cuts)[:-1] + number).tolist()
            cuts = [2 * c for c in cuts] + [len(raw)]
            yield len(a), len(b), list(map(raw.__getitem__, map(slice, cuts, cuts[1:])))

    def aligned(self, windows: list[Window]) -> list[Aligned]:
        fresh = [w for w in windows if w not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            fresh, self.memo = windows, {}
        self.memo.update(zip(fresh, align(fresh, self.a_sizes, self.b_sizes, self.names)))
        return [self.memo[w] for w in windows]


def _cut(texts: list[str], most: int) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
STORED = ("block string, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, windows binary, "
          "sizes binary, links binary, pairs array<bigint>, counts array<bigint>")


def align_block(aligner: Aligner, ids: list, texts: list[str]) -> list[tuple]:
    """The rows of a block as in ``STORED``: one per document, then one with the windows and pairs of the block."""
    key, numbers, told, rows = uuid.uuid4().hex, defaultdict(count().__next__), [], []
    groups, sizes, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    times = np.zeros(0)
    for part in _cut(texts, ENCODE_CHARS):
        found = [(n_a, n_b, list(map(numbers.__getitem__, runs))) for n_a, n_b, runs in aligner.windows(part)]
        made = aligner.aligned(list(islice(numbers, len(told), None)))
        told += [m[0] for m in made]
        groups.append(np.array([m[1] for m in made], np.int64))
        sizes.append(np.array([len(m[2]) for m in made], np.int64))
        links.append(np.concatenate([m[2] for m in made]) if made else links[0])
        n_groups, n_links = np.concatenate(groups), np.concatenate(sizes)
        groups, sizes, times = [n_groups], [n_links], np.append(times, np.zeros(len(made)))
        seen = [np.zeros(0, np.int64)]
        for n_a, n_b, own in found:
            digest = hashlib.sha256(";".join(map(told.__getitem__, own)).encode()).hexdigest() if own else ""
            own = np.array(own, np.int64)
            seen.append(own)
            rows.append((key, ids[len(rows)], n_a, n_b, int(n_groups[own].sum()), int(n_links[own].sum()), digest, to_varint(own), None, None, None, None))
        times += np.bincount(np.concatenate(seen), minlength=len(times))
    pairs, at = np.unique(np.concatenate(links), return_inverse=True)
    counts = np.bincount(at, np.repeat(times, sizes[0]), len(pairs)).astype(np.int64)
    rows.append((key, None, None, None, None, None, None, None, to_varint(sizes[0]), to_varint(at.astype(np.int64)), pairs, counts))
    return rows


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Groups are runs of tokens between bytes where tokens of both end; links are all pairs of token occurrences that share a byte.
    The count of an id pair is the number of links of the corpus that hold it; ``n_best`` are a document's links whose count is the
    highest of their b id, ``count_sum`` the sum of the counts of its links.  Texts null, empty, or that a tokenizer does not give back
    byte for byte have no tokens: zeros and ''.  Repeated rows and null ids are kept and count; an empty table gives no rows.
    """
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(a_path, b_path)

        def made(ids: list, texts: list[str]) -> pd.DataFrame:
            frame = pd.DataFrame(align_block(aligner, ids, texts), columns=["block", *DOC, "windows", "sizes", "links", "pairs", "counts"])
            whole = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            return frame.astype({c: "Int64" for c in whole})

        ids, texts, held = [], [], 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 1
                if held >= block_chars:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield made(ids, texts)

    # Stored: the counts and the sums below must see the same blocks.
    stored = cut_lineage(flat.mapInPandas(work, STORED))
    blocks = stored.where("pairs IS NOT NULL")
    n = tasks_for(docs.sparkSession, blocks.count(), 2)
    places = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")).select(F.col("block").alias("home"), "at", "p.pairs", F.col("p.counts").alias("n"))
    pair_tasks = tasks_for(docs.sparkSession, n, 8)
    totals = cut_lineage(places.groupBy("pairs").agg(F.sum("n").alias("n")).withColumn("b", F.col("pairs").bitwiseAND(0xFFFF)))
    best = totals.groupBy("b").agg(F.max("n").alias("most"))
    facts = totals.join(best, "b").select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    known = places.drop("n").repartition(pair_tasks, "pairs").join(facts.hint("shuffle_merge"), "pairs").select("home", "at", "n", "best")

    def total(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        told, docs = rows[rows["doc_id"].isna() & rows["sizes"].notna()].iloc[0], rows[rows["windows"].notna()]
        sizes, links = from_varint(told["sizes"]), from_varint(told["links"])
        n, good = np.full(links.max(initial=-1) + 1, -1, np.int64), np.zeros(links.max(initial=-1) + 1, np.int64)
        n[counts["at"]], good[counts["at"]] = counts["n"], counts["best"]
        if (n < 0).any():
            raise RuntimeError("a pair of a block has no count")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums, bests = (np.concatenate([[0], np.cumsum(x[links])]) for x in (n, good))
        sums, bests = sums[ends[1:]] - sums[ends[:-1]], bests[ends[1:]] - bests[ends[:-1]]
        runs = [from_varint(w) for w in docs["windows"]]
        return docs[DOC].assign(n_best=[int(bests[r].sum()) for r in runs], count_sum=[int(sums[r].sum()) for r in runs])[
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    columns = stored.select("block", *DOC, "windows", "sizes", "links").repartition(n, "block")
    return columns.groupBy("block").cogroup(known.repartition(n, "home").groupBy("home")).applyInPandas(
        total, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
