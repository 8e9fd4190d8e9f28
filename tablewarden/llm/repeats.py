"""Substring deduplication with suffix automata of reference shards.

A window is 13 consecutive words of a document.  Every window belongs to its minimizer, the smallest hash of a six-word run in it;
consecutive windows with one minimizer form a piece of at most 20 words.  Equal windows have equal minimizers, so the pieces
of a minimizer hold all that can match: they are a reference shard.  Shards are dealt over the tasks.  Each builds the suffix
automaton of its distinct pieces, whose states know the smallest document they occur in, and streams the pieces through it:
where the matching statistic reaches 13 words, the window's smallest document is read off the state.  Documents then lose all
words of windows that a smaller document has, maximal spans of them at once.

The reference grows with the corpus, so its automata are not broadcast: each goes to the one task whose documents can match it.
Documents are read in blocks, three times and never shuffled.  What the tasks find for a block is stored in the shared folder
under the hash of its texts, where the next reading looks it up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _blocks as blocks
from .common import fresh_path, open_folder, rows_of

WINDOW, GRAM = 13, 6
BLOCK_CHARS = 5_000_000  # a worker holds about 50 bytes for each
SHARD_WORDS = 50_000
MOST_PIECES = 10_000  # of one minimizer, each counted once a block; the windows of one with more are dealt singly
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Automaton:
    """Suffix automaton of several word sequences; each state keeps the smallest document of the places it ends at."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.least.append(None)
        return len(self.next) - 1

    def _clone(self, at: int, word, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word) -> int:
        to = self.next[last].get(word)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, word, to)
        made, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = made
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[made] = to if self.length[to] == self.length[at] + 1 else self._clone(at, word, to)
        return made

    def add(self, words: list, document: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            if self.least[last] is None or document < self.least[last]:
                self.least[last] = document

    def close(self) -> None:
        """Hand the smallest documents on to the states of shorter suffixes."""
        least, link = self.least, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and (least[up] is None or least[state] is not None and least[state] < least[up]):
                least[up] = least[state]

    def stream(self, words: list, window: int) -> list[int | None]:
        """For each window of ``words`` the smallest document that has it, or None: the matching statistic is kept to ``window``."""
        follow, link, length = self.next, self.link, self.length
        at = matched = 0
        out = []
        for i, word in enumerate(words):
            while at and word not in follow[at]:
                at = link[at]
                matched = length[at]
            if word in follow[at]:
                at, matched = follow[at][word], matched + 1
            while at and length[link[at]] >= window:
                at = link[at]
            matched = min(matched, length[at])
            if i >= window - 1:
                out.append(self.least[at] if matched >= window else None)
        return out


class Pieces:
    """The pieces of a block: documents' words one after another, and start, last window, minimizer and hash of every piece."""

    def __init__(self, texts: list[str]):
        lists = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at space and 9 to 13 only
        self.sizes = np.array([len(w) for w in lists], np.int64)
        self.words = [w for some in lists for w in some]
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        if n < WINDOW:
            self.first = self.last = np.zeros(0, np.int64)
            self.minimizer = self.hash = np.zeros(0, np.uint64)
            return
        codes = np.fromiter(map(xxhash.xxh64_intdigest, self.words, repeat(0)), np.uint64, n)
        grams = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            grams = grams * ODD + codes[j : j + len(grams)]
        grams = (grams ^ (grams >> np.uint64(31))) * MIX
        grams ^= grams >> np.uint64(32)
        starts, per = n - WINDOW + 1, WINDOW - GRAM + 1
        least = grams[:starts].copy()
        for j in range(1, per):
            np.minimum(least, grams[j : j + starts], out=least)
        at = np.zeros(starts, np.int64)
        for j in range(per - 1, -1, -1):  # the leftmost of equal hashes
            hit = grams[j : j + starts] == least
            at[hit] = np.flatnonzero(hit) + j
        inside = self.doc[:starts] == self.doc[WINDOW - 1 :]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (self.doc[1:starts] != self.doc[: starts - 1])]) & inside
        # A run of windows ends where the next begins or where windows cross into another document.
        self.first = np.flatnonzero(new)
        edges = np.flatnonzero(new | ~inside)
        following = np.searchsorted(edges, self.first, side="right")
        self.last = np.append(edges, starts)[following] - 1
        self.minimizer = least[self.first]
        powers = np.cumprod(np.full(n + 1, ODD))
        self._inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(ODD), -1, 1 << 64))))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:n])])
        self.hash = self._hashes(self.first, self.last + WINDOW)

    def _hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        made = (self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64)
        return (made ^ (made >> np.uint64(29))) * MIX

    def split(self, minimizers: np.ndarray) -> None:
        """Cut the pieces of these (signed) minimizers into single windows."""
        hit = np.isin(_signed(self.minimizer), minimizers) if len(minimizers) else np.zeros(len(self.first), bool)
        if not hit.any():
            return
        sizes = np.where(hit, self.last - self.first + 1, 1)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        single = np.repeat(hit, sizes)
        first = np.repeat(self.first, sizes) + within
        self.last = np.where(single, first, np.repeat(self.last, sizes))
        self.first, self.minimizer = first, np.repeat(self.minimizer, sizes)
        self.hash = self._hashes(self.first, self.last + WINDOW)

    def text(self, i: int) -> bytes:
        return b" ".join(self.words[self.first[i] : self.last[i] + WINDOW])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _ids(ids: list) -> tuple[np.ndarray, np.ndarray]:
    known = np.array([x is not pd.NA and x is not None for x in ids], bool)
    return np.array([int(x) if ok else 0 for x, ok in zip(ids, known)], np.int64), known


def _found(folder: str, key: int, columns: list[str]) -> pd.DataFrame:
    """What was stored for a block; every block has at least its mark, so a block that reads differently now is noticed."""
    import pyarrow.parquet as pq

    fs, root = open_folder(folder)
    try:
        return pq.read_table(f"{root}/block={key}", columns=columns, filesystem=fs, partitioning=None).to_pandas()
    except FileNotFoundError:
        raise RuntimeError("a block was read differently the second time") from None


def _store(df: DataFrame, name: str) -> str:
    """Rows by block, one folder each, in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.repartition("block").write.partitionBy("block").parquet(path)
    return path


def shared_minimizers(frames: Iterator[pd.DataFrame], most_pieces: int = MOST_PIECES) -> Iterator[pd.DataFrame]:
    """Of rows sorted by minimizer, the block and minimizer of those that two documents or two blocks have, and the marks; ``split``
    where all blocks together have more than ``most_pieces`` pieces of it.

    Rows are one per block and minimizer, so what is carried from batch to batch is at most one row per block."""
    held = None
    for frame in frames:
        held = yield from _shared(frame if held is None else pd.concat([held, frame], ignore_index=True), True, most_pieces)
    if held is not None:
        yield from _shared(held, False, most_pieces)


def _shared(rows: pd.DataFrame, more: bool, most_pieces: int):
    key = rows["minimizer"].to_numpy()
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    held = None
    if more and len(starts):
        held, rows, new = rows.iloc[starts[-1] :], rows.iloc[: starts[-1]], new[: starts[-1]]
    run = np.cumsum(new) - 1
    n = np.bincount(run, minlength=1)
    several = np.bincount(run, rows["several"].to_numpy(dtype=float), minlength=1) > 0
    keep = (n[run] > 1) | several[run] | rows["mark"].to_numpy(dtype=bool) if len(rows) else np.zeros(0, bool)
    crowded = np.bincount(run, rows["pieces"].to_numpy(dtype=float), minlength=1) > most_pieces
    made = rows.assign(split=crowded[run] & ~rows["mark"].to_numpy(dtype=bool)) if len(rows) else rows.assign(split=False)
    yield made.loc[keep, ["block", "minimizer", "mark", "split"]]
    return held


def match_pieces(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """All pieces of some minimizers: the smallest document of every window, for rows where one is below the row's largest document."""
    least: dict[bytes, int] = {}
    for text, low in zip(rows["text"], rows["low"]):
        if text not in least or low < least[text]:
            least[text] = low
    answers: dict[bytes, list[int]] = {}
    texts = {text: text.split(b" ") for text in least}
    shard, held = [], 0
    shards = []
    for text, words in texts.items():
        shard.append(text)
        held += len(words)
        if held >= 4 * SHARD_WORDS:  # several shards at most where some minimizers come together; all pieces meet each
            shards.append(shard)
            shard, held = [], 0
    if shard:
        shards.append(shard)
    for shard in shards:
        automaton = Automaton()
        for text in shard:
            automaton.add(texts[text], least[text])
        automaton.close()
        for text, words in texts.items():
            got = automaton.stream(words, window)
            if text in answers:
                got = [a if b is None or a is not None and a < b else b for a, b in zip(answers[text], got)]
            answers[text] = got
    mins = [answers[t] for t in rows["text"]]
    keep = [min(m) < high for m, high in zip(mins, rows["high"])]
    return pd.DataFrame({"block": rows["block"], "piece": rows["piece"], "least": mins})[keep]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, most_pieces: int = MOST_PIECES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (binary UTF-8: the words kept, joined by one space) of every document.

    A word goes if it lies in a window whose words also start in a document with a smaller id, as the texts came in.  Null text
    has no words.  A row without id loses nothing and takes nothing from others; rows of one id take nothing from one another.
    Texts of fewer than 13 words stay whole.  An empty table gives no rows.  ``docs`` must give the same rows in the same order at
    each reading, as a stored table does; a block that reads differently fails the job.
    """
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=F.coalesce(F.col(text_col), F.lit("")))

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, ids, texts in blocks(frames, block_chars):
            pieces = Pieces(texts)
            number, known = _ids(ids)
            owner = number[pieces.doc[pieces.first]] if len(pieces.first) else np.zeros(0, np.int64)
            use = known[pieces.doc[pieces.first]] if len(pieces.first) else np.zeros(0, bool)
            minimizer, owner = _signed(pieces.minimizer)[use], owner[use]
            order = np.lexsort((owner, minimizer))
            minimizer, owner = minimizer[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], minimizer[1:] != minimizer[:-1]])) if len(minimizer) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(minimizer)) - 1
            distinct = np.sort(_signed(pieces.minimizer)[use][np.unique(pieces.hash[use], return_index=True)[1]])
            n = np.searchsorted(distinct, minimizer[start], side="right") - np.searchsorted(distinct, minimizer[start])
            yield pd.DataFrame({"minimizer": np.append(minimizer[start], 0), "block": key, "several": np.append(owner[start] != owner[end], False), "mark": np.append(np.zeros(len(start), bool), True),
                                "pieces": np.append(n, 0)})

    def shared_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return shared_minimizers(frames, most_pieces)

    rows = flat.mapInPandas(anchors, "minimizer bigint, block bigint, several boolean, mark boolean, pieces bigint")
    shared = _store(rows.repartition("minimizer").sortWithinPartitions("minimizer").mapInPandas(shared_rows, "block bigint, minimizer bigint, mark boolean, split boolean"), "shared")

    def texts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, ids, texts in blocks(frames, block_chars):
            pieces = Pieces(texts)
            number, known = _ids(ids)
            table = _found(shared, key, ["minimizer", "split"])
            wanted, singly = table["minimizer"].to_numpy(), table.loc[table["split"], "minimizer"].to_numpy()
            pieces.split(singly)
            own = np.flatnonzero(np.isin(_signed(pieces.minimizer), wanted)) if len(pieces.first) else np.zeros(0, np.int64)
            own = own[known[pieces.doc[pieces.first[own]]]] if len(own) else own
            owner = number[pieces.doc[pieces.first[own]]] if len(own) else own
            order = np.lexsort((owner, pieces.hash[own]))
            own, owner = own[order], owner[order]
            code = pieces.hash[own]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(code)) - 1
            minimizer = _signed(pieces.minimizer[own[start]])
            salt = np.where(np.isin(minimizer, singly), _signed(code[start]), 0)  # equal windows have equal hashes
            yield pd.DataFrame({"block": np.int64(key), "piece": [*_signed(code[start]), 0], "minimizer": [*minimizer, 0], "salt": [*salt, 0], "low": [*owner[start], 0],
                                "high": [*owner[end], 0], "text": [*(pieces.text(i) for i in own[start]), None]})

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            marks = frame[frame["text"].isna()]
            if len(marks):
                yield marks.assign(least=[[]] * len(marks))[["block", "piece", "least"]]
            frame = frame[frame["text"].notna()]
            if len(frame):
                held.append(frame)
                size += len(frame)
            if size * 16 >= SHARD_WORDS:
                every = pd.concat(held, ignore_index=True)
                last = every.iloc[-1]
                cut = int(((every["minimizer"] != last["minimizer"]) | (every["salt"] != last["salt"])).sum())  # the last key may go on
                if cut:
                    yield match_pieces(every.iloc[:cut], WINDOW)
                held, size = [every.iloc[cut:]], len(every) - cut
        if held:
            yield match_pieces(pd.concat(held, ignore_index=True), WINDOW)

    found = flat.mapInPandas(texts_of, "block bigint, piece bigint, minimizer bigint, salt bigint, low bigint, high bigint, text binary")
    answers = _store(found.repartition("minimizer", "salt").sortWithinPartitions("minimizer", "salt").mapInPandas(matched, "block bigint, piece bigint, least array<bigint>"), "least")

    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, ids, texts in blocks(frames, block_chars):
            pieces = Pieces(texts)
            number, known = _ids(ids)
            dealt = _found(shared, key, ["minimizer", "split"])
            pieces.split(dealt.loc[dealt["split"], "minimizer"].to_numpy())
            table = _found(answers, key, ["piece", "least"])
            table = table[table["least"].map(len) > 0].drop_duplicates("piece").sort_values("piece")
            covered = np.zeros(len(pieces.words) + 1, np.int64)
            if len(table) and len(pieces.first):
                codes, wanted = _signed(pieces.hash), table["piece"].to_numpy()
                at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
                own = np.flatnonzero(wanted[at] == codes)
                lists = table["least"].to_numpy()
                sizes = pieces.last[own] - pieces.first[own] + 1
                least = np.concatenate([lists[i] for i in at[own]]) if len(own) else np.zeros(0, np.int64)
                windows = np.repeat(pieces.first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(least))
                doc = pieces.doc[windows]
                gone = windows[known[doc] & (least < number[doc])]
                np.add.at(covered, gone, 1)
                np.add.at(covered, gone + WINDOW, -1)
            keep = np.cumsum(covered)[:-1] == 0
            ends = np.cumsum(pieces.sizes)
            removed, kept = [], []
            for start, end in zip(ends - pieces.sizes, ends):
                part = keep[start:end]
                removed.append(int(len(part) - part.sum()))
                words = pieces.words[start:end]
                kept.append(b" ".join(words if removed[-1] == 0 else [w for w, k in zip(words, part) if k]))
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_words": pieces.sizes, "n_removed": removed, "kept": kept})

    return flat.mapInPandas(strip, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")

