"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds more.

The field tags every token of a text as secret begin, inside or outside, from the token's shape, the words around it and features of
the whole text.  A whole text is one chain.  Bounds worked out for all its tokens at once prove most of them outside on every best path;
the pieces between these are decoded by Viterbi, so the tags are those of a Viterbi over the whole text.
It is trained on what the patterns find in a bounded sample of documents, near chunks that may hold a secret and in the plain words
around them, and on lines made by rule.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import batches_by_size, rows_of, sha256

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]

OUT, BEGIN, IN = 0, 1, 2
LEAST = 8
AROUND = 6
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN, NEAR = 15, 3
SPOKEN = re.compile(rf"(?<![^\x20\x09-\x0D])(?![\"'(]?[^\W\d_]?[^\W\d_A-Z]{{0,{PLAIN - 1}}}[.,;:!?)\"']{{0,2}}(?:[\x20\x09-\x0D]|\Z))[^\x20\x09-\x0D]+")
KEY = re.compile(r"passw|passphrase|secret|token|api|key|auth|access|credential|pwd|login", re.IGNORECASE | re.ASCII)
SPACE = re.compile(r"[\x20\x09-\x0D]")
TOKEN = re.compile(r"[^\W_]+|(?![\x20\x09-\x0D])[\W_]")
KEYS = {"password", "passwd", "secret", "token", "api", "apikey", "key", "pass", "pwd", "passphrase", "bearer", "auth", "credential"}

MARKS = "=:\"'/+-_.@,;()<>&?#%"
KINDS_OF_TOKENS = ["none", "key", *MARKS, "mark", "digits", "mixed", "short mixed", "upper", "capital", "lower"]

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Whole matches of the three patterns as (start, end, kind), by start and then kind as listed."""
    found = []
    if "=" in text or ":" in text:  # the pattern needs one of them
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_values(text: str) -> list[tuple[int, int]]:
    """The secret parts alone, for training: values of assignments, access keys and hex runs."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [s[:2] for s in base_spans(text) if s[2] != "assign"]


def chunks_to_decode(text: str) -> list[tuple[int, int]]:
    """Start and end of the chunks that training looks at first, in order: all but plain words far from a key word."""
    found = [m.span() for m in SPOKEN.finditer(text)]
    more, done = [], 0
    for m in KEY.finditer(text):
        start = m.start()
        if start < done:
            continue
        while start > done and not SPACE.match(text, start - 1):
            start -= 1
        for n, chunk in enumerate(CHUNK.finditer(text, start)):
            if n and n > NEAR:
                break
            more.append(chunk.span())
            if n == 0:
                done = chunk.end()
    return sorted({*found, *more}) if more else found


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Neighbouring chunks of these, joined."""
    held = None
    for start, end in chunks_to_decode(text):
        if held and not CHUNK.search(text, held[1], start):
            held = held[0], end
        else:
            if held:
                yield held
            held = start, end
    if held:
        yield held


def kind_of(token: str) -> str:
    """The class of a token as its neighbours see it."""
    if token.lower() in KEYS:
        return "key"
    if len(token) == 1 and not token.isalnum():
        return token if token in MARKS else "mark"
    if token.isdigit():
        return "digits"
    if any(c.isdigit() for c in token):
        return "mixed" if len(token) >= LEAST else "short mixed"
    return "upper" if token.isupper() else "capital" if token[0].isupper() else "lower"


def spread_of(token: str) -> int:
    """Bits per character of a token by its own counts, whole ones, 5 at most."""
    n = len(token)
    counts = map(token.count, token) if n <= 64 else [k for k in Counter(token).values() for _ in range(k)]
    return min(int(math.log2(n) - sum(map(math.log2, counts)) / n + 1e-9), 5)


def own_features(token: str) -> list[str]:
    """Shape of a token."""
    collapsed = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token[:64]))
    n, spread = len(token), spread_of(token)
    digits = sum(c.isdigit() for c in token) / n
    made = [f"kind {kind_of(token)}", f"shape {collapsed[:4]}", f"turns {min(len(collapsed), 12) // 3}", f"length {min(n.bit_length(), 7)}", f"over 15 {n > 15}",
            f"spread {spread}", f"digits {int(digits * 4)}"]
    if re.fullmatch(r"[0-9a-f]+", token) and n >= LEAST:
        made.append("hexadecimal")
    if re.fullmatch(r"[A-Z0-9]+", token) and n >= 12:
        made.append("upper with digits")
    return made


def near_features(two: str, one: str, after: str) -> list[str]:
    return [f"before {one}", f"two before {two}", f"pair {two} {one}", f"after {after}"]


def features_of(tokens: list[re.Match], start: int, end: int, file: list[str]) -> list[list[str]]:
    """Features of the tokens from ``start`` to ``end`` of a text, given all its tokens."""
    kinds = ["none" if not 0 <= i < len(tokens) else kind_of(tokens[i][0]) for i in range(start - 2, end + 1)]
    made = []
    for i, at in enumerate(range(start, end)):
        glued = at > 0 and tokens[at - 1].end() == tokens[at].start()
        made.append(["always", f"glued {glued}", *own_features(tokens[at][0]), *near_features(kinds[i], kinds[i + 1], kinds[i + 3]), *file])
    return made


def file_features(text: str, found: list[Span]) -> list[str]:
    return [f"file assigns {any(s[2] == 'assign' for s in found)}", f"file marks {'=' in text}", f"file digits {min(sum(map(text.count, '0123456789')).bit_length(), 10) // 3}"]


def labelled_runs(text: str, most: int | None = None, tokens: int | None = None) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Features and tags of the runs of a text with the plain words around them, tagged by what the patterns find: of ``most`` runs,
    and ``tokens`` tokens of each.  A text without runs gives its first tokens."""
    values, file = sorted(secret_values(text)), file_features(text, base_spans(text))
    starts, inside = [v[0] for v in values], list(TOKEN.finditer(text))
    places = [m.start() for m in inside]
    found = list(itertools.islice(runs(text), most)) or [(0, 0)]
    for start, end in found:
        first, stop = bisect.bisect_left(places, start), bisect.bisect_left(places, end)
        stop = stop if tokens is None else min(stop, first + tokens)
        first, stop = max(first - AROUND, 0), min(stop + AROUND, len(inside))
        tags, last = [], None
        for m in inside[first:stop]:
            at = bisect.bisect_right(starts, m.start()) - 1
            hit = at >= 0 and m.end() <= values[at][1]
            tags.append(OUT if not hit else IN if last == at else BEGIN)
            last = at if hit else None
        if tags and tags[0] == IN:
            tags[0] = BEGIN
        yield features_of(inside, first, stop, file), tags


def made_lines(n: int = 700, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines made by rule with the places of their secrets: keys of many shapes, and digits that are no secrets."""
    draw = random.Random(seed)
    letters, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda alphabet, k: "".join(draw.choices(alphabet, k=k))
    word = lambda: some(letters, draw.randint(2, 9))
    out = []
    for _ in range(n):
        line = " ".join(word() for _ in range(draw.randint(2, 6))) + " "
        key = draw.choice(["password", "secret", "token", "api_key", "apikey", "passwd", "TOKEN", "Secret", "access key", "auth key", "pass", "pwd", "Bearer", "passphrase"])
        lettered = [lambda: some(letters + upper, draw.randint(16, 32)), lambda: f"xoxb-{some(letters, 12)}-{some(letters, 10)}", lambda: word() + word().capitalize() + word().capitalize()]
        secret = draw.choice([
            lambda: some("0123456789abcdef", draw.choice([18, 24, 32, 40])), lambda: "AKIA" + some(upper + digits, 16),
            lambda: some(letters + upper + digits, draw.randint(16, 40)), lambda: some(letters, 2) + "_" + some(letters + upper + digits, 24),
            lambda: some(letters + upper + digits + "+/", 40), lambda: "-".join(some(letters + digits, 8) for _ in range(4)),
            lambda: "-".join([word(), *(some(draw.choice([digits, letters + digits]), draw.randint(6, 12)) for _ in range(draw.randint(2, 3)))]), *lettered])()
        if draw.random() < 0.12:  # pieces joined by points, the last as much a secret as the first
            secret = draw.choice(["eyJ", ""]) + ".".join(some(letters + upper + digits + "_-", draw.randint(14, 40)) for _ in range(draw.randint(2, 4)))
        short = draw.random() < 0.2  # too short to be told without its key
        secret = draw.choice([lambda: some(letters + digits, 4) + some(digits, 2), lambda: some(letters, 3) + draw.choice("!#$%") + some(letters, 3), lambda: some(letters, 2) + some(upper, 2) + some(letters, 2),
            lambda: some(letters, 2) + some(digits, 1) + some(letters, 2) + some(digits, 1) + some(letters, 3) + draw.choice("!#$%&*") + some(digits, 1), lambda: word().capitalize() + some(digits, draw.randint(2, 4)) + draw.choice("!#$%&*?"),
            lambda: some(letters, 1) + some(digits, 1) + some(letters, 2) + some(digits, 1) + some(letters, 1) + some(upper, 1) + some(letters, 1) + some(digits, 2)])() if short else secret
        plain = draw.choice([
            lambda: some(digits, draw.randint(3, 16)), lambda: ".".join(str(draw.randint(1, 254)) for _ in range(4)), lambda: f"{word()}.{some(digits, 2)}@{word()}{some(digits, 1)}.example.com",
            lambda: f"+{some(digits, 2)} {some(digits, 3)}-{some(digits, 4)}-{some(digits, 4)}", lambda: f"https://{word()}.example.org/{word()}/{some(digits, 3)}",
            lambda: f"20{some(digits, 2)}-0{some('123456789', 1)}-1{some(digits, 1)}T10:00:0{some(digits, 1)}Z", lambda: f"{word()}{some(digits, 3)}", lambda: f"{word().upper()}-{some(digits, 6)}",
            lambda: f"({some(digits, 3)}) {some(digits, 7)}", lambda: f"{word()}_{word()}_{some(digits, 2)}",
            lambda: word().capitalize() + word().capitalize(), lambda: f"{word()}-{word()}", lambda: word().upper(), lambda: f"{word()}_{word()}", lambda: f"{key} {word()} {word()}", lambda: f"{word()}/{word()}",
            lambda: word() + "".join(word().capitalize() for _ in range(draw.randint(1, 4))) + draw.choice(["", "()", "(x)"]), lambda: "commit " + some("0123456789abcdef", draw.choice([7, 8, 10, 12, 16])),
            lambda: draw.choice(["build", "version", "order", "id"]) + " " + some("0123456789abcdef", draw.choice([8, 12, 16])), lambda: f"{word()}.{word()}.{word()}({word()})", lambda: f"{word()}_{word()}_{word()}"])
        places, named = [], short or not any(c.isdigit() for c in secret)
        for _ in range(draw.randint(1, 3)):
            if draw.random() < 0.45 and not places:
                line += draw.choice([key + "=", key + ": ", key + ' = "', key + " ", key + " is ", *([] if named else ["", ""])])
                places.append((len(line), len(line) + len(secret)))
                line += secret + draw.choice(["", '"', "", ","]) + " "
            else:
                line += draw.choice(["", "id: ", "see ", "n="]) + plain() + " "
            line += word() + " "
        out.append((line, places))
    return out


def _made_runs() -> Iterator[tuple[list[list[str]], list[int]]]:
    for text, places in made_lines():
        inside = list(TOKEN.finditer(text))
        hits = [next((i for i, (a, b) in enumerate(places) if a <= m.start() and m.end() <= b), None) for m in inside]
        tags = [OUT if h is None else IN if i and hits[i - 1] == h else BEGIN for i, h in enumerate(hits)]
        yield features_of(inside, 0, len(inside), file_features(text, base_spans(text))), tags


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000, runs_per_text: int = 20, most_runs: int = 3_000,
          tokens_per_run: int = 48) -> crf.Chain:
    """Fit the field on at most ``most`` documents, those whose id hashes lowest, and on lines made by rule, which alone serve an
    empty table.  Of a document at most ``runs_per_text`` runs are taken; equal ones are folded, and of all at most ``most_runs`` stay,
    with ``tokens_per_run`` tokens of each."""
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=text_col)
    drawn = flat.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [r for text in frame["text"].dropna() for r in labelled_runs(text, runs_per_text, tokens_per_run)]
            if found:
                yield pd.DataFrame({"x": ["\n".join(map("\t".join, x)) for x, _ in found], "y": [y for _, y in found]})  # no token holds these

    told = flat.join(F.broadcast(drawn), "doc_id").select("text").mapInPandas(cut, "x string, y array<int>").where("x <> ''")
    rows = told.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("x", "y"), "x", "y").limit(most_runs).collect()
    made = [(x, y, 1) for x, y in _made_runs()]
    pairs = [([list(map(sys.intern, t.split("\t"))) for t in r["x"].split("\n")], r["y"], r["n"]) for r in rows] + made
    del rows
    return crf.fit(*map(list, zip(*[(x, y) for x, y, _ in pairs])), 3, forbidden=[(OUT, IN)], forbidden_first=[IN], times=[n for *_, n in pairs])


def find_secrets(text: str, chain: crf.Chain, scorer: Scorer | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those of the field that no base span covers."""
    base = base_spans(text)
    scorer = scorer or Scorer(chain)
    added = [(start, end, "crf") for start, end in scorer.spans(text, file_features(text, base))
             if not any(a <= start and end <= b for a, b, _ in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


class _Rows(dict):
    """Token to the row of its shape; tokens of one shape share a row.  Rows hold a kind and the scores of begin and inside less outside."""

    def __init__(self, chain: crf.Chain):
        super().__init__()
        self._chain, self._row_of, self._grown = chain, {}, []
        self.kinds, self.scores = np.zeros(0, np.int64), np.zeros((0, 2))

    def __missing__(self, token: str) -> int:
        n = len(token)
        if n <= PLAIN and token.isascii() and token.isalpha() and token.islower() and token not in KEYS:
            shape: tuple = (n.bit_length(), spread_of(token), n >= LEAST and not token.strip("abcdef"))  # all that differs among these
        else:
            shape = tuple(own_features(token))
        row = self._row_of.get(shape)
        if row is None:
            row = self._row_of[shape] = len(self._row_of)
            scores = self._chain.emission(["always", *own_features(token)])
            self._grown.append((KINDS_OF_TOKENS.index(kind_of(token)), *(scores[1:] - scores[0])))
        self[token] = row
        return row

    def settle(self) -> None:
        if self._grown:
            self.kinds = np.concatenate([self.kinds, [g[0] for g in self._grown]])
            self.scores = np.concatenate([self.scores, np.array([g[1:] for g in self._grown])])
            self._grown = []


class Scorer:
    """Decodes texts; scores of a token's shape are worked out once per task (tables of bounded size), those of its neighbours' kinds
    stand in one table.  All scores are those of begin and inside less that of outside, which gives the same best path."""

    def __init__(self, chain: crf.Chain, most: int = 200_000):
        self._chain, self._most, self._rows = chain, most, _Rows(chain)
        self._move = chain.move
        gain = lambda name: chain.emission([name])[1:] - chain.emission([name])[0]
        names = KINDS_OF_TOKENS + [""] * (32 - len(KINDS_OF_TOKENS))
        one, two, after = (np.array([gain(f"{what} {n}") for n in names]) for what in ("before", "two before", "after"))
        pair = np.array([[gain(f"pair {a} {b}") for b in names] for a in names]) + two[:, None] + one[None]
        glued = np.array([gain("glued False"), gain("glued True")])
        self._near = (pair[:, :, None, None] + after[None, None, :, None] + glued[None, None, None]).reshape(-1, 2)

    def scores(self, text: str, file: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all tokens of a text, and their scores."""
        found = TOKEN.findall(text)
        if len(self._rows) > self._most:
            self._rows = _Rows(self._chain)
        rows = self._rows
        own = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
        rows.settle()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        filled = np.flatnonzero((codes != 32) & ((codes < 9) | (codes > 13)))  # the tokens hold all of these
        last = np.cumsum(sizes)
        starts = filled[last - sizes] if len(found) else last
        ends = starts + sizes
        kinds = np.zeros(len(found) + 3, np.int64)
        kinds[2:-1] = rows.kinds[own]
        glued = np.zeros(len(found), np.int64)
        glued[1:] = starts[1:] == ends[:-1]
        told = self._chain.emission(file)
        near = ((kinds[:-3] * 32 + kinds[1:-2]) * 32 + kinds[3:]) * 2 + glued
        return starts, ends, rows.scores[own] + self._near[near] + (told[1:] - told[0])

    def open(self, scores: np.ndarray) -> np.ndarray:
        """Tokens not proved to be outside on every best path.

        How much better the best path up to a token is if it ends in begin or inside, and how much better the best path after it is
        from there, are each bounded from above; where their sum is negative for both tags, outside wins.  What follows "inside"
        obeys V(t) = max(c, k + score(t + 1) + V(t + 1)), a running maximum over sums.
        """
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self._move.tolist()
        first, last = (x[1:] - x[0] for x in (self._chain.first, self._chain.last))
        begin, inside = scores[:, 0], scores[:, 1]
        run = np.cumsum(inside + (ii - oo))
        stop = run + max(io - oo, ib - ob)
        stop[-1] = run[-1] + last[1]
        after_in = np.maximum.accumulate(stop[::-1])[::-1] - run
        after_begin = np.full(len(scores), last[0])
        after_begin[:-1] = np.maximum(bi - oo + inside[1:] + after_in[1:], max(bo - oo, bb - ob))
        to_begin, to_in = begin + max(ob - oo, bb - bo, ib - io), inside + max(oi - oo, bi - bo, ii - io)
        to_begin[0], to_in[0] = begin[0] + first[0], inside[0] + first[1]
        return (to_begin + after_begin > -1e-6) | (to_in + after_in > -1e-6)

    def tags(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi over three tags; ties go to the smaller tag."""
        tags = np.zeros(len(scores), np.int64)
        if len(scores) == 0:
            return tags
        at = np.flatnonzero(self.open(scores))
        if len(at) == 0:
            return tags
        edges = np.flatnonzero(np.diff(at) > 1) + 1
        for start, end in zip(at[np.concatenate([[0], edges])].tolist(), (at[np.concatenate([edges - 1, [len(at) - 1]])] + 1).tolist()):
            begin = self._chain.first if start == 0 else self._move[OUT]
            close = self._chain.last if end == len(scores) else self._move[:, OUT]
            tags[start:end] = self._piece(scores[start:end].tolist(), begin.tolist(), close.tolist())
        return tags

    def _piece(self, scores: list[list[float]], begin: list[float], close: list[float]) -> list[int]:
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self._move.tolist()
        o, b, i = begin
        back = []
        for at, (g, h) in enumerate(scores):
            if at:
                to_o, to_b, to_i, s, t, u = o + oo, o + ob, o + oi, OUT, OUT, OUT
                if b + bo > to_o:
                    to_o, s = b + bo, BEGIN
                if i + io > to_o:
                    to_o, s = i + io, IN
                if b + bb > to_b:
                    to_b, t = b + bb, BEGIN
                if i + ib > to_b:
                    to_b, t = i + ib, IN
                if b + bi > to_i:
                    to_i, u = b + bi, BEGIN
                if i + ii > to_i:
                    to_i, u = i + ii, IN
                back.append((s, t, u))
                o, b, i = to_o, to_b, to_i
            b += g
            i += h
        last = o + close[OUT], b + close[BEGIN], i + close[IN]
        tags = [last.index(max(last))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def spans(self, text: str, file: list[str]) -> list[tuple[int, int]]:
        """Start and end of the secrets in a text, in order."""
        starts, ends, scores = self.scores(text, file)
        tags = self.tags(scores)
        found: list[list[int]] = []
        for at in np.flatnonzero(tags).tolist():  # an inside follows a begin or an inside, as outside may not lead to it
            if tags[at] == BEGIN or not found:
                found.append([int(starts[at]), int(ends[at])])
            else:
                found[-1][1] = int(ends[at])
        return [(a, b) for a, b in found]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, chain: crf.Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans`` (see ``joined``).

    Offsets are code points, ends exclusive.  Null text counts as empty; repeated rows and null ids are kept as they are; an
    empty table gives no rows.
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(chain)
        for frame in batches_by_size(frames, "text", 32_000_000):
            rows = []
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                base, every = find_secrets(text, chain, scorer)
                counts = Counter(s[2] for s in base)
                rows.append((doc_id, counts["assign"], counts["access"], counts["hex"], sha256(joined(base)), joined(every)))
            made = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            yield made.astype({"doc_id": "Int64"})

    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=F.coalesce(F.col(text_col), F.lit("")))
    return flat.mapInPandas(work, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, chain: crf.Chain, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one) and ``chars_col`` counted anew for
    the texts changed.  Null texts stay null."""
    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(chain)
        for texts in parts:
            yield texts.map(lambda t: None if t is None else _without(t, find_secrets(t, chain, scorer)[1], mark))

    made = docs.withColumn(text_col, F.struct(F.col(text_col).alias("was"), clean(F.col(text_col)).alias("now")))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        made = made.withColumn(chars_col, F.when(F.col(text_col)["was"] != F.col(text_col)["now"], F.char_length(F.col(text_col)["now"]).cast(kind)).otherwise(F.col(chars_col)))
    return made.withColumn(text_col, F.col(text_col)["now"])


def _without(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
