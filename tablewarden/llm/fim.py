"""Fill-in-the-middle transformation by displacement scatter.

The texts of a batch lie one after another as bytes.  A scan finds where tokens end, the draws of a document pick two of these as
its cuts, and the three parts of every document get the shift that takes them to their place in the output.  The shifts are entered as
differences where a part starts; their running sum is the shift of every byte, and one scatter writes the output.  Restoring
finds the three marks of an output, works out where each byte of the text lies in it the same way, and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

BLOCK = 4 << 20  # bytes worked on at once, unless one text is longer
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KIND = np.zeros(256, bool)
KIND[[ord(c) for c in "PSM"]] = True
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)


def byte_blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text: rows, their bytes, and the n + 1 offsets into these."""
    texts = batch.column(column).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow column of texts from their bytes and offsets."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``<P>``, ``<S>`` and ``<M>`` and the texts they lie in."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & KIND[data[1:-1]]) if len(data) > 2 else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[text + 1]
    return at[inside], text[inside]


def displaced(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """0..size-1, each plus the shift of the part it lies in; parts (in order, possibly empty) go on until the next one starts."""
    kind = np.int32 if size < 1 << 30 else np.int64
    steps = np.zeros(size + 1, kind)
    np.add.at(steps, starts, np.diff(shifts, prepend=0).astype(kind))
    where = np.cumsum(steps[:size], dtype=kind)
    where += np.arange(size, dtype=kind)
    return where


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every text, and the places where its prefix and its middle end."""
    starts, stops = offsets[:-1], offsets[1:]
    space = SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[stops[stops > starts] - 1] = True
    ends = np.flatnonzero(ends) + 1
    first = np.searchsorted(ends, starts, "right")
    n = np.searchsorted(ends, stops, "right") - first
    one, other = h1 % (n + 1), h2 % (n + 1)
    place = lambda k: np.where(k == 0, starts, np.append(ends, 0)[first + np.maximum(k, 1) - 1])
    return n, place(np.minimum(one, other)), place(np.maximum(one, other))


def scatter(data: np.ndarray, offsets: np.ndarray, p_end: np.ndarray, m_end: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs."""
    starts, stops = offsets[:-1], offsets[1:]
    prefix, middle, suffix = p_end - starts, m_end - p_end, stops - m_end
    made = np.concatenate([[0], np.cumsum(stops - starts + np.where(form == PLAIN, 0, 9))])
    base, psm, plain = made[:-1], form == PSM, form == PLAIN
    to_prefix = base + np.where(plain, 0, np.where(psm, 3, suffix + 6))
    to_suffix = base + np.where(plain, prefix + middle, np.where(psm, prefix + 6, 3))
    to_middle = base + np.where(plain, prefix, prefix + suffix + 9)
    froms = np.stack([starts, p_end, m_end], 1).ravel()
    shifts = np.stack([to_prefix, to_middle, to_suffix], 1).ravel() - froms
    out = np.empty(made[-1], np.uint8)
    out[displaced(len(data), froms, shifts)] = data
    marked = ~plain
    for letter, to in (("P", to_prefix), ("S", to_suffix), ("M", to_middle)):
        for k, byte in enumerate(f"<{letter}>".encode()):
            out[to[marked] - 3 + k] = byte
    return out, made


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that ``data`` was made from.  An output without its three marks stops the job."""
    starts, stops = offsets[:-1], offsets[1:]
    marked = np.flatnonzero(form != PLAIN)
    at, text = marks(data, offsets)
    at = at[form[text] != PLAIN]
    if len(at) != 3 * len(marked):
        raise ValueError("an output does not hold three marks")
    first, second, third = at.reshape(-1, 3).T
    psm = form[marked] == PSM
    sizes = stops - starts
    sizes[marked] -= 9
    made = np.concatenate([[0], np.cumsum(sizes)])
    froms, tos = np.stack([starts] * 3, 1), np.stack([made[:-1]] * 3, 1)
    x, y, z = second - first - 3, third - second - 3, stops[marked] - third - 3
    prefix = np.where(psm, x, y)
    froms[marked] = np.stack([np.where(psm, first, second) + 3, third + 3, np.where(psm, second, first) + 3], 1)
    tos[marked, 1] += prefix
    tos[marked, 2] += prefix + z
    return data[displaced(made[-1], tos.ravel(), (froms - tos).ravel())], made


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id``, ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain), ``output``.

    Cuts and form are drawn from the SHA-256 of seed and id alone, so every run gives the same.  ``rate`` of 100 texts are cut, ``spm`` of
    100 of those in suffix-first form.  Null texts count as empty; empty texts and texts that hold a mark stay plain.  Rows without
    id draw as if the id were the empty text.  Repeated rows are kept; an empty table gives no rows.  Texts of any length are cut whole.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    drawn = flat.select("doc_id", "text", digest.alias("d")).select(
        "doc_id", "text", *[F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in byte_blocks(batch, "text"):
                h1, h2, h3, h4 = (rows.column(f"h{k}").to_numpy() for k in range(1, 5))
                n, p_end, m_end = cuts(data, offsets, h1, h2)
                plain = (offsets[1:] == offsets[:-1]) | (h3 % 100 >= rate)
                plain[marks(data, offsets)[1]] = True
                form = np.where(plain, PLAIN, np.where(h4 % 100 < spm, SPM, PSM))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                prefix, middle = chars[p_end] - chars[offsets[:-1]], chars[m_end] - chars[p_end]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), pa.array(prefix, pa.int64(), mask=plain),
                    pa.array(middle, pa.int64(), mask=plain), strings(*scatter(data, offsets, p_end, m_end, form))],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return drawn.mapInArrow(work, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(made: DataFrame) -> DataFrame:
    """``made`` (``doc_id``, ``form``, ``output`` and other columns of ``transform``) with ``restored``, the text, from ``output`` and
    ``form`` alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in byte_blocks(batch, "output"):
                form = np.searchsorted(FORMS, rows.column("form").to_numpy(zero_copy_only=False).astype(FORMS.dtype))
                yield pa.RecordBatch.from_arrays([*rows.columns, strings(*gather(data, offsets, form))], [*rows.schema.names, "restored"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(work, f"{schema}, restored string")


def digests(restored: DataFrame) -> DataFrame:
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                           F.sha2("restored", 256).alias("restored_sha256"))
