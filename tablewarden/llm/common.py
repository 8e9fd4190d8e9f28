"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_limit, cut_lineage, fresh_path, shared_dir  # noqa: F401  (used by the operators)

# A word of every contract: a run of characters other than space and the controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """The words of ``text``; ``str.split()`` also splits at other Unicode spaces, so it serves texts without them only."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rows_of(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the operator's own names, so other columns of the caller cannot clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def join_small(df: DataFrame, facts: DataFrame, on: list[str], how: str, most: int = 200_000) -> DataFrame:
    """Join with a table that is broadcast only when it was counted and has at most ``most`` rows; else both are shuffled.

    ``facts`` must be a stored table (see ``cut_lineage``), as it is counted here.
    """
    small = facts.limit(most + 1).count() <= most
    return df.join(F.broadcast(facts) if small else facts.hint("shuffle_merge"), on, how)


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` rows, and never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def unique_name(stem: str, suffix: str) -> str:
    """A file name no other attempt of the same task uses."""
    return f"{stem}-{os.getpid()}-{uuid.uuid4().hex}{suffix}"


def open_folder(uri: str):
    """File system and inner path of a shared folder, for tasks that write or read files of their own format."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def batches_by_size(frames: Iterator, column: str, most_chars: int) -> Iterator:
    """Cut Arrow-sized pandas batches further, so that none holds more than about ``most_chars`` of text unless one row does."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).cumsum()
        group = (sizes // most_chars).to_numpy()
        if len(group) == 0 or group[0] == group[-1]:
            yield frame
        else:
            for _, part in frame.groupby(group, sort=True):
                yield part
