"""WARC archives: an index of all records first, then byte-range reads of the records asked for.

Each task writes one archive, every record a gzip member of its own, and reports offset, length, URL and digest of each record.
These rows are the index; it is stored before anything is read.  A reader sorts the index rows it was given by file and offset,
joins ranges that lie close together into one read, and unpacks just the selected records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_size, cut_lineage, fresh_path, open_folder, rows_of, tasks_for, unique_name

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, record_type string, refers_to bigint, digest string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def record_types(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id``, ``digest``, ``refers_to`` of the pages whose payload was seen: of equal payloads of at least ``least_bytes`` the largest
    page id is the response, the others revisit it.  Equal means equal SHA-1 and length.

    The group's largest id is a partial sum before any shuffle; only groups with several pages are joined back, and that join
    is on narrow rows, so a payload that a third of all pages share is split by the adaptive skew join.
    """
    seen = pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n"))
    first = seen.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return seen.join(first, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 4) -> DataFrame:
    """Write one record per page below ``folder``; returns the index (see ``INDEX``), already stored.

    Null html is an empty payload, a null URL an empty one (line ends in URLs become spaces, as headers are lines).  A page
    without id is a response and nobody refers to it; of rows with one id and equal payloads each is a response if the id is
    the group's largest, else each revisits it.  An empty table writes nothing.  A task that ran twice leaves an archive
    that no index row names.  A task of the join with the record types writes one archive for each 64 MB of text: the pages are
    not shuffled again for it.
    """
    flat = rows_of(pages, page_id=F.col(id_col).cast("bigint"), url=F.coalesce(F.col(url_col).cast("string"), F.lit("")), html=F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    typed = flat.withColumn("digest", F.sha1("html")).join(record_types(flat), ["page_id", "digest"], "left")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = root = None
        for frame in batches_by_size(frames, "html", 64_000_000):
            if fs is None:
                fs, root = open_folder(folder)
                fs.create_dir(root, recursive=True)
            name, offset, rows = unique_name("pages", ".warc.gz"), 0, []
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                for page_id, url, html, refers_to in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"]):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                    payload, url = html.encode("utf-8", "surrogatepass"), " ".join(url.splitlines())
                    digest = hashlib.sha1(payload).hexdigest()
                    member = gzip.compress(_record("none" if page_id is None else page_id, url, payload, digest, refers_to), level, mtime=0)
                    out.write(member)
                    rows.append((page_id, url, "response" if refers_to is None else "revisit", refers_to, digest, name, offset, len(member)))
                    offset += len(member)
            made = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "digest", "file", "offset", "length"])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return cut_lineage(typed.mapInPandas(write, INDEX))


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of an unpacked record, the full payload's length as its HTTP headers tell, and the payload it holds."""
    head, _, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    body = body[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, size, payload


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """Join ascending (offset, length) ranges not more than ``gap`` bytes apart into reads of at most ``most`` bytes (one range
    alone may be longer): start, end and the positions of the ranges in it."""
    start = end = None
    held: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if held and (offset - end > gap or max(end, offset + length) - start > most):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset + length
        held.append(i)
        end = max(end, offset + length)
    if held:
        yield start, end, held


def read_records(index: DataFrame, folder: str, gap: int = 65_536, most: int = 8_388_608, rows_per_task: int = 20_000) -> DataFrame:
    """The records that ``index`` rows select: see ``RECORD``.  ``payload`` is null for a revisit; its length and digest are
    those of the full payload.  A payload that does not have the digest of its header fails the task."""
    n = tasks_for(index.sparkSession, index.count(), rows_per_task)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        for frame in frames:
            for name, part in frame.groupby("file", sort=False):
                rows = []
                with fs.open_input_file(f"{root}/{name}") as file:
                    ranges = list(zip(part["offset"].tolist(), part["length"].tolist()))
                    urls = part["url"].tolist()
                    for start, end, members in coalesce_ranges(ranges, gap, most):
                        piece = file.read_at(end - start, start)
                        for i in members:
                            offset, length = ranges[i]
                            headers, size, payload = parse_record(zlib.decompress(piece[offset - start : offset - start + length], 31))
                            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"damaged record in {name} at {offset}")
                            rows.append((_id(headers["WARC-Record-ID"]), urls[i], kind, _id(headers.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None))
                        if len(rows) >= 2000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return index.repartition(n, "file").sortWithinPartitions("file", "offset").mapInPandas(load, RECORD)


def _id(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:none>" else int(urn.removeprefix("<urn:page:").rstrip(">"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    return made.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives of all pages into a fresh shared folder and read every record back."""
    folder = fresh_path(spark, "warc")
    return read_records(write_archives(pages, folder), folder)
