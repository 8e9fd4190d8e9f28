import hashlib

from pyspark.sql import functions as F

from tablewarden.llm import warc
from tablewarden.session import fresh_path

BIG = "x" * 1000
ROWS = [(1, "u1", BIG), (5, "u5", BIG), (3, None, BIG), (4, "u\r\nWARC-Type: evil", "short"), (6, "u6", "short"), (7, "u7", None), (8, "u8", ""),
        (None, "u", BIG), (9, "u9", "é" * 500 + "\r\n\r\n"), (10, "u10", "é" * 500 + "\r\n\r\n"), (11, "u", "<p>" * 300_000), (5, "u5", BIG)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "noise") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip_gives_every_record(spark):
    got = sorted(map(tuple, warc.archive_round_trip(spark, pages(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    top = {BIG: 5, "é" * 500 + "\r\n\r\n": 10}
    want = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        other = top.get(html)
        revisit = page_id is not None and other is not None and page_id < other
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    assert got == sorted(want, key=str)


def test_selected_records_are_read_alone(spark):
    folder = fresh_path(spark, "warc")
    index = warc.write_archives(pages(spark), folder)
    assert index.count() == len(ROWS)
    some = warc.read_records(index.where(F.col("page_id").isin(4, 10)), folder).orderBy("page_id").collect()
    assert [bytes(r["payload"]).decode() for r in some] == ["short", "é" * 500 + "\r\n\r\n"]


def test_close_ranges_become_one_read():
    ranges = [(0, 10), (10, 5), (30, 5), (200, 900), (1100, 1)]
    assert list(warc.coalesce_ranges(ranges, 20, 500)) == [(0, 35, [0, 1, 2]), (200, 1100, [3]), (1100, 1101, [4])]
    assert list(warc.coalesce_ranges([], 20, 500)) == []


def test_an_empty_table_gives_no_records(spark):
    assert warc.archive_round_trip(spark, pages(spark, [])).count() == 0
