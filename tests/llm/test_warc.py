import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gatewarden.llm import warc

PAGES = "page_id long, url string, html string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0):
    largest = {}
    for i, _, html in rows:
        if i is not None:
            payload = (html or "").encode()
            largest[payload] = max(largest.get(payload, i), i)
    out = []
    for i, url, html in rows:
        payload = (html or "").encode()
        original = largest.get(payload)
        revisit = original is not None and original != i and len(payload) >= least
        out.append((i, url, len(payload), sha1(payload), "revisit" if revisit else "response", original if revisit else None))
    return Counter(out)


ROWS = [
    (1, "http://a/", "<p>same</p>"), (5, "http://b/ c\r\nd%20é", "<p>same</p>"), (3, None, "<p>same</p>"),
    (4, "", None), (7, "http://e/", ""), (8, "http://f/", "x" * 200_000 + "\r\n\r\nWARC/1.1\r\n\r\n é漢"), (8, "http://f/", "other"),
    (9, "http://g/", "twice"), (9, "http://g/", "twice"), (None, "http://h/", "<p>same</p>"), (None, None, "alone"),
    (-2, "http://i/", "\r\n\r\n"),
]


def test_round_trip_matches_a_plain_version(spark):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("offset", F.lit("clash")).repartition(3)
    for least in (0, 5):
        index = warc.write_archive(pages, least_bytes=least)
        got = warc.read_records(index).collect()
        assert Counter(tuple(r)[:6] for r in got) == plain(ROWS, least)
        payloads = Counter(bytes(r.payload) for r in got if r.record_type == "response")
        assert set(payloads) == {(h or "").encode() for _, _, h in ROWS}
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


def test_archives_are_gzip_members_that_the_index_points_to(spark):
    index = warc.write_archive(spark.createDataFrame(ROWS, PAGES).coalesce(1))
    rows = index.collect()
    raw = open(rows[0].file, "rb").read()
    assert sum(r.length for r in rows) == len(raw)
    whole = gzip.decompress(raw)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    for r in rows:
        member = gzip.decompress(raw[r.offset : r.offset + r.length])
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
    # Selected records alone are read.
    some = index.where("page_id in (1, 8)")
    assert sorted(r.page_id for r in warc.read_records(some).collect()) == [1, 8, 8]


def test_ranges_join_near_records_and_respect_the_limit():
    offsets = np.array([0, 100, 200, 10_000_000, 10_000_100])
    lengths = np.array([100, 100, 50, 100, warc.READ_BYTES])
    assert warc.ranges(offsets, lengths) == [(0, 3), (3, 4), (4, 5)]
    assert warc.ranges(offsets[:0], lengths[:0]) == [(0, 0)] or warc.ranges(offsets[:0], lengths[:0]) == []
