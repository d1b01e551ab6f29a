"""WARC archives: round trips against a plain model, magic lines in payloads, odd rows."""

import base64
import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.llm import warc
from tissuelake.llm.common import workspace

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
SCHEMA = "page_id long, url string, html string"


def want(rows, least=0):
    held = collections.defaultdict(list)
    for i, _, h in rows:
        held[h or ""].append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x in held[h or ""] if x is not None), default=None)
        first = i == top or len(raw) < least or len(held[h or ""]) == 1
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_round_trip_with_magic_in_payloads(spark, small, monkeypatch):
    random.seed(2)
    kinds = lambda: random.choice(["", FAKE, "x" * random.randint(0, 3000) + FAKE * random.randint(0, 300) + "WARC/1.1\r\n", None, "same" * 50, "é" * random.randint(1, 90000), FAKE.replace(": 5", ": 99999") * 9000])
    rows = [(i, None if i % 9 == 0 else "u\r\n", kinds()) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    write = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda *a: write(*a, small=small))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")  # splits inside records, some of them over several splits
        assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == want(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_payloads_come_back(spark):
    rows = [(1, "a", "x" + FAKE * 3), (2, "b", "é"), (3, "c", None)]
    path = workspace(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), path)
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).collect()}
    assert got == {f"<urn:x-page:{i}>": h or "" for i, _, h in rows}


def test_odd_rows(spark):
    rows = [(None, "u", "alone"), (None, "u", "twice"), (5, "u", "twice"), (7, None, "b"), (7, "v", "b"), (8, "v", None), (9, "v", ""), (None, None, None), (10, "v", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "bytes": F.lit("x"), "kept": F.lit(2), "value": F.lit(3)})
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == want(rows)
    assert sorted(map(tuple, warc.round_trip(df, min_bytes=2).collect()), key=str) == want(rows, 2)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_time_is_linear_in_false_headers(spark):
    took = []
    for n in (1000, 8000, 64000):
        df = spark.createDataFrame([(1, "u", FAKE.replace(": 5", ": 9999999") * n)], SCHEMA)
        began = time.time()
        assert warc.round_trip(df).first().payload_bytes == n * len(FAKE.replace(": 5", ": 9999999"))
        took.append(time.time() - began)
    assert took[2] < 3 * took[0] + 5


def test_pointer_jumping():
    assert warc.exits(np.array([0, 10, 30, 35]), np.array([10, 30, 99, 90])).tolist() == [99, 99, 99, 90]
