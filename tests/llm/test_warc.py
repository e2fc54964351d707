"""WARC: exact round trips, damaged archives, edge cases."""

import base64
import hashlib
import random
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from mnemora.llm import common, warc


def pages(n=120):
    rnd = random.Random(1)
    words = ["<p>", "</p>", "alpha", "béta", "gamma", "漢字", "\r\n\r\n", "WARC/1.1"]
    out = [(i, f"http://h{i % 7}.example/{i} x", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200)))) for i in range(n)]
    out += [(n + i, None, out[5][2]) for i in range(5)] + [(900, "u", None), (901, "u\r\nX: y", ""), (902, "u", "x" * 400_000), (902, "u", "x" * 400_000), (903, "v", "x" * 400_000)]
    return out


def brute(rows):
    head = {}
    for i, _, h in rows:
        head[h or ""] = max(head.get(h or "", -1), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = head[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = warc.warc_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    archives = warc.write_archives(df)
    back = {r.record_id: bytes(r.payload) for r in warc.read_archives(archives).filter("record_type = 'response'").collect()}
    assert all(back[str(i)] == (h or "").encode() for i, _, h in rows if str(i) in back)
    nameless = warc.warc_round_trip(spark.createDataFrame([(None, None, "same"), (None, "u", "same"), (4, "u", "same"), (None, "u", "own")], "page_id long, url string, html string"))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in nameless.collect() if r.page_id) == [(4, "response", None)]
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in nameless.collect() if r.page_id is None) == [(3, "response", None), (4, "revisit", 4), (4, "revisit", 4)]
    small = warc.write_archives(df, min_bytes=1 << 40)
    assert warc.read_archives(small).filter("record_type = 'revisit'").count() == 0
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_dictionary_and_damage():
    records = [warc.record_bytes(str(i), f"http://a/{i}", f"<html>{i} {'word ' * (i % 50)} {random.Random(i).random()}</html>".encode() * 4, "response", "") for i in range(400)]
    data = warc.archive_bytes(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    found = list(warc.read_archive(data))
    assert len(found) == 400 and found[7][0]["warc-record-id"] == "<urn:page:7>"
    plain = zstandard.ZstdCompressor()
    assert len(list(warc.read_archive(plain.compress(records[0]) + plain.compress(records[1])))) == 2
    for broken in (data[:-5], data[:40], data[:9000] + b"\0" + data[9001:], plain.compress(records[0][:-1]), plain.compress(records[0].replace(b"WARC-Date", b"WARC-Data")), b"junk"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(broken))
    assert list(warc.read_archive(b"")) == []


def test_headers_in_any_case_and_repeated():
    record = warc.record_bytes("1", "u", b"<p>x</p>", "response", "")
    odd = record.replace(b"WARC-Date", b"warc-date").replace(b"Content-Type: application/http", b"WARC-Concurrent-To: <urn:a>\r\nWARC-Concurrent-To: <urn:b>\r\nContent-Type: application/http", 1)
    headers, _ = warc.parse_record(odd)
    assert headers["warc-concurrent-to"] == "<urn:a>\n<urn:b>" and headers["warc-date"] == warc.DATE
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"WARC-Date", b"warc-date: x\r\nWARC-Date", 1))


def test_reading_takes_time_in_proportion():
    took = []
    for n in (2_000, 8_000):
        packer = zstandard.ZstdCompressor(level=1)
        data = b"".join(packer.compress(warc.record_bytes(str(i), "u", random.Random(i).randbytes(4_000), "response", "")) for i in range(n))
        start = time.process_time()
        assert sum(1 for _ in warc.read_archive(data)) == n
        took.append(time.process_time() - start)
    assert took[1] < 8 * max(took[0], 0.05), took


def test_other_records_and_hot_digests(spark):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n"
    frames = zstandard.ZstdCompressor().compress(info) + zstandard.ZstdCompressor().compress(warc.record_bytes("2", "u", b"x", "revisit", "9"))
    rows = warc.read_archives(spark.createDataFrame([(bytearray(frames),)], "data binary")).collect()
    assert [(r.record_type, r.payload_bytes, r.refers_to, r.payload) for r in rows] == [("warcinfo", None, None, None), ("revisit", 1, "9", None)]
    df = spark.createDataFrame([(i, "u", "" if i % 3 else f"own {i // 2}") for i in range(300)], "page_id long, url string, html string")
    heads = spark.createDataFrame([("", 200, 299), ("own 0", 1, 0)], "html string, n long, head long")
    left = common.join_hot(df, heads, "html", "n", hot=50, most=1)
    assert left.filter("html = ''").agg(F.min("head"), F.count("*")).first()[:] == (299, 200) and left.count() == 300
    assert left.filter("html != '' AND head IS NOT NULL").count() == 1
    assert sorted(map(str, common.join_hot(df, heads, "html", "n", hot=0, most=1).collect())) == sorted(map(str, left.collect())) == sorted(map(str, common.join_hot(df, heads, "html", "n").select(left.columns).collect()))
