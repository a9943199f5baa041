import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.llm.warc import broken_chains, read_warc, write_warc

PAYLOADS = ["<html>a</html>", "", None, "same", "same", "same", "Ä🙂\r\n\r\nWARC/1.1\r\n", "x" * (17 << 20), "\x1f\x08 not a member"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def write(spark, rows, path, **kw):
    write_warc(pages(spark, rows), path, F.col("page_id"), F.col("url"), F.col("html"), **kw)


def expected(rows, min_bytes=0):
    first, out = {}, {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= min_bytes:
            first[b] = min(first.get(b, i), i)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        revisit = first.get(b, i) != i
        out[i] = (len(b), digest, "revisit" if revisit else "response", first[b] if revisit else None, None if revisit else b)
    return out


def read(spark, path, size):
    out = {}
    for r in read_warc(spark, path, size).collect():
        out[int(r.record_id)] = (r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None, bytes(r.payload) if r.payload is not None else None)
    return out


@pytest.mark.parametrize("size", [8 << 20, 333])
def test_round_trip_at_any_range_size(spark, tmp_path, size):
    rnd = random.Random(1)
    texts = PAYLOADS if size > 1000 else [p for p in PAYLOADS if len(p or "") < 1000]
    rows = [(9 - i, f"http://h/ {i}\r\n" if i % 3 else None, t, "x") for i, t in enumerate(texts)]
    rows += [(100 + i, "u", "".join(rnd.choice("abcdefgh<>") for _ in range(rnd.randrange(2000))), "x") for i in range(60)]
    path = str(tmp_path / "w")
    write(spark, rows, path)
    assert read(spark, path, size) == expected(rows)
    assert broken_chains(read_warc(spark, path, size)).count() == 0


def test_files_are_plain_gzip_members(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, [(i, "u", f"text {i}", "x") for i in range(5)] + [(9, "u", "y" * (17 << 20), "x")], path)
    content = b""
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(f"{path}/{name}", "rb") as f:
                content += gzip.decompress(f.read())
    assert content.count(b"WARC/1.1\r\nWARC-Type: response") == 6


def test_false_magic_and_foreign_members(spark, tmp_path):
    record = lambda i, body: gzip.compress((f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n")
    noise = random.Random(2).randbytes(5000)
    data = record(1, noise + b"\x1f\x8b\x08\x00" * 50) + gzip.compress(b"") + record(2, b"short") + gzip.compress(b"not an archive record") + b"\x1f\x8b\x08" + record(3, noise)
    os.mkdir(tmp_path / "w")
    (tmp_path / "w" / "a.warc.gz").write_bytes(data)
    for size in (100, 1 << 20):
        got = read_warc(spark, str(tmp_path / "w"), size)
        assert sorted((r.record_id, r.payload_bytes) for r in got.collect()) == [("1", 5200), ("2", 5), ("3", 5000)]


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(1, "u", "ab", "x"), (2, "u", "ab", "x"), (3, "u", "abc", "x"), (4, "u", "abc", "x")]
    write(spark, rows, str(tmp_path / "w"), min_bytes=3)
    assert read(spark, str(tmp_path / "w"), 1 << 20) == expected(rows, 3)


def test_edges(spark, tmp_path):
    rows = [(None, "u", "same", "x"), (2, "u", "same", "x"), (2, "u", "same", "x"), (3, "u", "same", "x")]
    write(spark, rows, str(tmp_path / "w"))
    got = sorted((str(r.record_id), r.record_type, r.refers_to) for r in read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [("2", "response", None), ("2", "response", None), ("3", "revisit", "2"), ("None", "response", None)]
    write(spark, [], str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
