import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import skew, warc

SCHEMA = "page_id long, url string, html string, payload_digest string"


def want(pages, least=0):
    first = {}
    for i, u, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, p[1] is None, (p[1] or "").encode())):
        first.setdefault((h or "").encode(), (i, u))
    out, used = [], set()
    for i, u, h in pages:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        whole = len(body) < least or first[body] == (i, u) and body not in used
        if whole and len(body) >= least:
            used.add(body)
        out.append((i, len(body), digest, "response" if whole else "revisit", None if whole else first[body][0]))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", rng.choice(["same", None, "", f"<p>é{i}</p>", "x" * rng.randrange(2000)])) for i in range(200)]
    return [*rows, (5, "http://h/5", rows[5][2]), (5, "http://h/5", "again"), (5, "http://h/5", "again"), (None, None, "same"), (None, "a b\r\nc", "own"), (None, None, None), (300, "u", "z" * 300_000)]


def result(spark, path):
    return sorted(map(tuple, warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    path = warc.write(df, f"file://{tmp_path}/w", shards=3, roll_bytes=2000, min_revisit_bytes=least)
    assert result(spark, path) == want(rows, least)
    whole = sorted(bytes(r.payload) for r in warc.read(spark, path).filter("record_type = 'response'").collect())
    assert whole == sorted({(h or "").encode() for _, _, h in rows if len((h or "").encode()) >= least} | set()) + [] if least == 0 else len(whole) > 0
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith(".shard")]


def test_files_are_the_same_in_every_run(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in pages()], SCHEMA)
    read = lambda name: {f: open(tmp_path / name / f, "rb").read() for f in os.listdir(tmp_path / name) if f.endswith(".gz")}
    warc.write(df, f"file://{tmp_path}/a", shards=3, roll_bytes=3000)
    warc.write(df.repartition(9), f"file://{tmp_path}/b", shards=3, roll_bytes=3000)
    a, b = read("a"), read("b")
    assert a == b and len(a) > 3
    one = gzip.decompress(next(iter(a.values())))
    assert one.startswith(b"WARC/1.1\r\n") and b"WARC-Record-ID: <urn:uuid:" in one


def test_a_hot_payload_is_compressed_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i % 50}", "hot " * 300 if i % 3 else f"own {i}") for i in range(400)] + [(1, "u1", "hot " * 300)] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(8)
    plain = result(spark, warc.write(df, f"file://{tmp_path}/a", shards=2))
    monkeypatch.setattr(warc, "MOST_HOT", 3)
    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    monkeypatch.setattr(skew, "MOST_HOT", 3)
    seen, keys = warc._keyed(df)
    members = warc.records(seen, keys).filter("member IS NOT NULL")
    assert members.filter(F.col("sha") == hashlib.sha1(("hot " * 300).encode()).hexdigest()).count() <= 4  # the first row and its repeats
    assert result(spark, warc.write(df, f"file://{tmp_path}/b", shards=2)) == plain == want(rows)


def test_shards_follow_the_bytes():
    sizes = [0, 1, 8 << 20, 100 << 20, 1 << 30, 30 << 30, 100 << 40]
    assert [warc.shards_for(n) for n in sizes] == [1, 1, 1, 13, 68, 184, 409664]
    assert type(warc._fs("s3a://bucket/x?region=us-east-1")[0]).__name__ == "S3FileSystem" and warc._fs("file:///tmp/x")[1] == "/tmp/x"


def test_broken_files_are_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc", "x")], SCHEMA)
    path = warc.write(df, f"file://{tmp_path}/w", shards=1)
    name = next(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    data = gzip.decompress((tmp_path / "w" / name).read_bytes()).replace(b"abc", b"abd")
    (tmp_path / "w" / name).write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, path).collect()


def test_files_without_manifest_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc", "x")], SCHEMA)
    path = warc.write(df, f"file://{tmp_path}/w", shards=1)
    (tmp_path / "w" / "shard-00009-of-00001-0000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, path).count() == 1


def test_empty(spark, tmp_path):
    path = warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert warc.read(spark, path).count() == 0
