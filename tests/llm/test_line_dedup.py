import random
import re
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import line_dedup
from weftline.llm.queries import op12_line_dedup

SCHEMA = "doc_id long, text string"


def key_of(line):
    line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def brute(rows, least=10):
    """(doc_id, n_lines, n_dropped, sha256) of each row."""
    order = lambda d: (d is None, d)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least:
                holders[key_of(line)].add(doc)
    first = {k: min(v, key=order) for k, v in holders.items()}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key_of(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def deduped(df):
    return sorted(map(tuple, line_dedup.digests(df, line_dedup.bitmaps(df)).collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    lines = ["", "short", "Exactly10c", "nine char", "  The Same Line \t", "the same line", "É accent line of text", "é accent line of text", "\x0bspaced out line\x0c", *(f"line number {i:05d}" for i in range(60))]
    rows = [(i * 3 % n, "\n".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 8, 30])))) for i in range(n)]
    return [*rows, (None, "the same line\nonly in null rows here"), (None, "only in null rows here"), (7, None), (8, ""), rows[3], rows[3], (rows[4][0], "line number 00001\nthe same line")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert deduped(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_hash_over_many_tasks_and_batches(spark, monkeypatch):
    """Every document holds the same lines, so a hash's rows fill several tasks, each of several batches; only the first document keeps them."""
    rows = [(i, "\n".join(["the line of everybody", "the line of everybody", f"a line of {i % 5} alone here", "the other line of all"])) for i in range(400)]
    monkeypatch.setattr(line_dedup, "TASK_ROWS", 120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert deduped(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sorted_lines_of_a_hot_hash_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TASK_ROWS", 200)
    df = spark.createDataFrame([(i, "a line that a third of rows hold" if i % 3 == 0 else f"a line of number {i}") for i in range(3000)], SCHEMA)
    docs = line_dedup._documents(df, "doc_id", "text", 10)
    placed = line_dedup._lines(docs).repartitionByRange(15, "hi", "lo", F.col("doc").asc_nulls_last(), "t", "at")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 15 and max(sizes) < 500
    assert line_dedup.dropped(line_dedup._lines(docs), 3000).count() == 999


def test_bitmaps_name_lines_and_apply(spark):
    rows = [(2, "first line here\nx\nFIRST line here \nown line of two"), (1, "zzz\nfirst line here"), (3, None)]
    df = spark.createDataFrame([(*r, "kept", 7) for r in rows], "doc_id long, text string, keep string, n_lines int")
    maps = line_dedup.bitmaps(df)
    flags = {r.doc_id: line_dedup.unpacked(r.keep, r.n_lines).tolist() for r in maps.collect()}
    assert flags == {1: [True, True], 2: [False, True, False, True], 3: [True]}
    out = line_dedup.applied(df, maps)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "zzz\nfirst line here", 2: "x\nown line of two", 3: ""}
    assert sorted(out.columns) == ["doc_id", "keep", "n_dropped", "n_lines", "text"]


def test_bitmaps_round_trip():
    for n in (1, 7, 8, 9, 1000):
        keep = np.random.default_rng(n).random(n) < 0.5
        assert (line_dedup.unpacked(line_dedup.packed(keep), n) == keep).all()
    assert len(line_dedup.packed(np.ones(1_000_000, bool))) < 1000


def test_ids_of_other_kinds_empty_tables_and_long_texts(spark):
    text = "\n".join(f"a line of number {i % 30_000}" for i in range(60_000))
    rows = [("b", text), ("a", "a line of number 17"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert deduped(df) == brute(rows)
    assert deduped(df.limit(0)) == []


def test_a_third_of_rows_are_one_row(spark):
    rows = [(i if i % 3 else None, f"row of number {i if i % 3 else 0}\nin all of the rows") for i in range(600)]
    assert deduped(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, op12_line_dedup(spark, sf).collect()))
    want = sorted(c.sql("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + line_dedup.ORACLE + ")").fetchall())
    assert got == want and sum(r[2] for r in got) > 0
