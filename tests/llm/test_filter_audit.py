import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import filter_audit, skew
from weftline.llm.queries import op13_filter_audit

WORD = "[^\x20\x09-\x0d]+"


def fails(rows):
    """A set of letters for each row, straight from the rules."""
    import re

    out = []
    for i, (doc, text, _) in enumerate(rows):
        text = text or ""
        words = re.findall(WORD, text)
        others = [d for j, (d, t, _) in enumerate(rows) if j != i and (t or "") == text]
        earlier = any(d is not None and (doc is None or d < doc) for d in others)
        rules = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": earlier,
        }
        out.append({f for f, bad in rules.items() if bad})
    return out


def brute(rows, labels):
    """Plays every order on every document."""
    failed = fails(rows)
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    table = {}
    for part in {p or "" for _, _, p in rows}:
        own = [(doc, f) for (doc, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [doc for doc, f in own if letter in f and not f & before]
                table[part, "".join(order), step] = [
                    sum(not f & (before | {letter}) for _, f in own), len(gone), sum(letter in f and bool(f & before) for _, f in own),
                    sum(f == {letter} for _, f in own), sum(d in good for d in gone), sum(d in toxic for d in gone),
                ]
    shapley = {}
    for (part, order, step), row in table.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + row[1]
    return {(p, o, s): (*row, shapley[p, o[s - 1]]) for (p, o, s), row in table.items()}


def corpus(n=160):
    rng = random.Random(13)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "gamma", "x%", "Ünï"]) + (str(rng.randrange(400)) if i % 3 else "") for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        text = rng.choice([" ", "\n", "\x0b"]).join(words)
        rows.append((i, rng.choice([text, text.lower(), rows[rng.randrange(len(rows))][1] if rows else None, None, ""]), rng.choice(["en", "de", None, ""])))
    rows += [(5, rows[5][1], "en"), (None, rows[7][1], "de"), (None, "only here", "fr"), (None, "only here", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)]
    return rows, [*labels, (4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]


def frames(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def by_key(df):
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    assert len(out) == df.count()
    return out


@pytest.fixture(scope="module")
def case(spark):
    rows, labels = corpus()
    return rows, labels, *frames(spark, rows, labels)


def test_equals_playing_every_order(case):
    rows, labels, docs, marks = case
    out = filter_audit.run(docs, marks)
    assert by_key(out) == brute(rows, labels)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "string", "int"] + ["bigint"] * 7


def test_hot_texts_and_clashing_columns(spark, case, monkeypatch):
    rows, labels, docs, marks = case
    want = by_key(filter_audit.run(docs, marks))
    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    extra = docs.withColumns({c: F.lit("x") for c in ("mask", "part", "digest", "n", "first_id", "good", "toxic", "bits")})
    assert by_key(filter_audit.run(extra.repartition(5), marks.withColumn("part", F.lit(1)).withColumn("good", F.lit(0)))) == want


def test_transform_is_its_own_inverse(spark):
    rows = spark.range(500).selectExpr("'p' AS part", "cast(id * id % 32 AS int) AS mask", "cast(id % 3 = 0 AS int) AS good", "0 AS toxic")
    counts = {r["mask"]: r["count"] for r in rows.groupBy("mask").count().collect()}
    got = filter_audit.parity_sums(rows).select(filter_audit.cells(F.col("all")), filter_audit.cells(F.col("toxic"))).first()
    assert list(got[0]) == [counts.get(m, 0) for m in range(32)] and list(got[1]) == [0] * 32


def test_removed_and_shapley_add_up(case):
    """Over an order all removals are what fails anything; the five Shapley values are 120 times that."""
    rows, labels, docs, marks = case
    out = filter_audit.run(docs, marks)
    gone = out.groupBy("part", "filter_order").agg(F.sum("removed").alias("n"), F.sum("shapley").alias("s")).collect()
    failed = fails(rows)
    for r in gone:
        want = sum(bool(f) for (_, _, p), f in zip(rows, failed, strict=True) if (p or "") == r.part)
        assert (r.n, r.s) == (want, 120 * want)


def test_empty_tables(spark, case):
    _, _, docs, marks = case
    assert filter_audit.run(docs.limit(0), marks).count() == 0
    assert {r.good_lost + r.toxic_lost for r in filter_audit.run(docs, marks.limit(0)).collect()} == {0}


def test_a_long_text_is_read_whole(spark):
    text = "word " * 400_000 + "$"
    docs = spark.createDataFrame([(1, text, "en"), (2, text[:-1], "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r["mask"] for r in filter_audit.masks(docs).collect()}
    assert got == {1: 0b01010, 2: 0b00010}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = op13_filter_audit(spark, sf).toPandas(), c.sql(filter_audit.ORACLE).df()
    keys = ["part", "filter_order", "step"]
    got, want = (d[sorted(d.columns)].sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert got.astype(want.dtypes.to_dict()).equals(want) and len(want) == 600 * want.part.nunique()
