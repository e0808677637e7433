import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_bpe import reference
from tests.llm.test_mixing import brute_targets
from tests.llm.test_repetition import brute
from tests.llm.test_simhash import brute_components, brute_fingerprint
from weftline import staging
from weftline.llm import queries, repetition

SF = "/root/testdata/sf0.001"


def prose(rng, lang, n):
    words = {"en": "the and of with that from this have which their", "fr": "le les des une dans pour que avec sur être"}[lang].split()
    return " ".join(rng.choice(words) + str(rng.randrange(30)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(7), []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        rows.append((i, prose(rng, lang, rng.randrange(60, 200)), lang, rng.choice(["a", "a", "b", None])))
    rows += [(200 + i, rows[i][1], rows[i][2], "c") for i in range(30)] + [(300, None, "en", "a"), (301, "", None, None), (302, "12 34 " * 60, "en", "b"), (303, "too short", "en", "b"), (304, rows[5][1] + " " + rows[5][1], "en", "a")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_run_equals_brute_force(spark, folder):
    path, rows = folder
    out = corpus_pipeline.run(spark, path).collect()
    kept = []
    for r in rows:
        b = brute(r[1], repetition.MIN_WORDS)
        if b[0] >= 50 and 100 * b[4] <= 50 * b[0] and b[5] <= repetition.MAX_REPEAT and b[6] <= repetition.MAX_COVERED * b[0] and any(c.isalpha() for c in r[1]):
            kept.append(r)
    prints = [brute_fingerprint(r[1]) for r in kept]
    label = brute_components(prints)
    best = {}
    for r, x in zip(kept, label, strict=True):
        best[x] = min(best.get(x, r), r)
    docs = {r[0]: r for r in best.values()}
    counts = {}
    for r in out:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) <= set(docs), "only survivors are encoded"
    sizes = {}
    for i, t, _, s in docs.values():
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for s, target in brute_targets(sizes).items():
        rate = target / sizes[s]
        copies = [counts.get(i, 0) for i, _, _, x in docs.values() if x == s]
        assert all(int(rate) <= c <= min(3, int(rate) + 1) for c in copies) and abs(sum(copies) - rate * len(copies)) <= 1
    _, library = reference()
    for r in out:
        assert r.n_tokens == len(library.encode_ordinary(docs[r.doc_id][1])) and r.source == docs[r.doc_id][3]


def test_stages_keep_values_of_clashing_columns(spark, folder):
    path, rows = folder
    names = ["kept", "score", "size", "copies", "target", "n_words", "first", "before", "fp", "row", "task", "_id", "held_out", "lang_pred", "taken"]
    docs = queries.table(spark, path, "documents").filter("doc_id < 60")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, path)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "words"]
    clash = docs.withColumns({c: F.lit("x") for c in names})
    out = corpus_pipeline.encoding(spark, clash, path)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count() and dict(out.dtypes)["n_tokens"] == "bigint"


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Repeated rows, null and repeated ids, nulls in every column, an empty text and a very long one."""
    rng = random.Random(12)
    rows = [(i, prose(rng, ["en", "fr"][i % 2], 80), ["en", "fr"][i % 2], ["a", "b"][i % 2]) for i in range(60)]
    long = " ".join(f"{w}{i % 977}x{i % 1009}" for i, w in enumerate(["the", "and", "of", "with"] * 60_000))
    rows += [rows[0], rows[0], (None, prose(rng, "en", 90), "en", None), (None, prose(rng, "fr", 90), None, None), (7, prose(rng, "en", 90), None, "b"), (None, None, None, None), (90, "", "en", "a"), (91, long, "en", "a")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = staging.mark()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert staging.mark() == before + 1, "only the last stage's rows are still staged"
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(hashlib.sha256((r[1] or "").encode()).hexdigest())
    assert out and all(r.decoded_sha256 in texts[r.doc_id] for r in out)
    counts = {}
    for r in out:
        counts[r.doc_id, r.decoded_sha256] = counts.get((r.doc_id, r.decoded_sha256), 0) + 1
    assert max(counts.values()) <= 3 and {90, 91, None} & {r.doc_id for r in out} == {91, None} and len(long) > 1_000_000
    assert next(r.n_tokens for r in out if r.doc_id == 91) == len(reference()[1].encode_ordinary(long))


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, _ = folder
    docs = queries.table(spark, path, "documents")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, path).columns == docs.columns
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), path).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_tokens_of_a_corpus(spark):
    _, library = reference()
    texts = [r.text for r in queries.table(spark, SF, "documents").collect()]
    got = {r.n_tokens: r.n_docs for r in queries.QUERIES["op8_token_histogram"](spark, SF).collect()}
    want = {}
    for t in texts:
        n = len(library.encode_ordinary(t or ""))
        want[n] = want.get(n, 0) + 1
    assert got == want
