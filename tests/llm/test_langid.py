import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import langid

WORDS = {"en": "the and of with that from this have which their".split(), "fr": "le les des une dans pour que avec sur être".split(), "de": "der die und nicht mit auf für eine ist von".split()}


def corpus(spark, n=240):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randrange(8, 40))), k) for i, k in ((i, rng.choice(list(WORDS))) for i in range(n))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def brute_counts(text, buckets):
    codes = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
    plain = " " + " ".join("".join(chr(c) if chr(c).isalpha() else " " for c in codes).split()) + " "
    if not plain.strip():
        return {}
    out = {}
    for n in langid.ORDERS:
        for i in range(len(plain) - n + 1):
            g = langid._grams(np.array([ord(c) for c in plain[i : i + n]], np.uint64), buckets)
            at = int(g[langid.ORDERS.index(n), 0])
            out[at] = out.get(at, 0) + 1
    return out


def test_scores_equal_brute_force(spark):
    rows, df = corpus(spark, 60)
    (model,) = langid.fit(df, buckets=4096)
    sums = np.full((len(model.languages), 4096), langid.SMOOTHING)
    for _, t, k in rows:
        for at, n in brute_counts(t, 4096).items():
            sums[model.languages.index(k), at] += n
    logs = np.log(sums / sums.sum(axis=1, keepdims=True))
    assert np.allclose(model.weights.T, logs, atol=1e-6)
    texts = ["Les unes, dans l'être!", "x", "THE and 12 of", "ß"]
    langs, scores = langid.score([model], texts)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        c = brute_counts(t, 4096)
        total = np.array([sum(n * float(logs[i, at]) for at, n in c.items()) for i in range(len(logs))]) * min(1, langid.EVIDENCE / sum(c.values()))
        post = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert model.languages[post.argmax()] == lang and abs(post.max() - score) < 2e-6


def test_held_out_accuracy_and_blindness(spark):
    rows, df = corpus(spark)
    out, _ = langid.identify(df)
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert 30 < len(held) < 90 and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    blind = df.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(blind)[0].collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_sample_is_bounded_and_fixed(spark):
    rows, df = corpus(spark)
    small = langid.fit(df, per_language=5, buckets=4096)[0]
    assert np.array_equal(small.weights, langid.fit(df.repartition(5), per_language=5, buckets=4096)[0].weights)
    assert not np.array_equal(small.weights, langid.fit(df, buckets=4096)[0].weights)


def test_pieces_and_batches_do_not_change_scores(spark, monkeypatch):
    rows, df = corpus(spark, 60)
    models = langid.fit(df, buckets=4096)
    texts = [t for _, t, _ in rows] + ["ab", "a", " a", "a ", "! a!b !!", "dé " * 5000, None, "", "123 !"]
    want = langid.score(models, texts)
    counts = [langid._text_grams(t, 4096).tolist() for t in texts]
    for piece, block, cells in ((1, 10, 7), (2, 1, 1_000_000), (3, 50, 100), (7, 10_000, 40)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "CELLS", cells)
        some = texts[:20] + [t[:300] if t else t for t in texts[-9:]] if piece < 7 else texts
        assert langid.score(models, some) == (want if some == texts else langid.score(models, some))
        assert [langid._text_grams(t, 4096).tolist() for t in texts[:20] + texts[60:65]] == counts[:20] + counts[60:65]
        assert langid.score(models, texts[:20])[1] == want[1][:20]
    assert want[0][-3:] == ["und"] * 3 and want[1][-3:] == [0.0] * 3
    for t, c in zip(texts, counts, strict=True):
        assert dict(c) == brute_counts(t or "", 4096)


def test_many_languages_need_no_other_model(spark, monkeypatch):
    """Matrices of two languages each predict and score like one of all."""
    _, df = corpus(spark)
    more = df.unionByName(df.filter("lang = 'en'").selectExpr("doc_id + 1000 AS doc_id", "translate(text, 'aeiou', 'xyzvw') AS text", "'xx' AS lang")).unionByName(df.filter("lang = 'de'").selectExpr("doc_id + 2000 AS doc_id", "reverse(text) AS text", "'yy' AS lang"))
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(more)[0].collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    out, models = langid.identify(more.withColumn("score", F.lit("x")))
    assert [m.languages for m in models] == [["de", "en"], ["fr", "xx"], ["yy"]] and out.columns[-2:] == ["lang_pred", "score"]
    many = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert many.keys() == one.keys()
    assert all(many[i][0] == one[i][0] and abs(many[i][1] - one[i][1]) < 2e-6 for i in one) and {x for x, _ in one.values()} == {"de", "en", "fr", "xx", "yy"}


def test_a_text_of_a_hundred_megabytes_needs_the_memory_of_a_piece():
    code = """
import resource, numpy as np
from weftline.llm import langid
model = langid.Model(["a", "b", "c", "d"], np.round(np.log(np.random.default_rng(1).random((1 << 16, 4))) * 2**20).astype(np.float32) / 2**20)
text = "Les unes, dans l'eau claire. " * (100_000_000 // 29)
langid.score([model], ["x" * 200_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(langid.score([model], [text])[0][0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert out[0] in "abcd" and int(out[1]) < 100_000


def test_odd_rows(spark):
    _, df = corpus(spark, 60)
    odd = spark.createDataFrame([(None, "les une dans", None), (None, None, "fr"), (5, "", "fr"), (5, "!!", None), (7, "der die und", None)], "doc_id long, text string, lang string")
    both = df.unionByName(odd).withColumn("score", F.lit("x"))
    out, _ = langid.identify(both)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"] and out.count() == 65
    assert out.filter("text IS NULL AND lang_pred <> 'und'").count() == 0
    none, models = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and models == []
    assert langid.identify(df.limit(0))[0].count() == 0
