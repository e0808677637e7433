"""Sections of many documents in one plan, against each section by itself and a plain Python form."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_chunks import chunks
from weftline.operators import drafts, retrieval
from weftline.plans import generate

WORDS = ("architecture", "flow", "service", "config", "test", "plain", "domain", "build")
PLANS = "section string, section_id string, top_k int, words array<string>"


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(7)
    kinds = ("function", "method", "struct", "constant", "variable", "file_module")
    rows = [
        {
            "id": f"c{i:02}", "name": f"{rng.choice(WORDS)}{i}", "unit_type": rng.choice(kinds), "file_path": f"f{rng.randrange(9)}.go", "package": rng.choice(("cli", "db", "")),
            "content": " ".join(rng.choices(WORDS, k=3)), "description": rng.choice(("", "Stores and renders what users ask for.")), "dependencies": [f"{rng.choice(WORDS)}{rng.randrange(40)}"],
        }
        for i in range(40)
    ]
    return rows, chunks(spark, rows).persist()


def expected(rows, hits, kind, top_k, words):
    """Ids of a section's evidence in order, from ids of hits in order; as the docstrings of ``retrieval`` tell."""
    by_id, value = {r["id"]: r for r in rows}, ("constant", "variable")
    testlike = lambda r: "_test" in r["name"] or r["name"].endswith("test")
    keep = {"overview": lambda r: r["unit_type"] not in value, "development": lambda r: not testlike(r), "key-features": lambda r: r["unit_type"] not in (*value, "file_module") and not testlike(r)}.get(kind, lambda r: True)
    some = lambda ids: [i for i in ids if keep(by_id[i])] or ids
    found = some([i for i in hits[: 2 * top_k] if i in by_id])
    limit = 2 * top_k
    if len(found) < top_k // 2:
        text = lambda r: "\n".join((r["name"], r["description"], r["content"])).lower()
        score = {r["id"]: 3 * sum(w in text(r) for w in words) + (r["unit_type"] not in value) for r in rows}
        ranked = sorted(score, key=lambda i: (score[i] <= 0, -score[i], i))[:top_k]
        ranked = [i for i in ranked if (score[i] <= 0) == (score[ranked[0]] <= 0)]
        found, limit = found + [i for i in some(ranked) if i not in found], top_k
    found = found[:limit]
    if len(found) <= top_k:
        return found
    seen, first, late = {}, [], []
    for i in found:
        f = by_id[i]["file_path"]
        seen[f] = seen.get(f, 0) + 1
        (first if seen[f] <= 2 else late).append(i)
    rich = lambda r: 2 * bool(r["description"]) + 2 * bool(r["content"]) + len(r["dependencies"]) + (-1 if r["unit_type"] == "file_module" else 0 if r["unit_type"] in value else 2)
    late.sort(key=lambda i: (-rich(by_id[i]), i))
    return (first + late)[:top_k]


def test_evidence_of_many_sections(spark, held):
    rows, df = held
    rng, plans, hits, want = random.Random(11), [], [], {}
    for n, kind in enumerate(("overview", "key-features", "development", "notes") * 4):
        name, top_k = f"doc{n // 4}/{kind}", rng.choice((4, 6, 12))
        words = rng.sample(WORDS, 3) if n % 5 else ["nowhere"]
        ids = [] if n % 3 == 0 else rng.sample([r["id"] for r in rows] + ["gone1", "gone2"], rng.choice((1, 5, 30)))
        plans.append((name, kind, top_k, words))
        hits += [(name, i, p) for p, i in enumerate(ids, 1)]
        want[name] = expected(rows, ids, kind, top_k, words)
    hits += [(plans[1][0], "", 0), (plans[1][0], None, 0)]
    found = retrieval.select_each(df, spark.createDataFrame(hits, "section string, id string, pos int"), spark.createDataFrame(plans, PLANS))
    got = {}
    for r in found.orderBy("section", "rank").collect():
        got.setdefault(r.section, []).append(r.id)
    assert got == {k: v for k, v in want.items() if v}


def test_no_sections_and_no_chunks(spark, held):
    none = spark.createDataFrame([], "section string, id string, pos int")
    assert retrieval.select_each(held[1], none, spark.createDataFrame([], PLANS)).count() == 0
    one = spark.createDataFrame([("d/overview", "overview", 4, ["flow"])], PLANS)
    assert retrieval.select_each(held[1].limit(0), none, one).count() == 0


def test_a_querys_share_of_hits(spark, held):
    v = held[1].select("id", F.array(F.substring("id", 2, 2).cast("float"), F.lit(9.0).cast("float")).alias("embedding"))
    asked = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(4)] + [("b", 0, [0.0, 1.0])], "section string, n int, query array<float>")
    sections = spark.createDataFrame([("a", 8), ("b", 3), ("c", 5)], "section string, top_k int")
    shares = {(r.section, r.n): r.each for r in retrieval.shares(asked, sections).collect()}
    assert shares == {("a", i): retrieval.per_query_k(8, 4) for i in range(4)} | {("b", 0): 3}
    found = retrieval.search_each(v, asked, sections).collect()
    assert {r.section for r in found} == {"a", "b"} and sorted(r.id for r in found if r.section == "b") == ["c00", "c01", "c02"]
    assert len({(r.section, r.id) for r in found}) == len(found)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "other")
    return n, out


def test_texts_of_many_sections_are_those_of_each_by_itself(spark, held):
    kinds = ("overview", "key-features", "development", "notes")
    heads = {"overview": "## System Diagram", "development": "## Architecture Snapshot"}
    table = lambda of: spark.createDataFrame([(f"{d}/{k}", k, f"T {d}", "Goal.", heads.get(k, "")) for d, k in of], "section string, section_id string, title string, goal string, heading string")
    every = [(d, k) for d in range(3) for k in kinds]
    part = F.substring("id", 2, 2).cast("int") % 3  # document 2's evidence is held back: nothing is known of it
    of = held[1].withColumn("d", part).filter("d < 2").withColumn("section_id", F.explode(F.array(*map(F.lit, kinds)))).withColumn("section", F.concat_ws("/", "d", "section_id")).drop("d")
    n, got = jobs_of(spark, "many", lambda: {r.section: (r.choice, r.content) for r in drafts.best(drafts.texts(of, table(every))).collect()})
    assert set(got) == {f"{d}/{k}" for d, k in every}
    for d, k in ((0, "key-features"), (1, "development")):
        m, one = jobs_of(spark, f"one{d}", lambda: {r.section: (r.choice, r.content) for r in drafts.best(drafts.texts(of.filter(F.col("section") == f"{d}/{k}"), table([(d, k)]))).collect()})  # noqa: B023
        assert one == {f"{d}/{k}": got[f"{d}/{k}"]}
        assert n <= 2 * m + 10
    assert "```mermaid" in got["0/overview"][1] and "No symbols" not in got["0/key-features"][1]
    assert got["2/key-features"][1] == "# Key Features\n\nThe index holds no symbols that show a feature.\n" and got["2/notes"][1] == "# T 2\n\nGoal.\n\n"
    assert "```mermaid\ngraph LR\n```" in got["2/development"][1]
