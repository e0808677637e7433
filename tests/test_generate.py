import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tests.test_documents import GO
from weftline import __main__ as cli
from weftline.functions import providers
from weftline.operators import vector
from weftline.operators.vector import hashing_embedder
from weftline.plans import generate, sync
from weftline.sources import config
from weftline.sources import model as models
from weftline.sources.store import Store, StoredIndex


def faults(spark, model):
    return [(r.path, r.rule) for r in models.problems(spark.createDataFrame([("m", json.dumps(model))], "doc string, model string")).collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, text in GO.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    sync.scan(spark, str(root), store)
    out = tmp_path_factory.mktemp("out")
    return store, out, generate.generate(spark, store, f"file://{out}", hashing_embedder(16))


def test_generate_writes_model_markdown_and_report(spark, built):
    _, out, model = built
    assert [s["id"] for s in model["sections"]] == ["overview", "key-features", "development"]
    assert faults(spark, json.loads((out / "doc_model.json").read_text())) == []
    text = (out / "documentation.md").read_text()
    assert "```mermaid" in text and text.startswith("# Project Documentation")
    r = json.loads((out / "report.json").read_text())
    assert r["summary"]["section_count"] == 3 and r["summary"]["failed_stages"] == 0 and set(r["summary"]["signals_by_severity"]) >= {"critical", "warning", "info"}
    assert all(s["sources"] for s in model["sections"])


def test_update_changes_the_sections_of_changed_files(spark, built):
    store, out, before = built
    changes = spark.createDataFrame([("logic/run.go", [8])], "path string, changed_lines array<int>")
    done = generate.update(spark, store, changes, f"file://{out}", hashing_embedder(16))
    assert set(done) <= {s["id"] for s in before["sections"]} and done
    after = models.load_model(spark, f"file://{out}/doc_model.json")
    assert faults(spark, after) == [] and [s["order"] for s in after["sections"]] == list(range(len(after["sections"])))


class Scribe:
    def full_document(self, evidence):
        return ""

    def update_section(self, content, evidence):
        return content + "\n\nRewritten by hand."

    def from_draft(self, draft, evidence):
        return draft

    def new_section(self, evidence):
        return ""

    def insertion_point(self, titles, content):
        return 0


def test_a_writer_is_asked(spark, built):
    store, out, _ = built
    model = generate.generate(spark, store, f"file://{out}", hashing_embedder(16), Scribe())
    assert any(s["content_md"] for s in model["sections"])
    changes = spark.createDataFrame([("logic/run.go", [])], "path string, changed_lines array<int>")
    assert generate.update(spark, store, changes, f"file://{out}", hashing_embedder(16), Scribe(), heuristic=False, semantic=True)


def test_model_from_markdown(spark, tmp_path):
    (tmp_path / "documentation.md").write_text("# Key Features\nbody\n")
    model = generate.load_or_bootstrap(spark, f"file://{tmp_path}")
    assert [s["id"] for s in model["sections"]] == ["overview", "key-features", "development"]
    assert generate.load_or_bootstrap(spark, f"file://{tmp_path}") == model


def test_bad_models_are_not_saved(spark, tmp_path, built):
    model = json.loads(json.dumps(built[2]))
    model["sections"][0]["status"] = "not-a-valid-status"
    with pytest.raises(ValueError, match="status"):
        models.save_model(spark, f"file://{tmp_path}/m.json", model)
    model["sections"][0] |= {"status": "active", "id": "key-features"}
    assert set(faults(spark, model)) == {("$.sections", "repeated:key-features"), ("$.sections", "missing:overview")}
    assert ("$", "required:sections") in faults(spark, {}) and models.load_model(spark, f"file://{tmp_path}/none.json") is None


def test_index_health_is_measured_against_what_an_index_holds(spark, tmp_path):
    """A private symbol that nothing exported reaches is in no index, and is not missing from one."""
    (tmp_path / "a.go").write_text("package a\n\nfunc Run() { near() }\n\nfunc near() {}\n\nfunc alone() {}\n")
    store = Store(spark, f"file://{tmp_path}/store")
    sync.scan(spark, str(tmp_path), store)
    calls = []
    embed = lambda texts: calls.append(len(texts)) or [[1.0]] * len(texts)
    generate.ensure_index(store, embed)
    held = {r.name for r in store.load("chunks").collect()}
    assert held == {"Run", "near", "a.go"}
    symbols, edges = store.load("nodes"), store.load("edges")
    health = vector.index_health(sync.prepared(symbols, edges), store.load("chunks")).first()
    assert (health.coverage, health.freshness, health.missing, health.rebuild) == (1.0, 1.0, 0, False)
    before = store.version()
    generate.ensure_index(store, embed)
    assert store.version() == before
    store.save_chunks(store.load("chunks").limit(1).select(F.lit("gone").alias("id"), *[c for c in store.load("chunks").columns if c != "id"]))
    generate.ensure_index(store, embed)
    assert {r.name for r in store.load("chunks").collect()} == held


def test_update_asks_a_writer_where_chunks_belong(spark, built):
    store, out, _ = built
    asked = []

    class Router(Scribe):
        def insertion_point(self, titles, content):
            asked.append(titles)
            return len(titles) - 1

    chunk = store.load("chunks").filter("name = 'helper'").drop("file_path", "sources").first()
    stray = store.load("chunks").filter(F.col("id") == chunk.id).withColumn("file_path", F.lit("other/stray.go")).withColumn("id", F.lit("stray"))
    store.save_chunks(stray)
    changes = spark.createDataFrame([("other/stray.go", [1])], "path string, changed_lines array<int>")
    done = generate.update(spark, store, changes, f"file://{out}", hashing_embedder(16), Router(), routes=2)
    assert asked and done == [models.load_model(spark, f"file://{out}/doc_model.json")["sections"][-1]["id"]]
    store.delete_chunks(spark.createDataFrame([("stray",)], "target string"))


def test_services_follow_settings(monkeypatch):
    embed, writer = cli.services(config.Config())
    assert len(embed(["a"])[0]) == 64 and writer is None
    embed, writer = cli.services(config.Config(embedder="plain", embed_url="u", embed_model="m", embed_batch=3, writer="chat", writer_url="w", writer_model="n", writer_key="k"))
    assert (embed.url, embed.batch, writer.url, writer.model, writer.key) == ("u", 3, "w", "n", "k")
    with pytest.raises(ValueError, match="unsupported"):
        providers.writer("none of these", url="")


def test_commands_run_from_settings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.go").write_text(GO["logic/run.go"] if "logic/run.go" in GO else "package a\n\nfunc Run() {}\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "src"), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    store, out = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/out"
    settings = config.Config(embed_dimension=8, max_hops=1, min_confidence=0.1, package_first=True)
    cli.run(spark, "sync", settings, str(tmp_path / "src"), store, out)
    assert (tmp_path / "out" / "documentation.md").exists()
    (tmp_path / "src" / "a.go").write_text((tmp_path / "src" / "a.go").read_text() + "\nfunc Added() {}\n")
    cli.run(spark, "sync", settings, str(tmp_path / "src"), store, out)
    assert "Added" in {r.name for r in store.load("nodes").collect()} and "Added" in {r.name for r in store.load("chunks").collect()}


def test_http_writer(monkeypatch):
    seen = []

    def post(url, body, headers, *rest):
        seen.append(body["messages"][1]["content"])
        return {"choices": [{"message": {"content": "1 it is"}}]}

    monkeypatch.setattr(providers, "post", post)
    w = providers.HttpWriter("u", "m", "k")
    assert w.insertion_point(["A", "B"], "text") == 1
    assert w.update_section("old", ["e1", "e2"]) == w.from_draft("d", []) == w.new_section(["x"]) == w.full_document(["x"]) == "1 it is"
    assert "[2]\ne2" in seen[1]


def test_stored_index(spark, built):
    index = StoredIndex(built[0])
    query = [float(x) for x in built[0].load("chunks").filter("name = 'helper'").first().embedding]
    assert index.search(query, 1).first().name == "helper"
    ids = built[0].chunk_ids()
    assert index.hashes(ids).count() == ids.count() == built[0].count_chunks()


def test_providers(monkeypatch):
    asked = []

    def post(url, body, headers, *rest):
        asked.append((url, body, headers))
        n = len(body.get("input") or body["requests"])
        return {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(n))], "embeddings": [[1.0]] * n if "input" in body else [{"values": [2.0]}] * n}

    monkeypatch.setattr(providers, "post", post)
    assert providers.embedder("list", url="u", model="m", key="k", batch=2, pause=0)(["a", "b", "c"]) == [[0.0], [1.0], [0.0]]
    assert len(asked) == 2 and asked[0][2] == {"Authorization": "Bearer k"}
    assert providers.embedder("plain", url="u", model="m")(["a"]) == [[1.0]]
    assert providers.embedder("parts", url="u", model="m", key="k")(["a"]) == [[2.0]]
    assert len(providers.embedder()(["a"])[0]) == 64
    with pytest.raises(ValueError, match="unsupported"):
        providers.embedder("none")
    assert providers.parse_index(" 2. because", 3) == 2 and providers.parse_index("9", 3) == -1 and providers.parse_index("x", 3) == -1
