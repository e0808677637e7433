import os
import subprocess

import pytest
from pyspark.sql import functions as F

from weftline.operators import capability, diagrams, docmodel, report
from weftline.plans import sync
from weftline.operators.vector import hashing_embedder
from weftline.sources import code, config, diff
from weftline.sources.store import Store
from tests.test_chunks import chunks

MD = "intro\n\n# Key Features\nbody one\n## Key Features\n```\n# in a fence\n```\n####### no header\n"


def test_split_and_model(spark):
    docs = spark.createDataFrame([("d", MD), ("empty", ""), ("null", None)], "doc string, content string")
    s = docmodel.split_markdown(docs).orderBy("ord").collect()
    assert [(r.title, r.level) for r in s] == [("Introduction", 0), ("Key Features", 1), ("Key Features", 2), ("in a fence", 1)]
    assert [r.title for r in docmodel.split_markdown(docs, fence_aware=True).orderBy("ord").collect()] == ["Introduction", "Key Features", "Key Features"]
    m = docmodel.build_model(docs)
    got = {(r.doc, r.id): r for r in m.collect()}
    assert ("d", "key-features-2") in got and got["empty", "overview"].hash == "sha256:empty" and got["d", "introduction"].summary == "intro"
    n = docmodel.normalize(m)
    order = [r.id for r in n.filter("doc = 'd'").orderBy("ord").collect()]
    assert order == ["overview", "key-features", "development", "introduction", "key-features-2", "in-a-fence"]
    assert n.filter("doc = 'd' AND id = 'development'").first().content_md == "# Development\n\nTBD."
    assert n.filter("doc = 'd' AND id = 'introduction'").first().content_md == "# Introduction\n\nintro"
    assert docmodel.violations(n).count() == 0
    bad = n.withColumn("status", F.lit("not-a-valid-status"))
    assert {r.problem for r in docmodel.violations(bad).collect()} == {"unknown status"}
    text = docmodel.render(n.filter("doc = 'd'")).first().markdown
    assert text.startswith("# Project Documentation\n\n# Overview") and text.endswith("\n")


def test_chunk_sources(spark):
    given = [{"symbol_id": "s", "file_path": "f", "start_line": 10, "end_line": 42, "relation": "dependency", "confidence": 0.77}]
    c = docmodel.chunk_sources(chunks(spark, [{"id": "1", "sources": given}, {"id": "2", "file_path": ""}]))
    got = {r.id: r.sources for r in c.collect()}
    assert tuple(got["1"][0]) == ("s", "f", 10, 42, "dependency", 0.77)
    assert tuple(got["2"][0]) == ("2", "2", 1, 1, "primary", 0.9)


def test_capabilities_and_drafts(spark):
    names = [("resolveLinks", "resolution"), ("planImpact", "planning"), ("searchVector", "retrieval"), ("renderMarkdown", "generation")]
    source = [{"symbol_id": "s", "file_path": "f", "start_line": 1, "end_line": 2, "relation": "primary", "confidence": 0.9}]
    c = chunks(spark, [{"id": n, "name": n, "package": "p", "description": n, "sources": source} for n, _ in names])
    caps = capability.capabilities(c).orderBy(F.desc("confidence"), "title").collect()
    assert [r.key for r in caps] == ["generation", "planning", "retrieval", "resolution"] and {r.confidence for r in caps} == {0.42}
    assert capability.mean_capability_confidence(capability.capabilities(c)).first()[0] == pytest.approx(0.42)
    md = capability.key_features_markdown(c).first().markdown
    assert "- **Intent**" in md and "- **Behavior**" in md and "```go" in md
    claims = capability.feature_claims(c)
    assert claims.count() == 4 and capability.claim_problems(claims).count() == 0
    draft = capability.draft_claims(c, "overview")
    assert capability.draft_markdown(draft, "overview", "Overview").first().markdown.count("## Architecture Intent") == 1
    assert capability.draft_claims(c, "development").count() == 4


def test_diagrams(spark):
    c = chunks(spark, [{"id": "1", "name": "mainCmd", "package": "cli", "dependencies": ["storeRepo"]}, {"id": "2", "name": "storeRepo", "package": "db"}, {"id": "3", "name": "x", "package": "db"}])
    assert [tuple(r) for r in diagrams.package_edges(c).collect()] == [("cli", "db", 1)]
    assert diagrams.main_package(c).first()[0] == "db" and diagrams.main_package(c.limit(0)).first()[0] == "project"
    assert "cli --> db" in diagrams.architecture_snapshot(c).first()[0]
    assert "entry --> data" in diagrams.architecture_flow(c).first()[0]
    assert "db --> cli" in diagrams.package_flow(c).first()[0]
    put = lambda text: spark.range(1).select(diagrams.with_diagram(F.lit(text), "## D", F.lit("```mermaid\nnew\n```"))).first()[0]
    assert put("") == "## D\n\n```mermaid\nnew\n```"
    assert put("# T\n\n## D\n\n```mermaid\nold\n```\n\nrest") == "# T\n\n## D\n\n```mermaid\nnew\n```\n\nrest"


def test_quality_and_report(spark):
    q = report.writer_quality(spark.createDataFrame([("overview", "- a\n- b\n- c"), ("other", "one\n\ntwo"), ("other", "  ")], "section_id string, content string")).collect()
    assert [r.quality for r in q] == [0.35, 1.0, 0.0] and q[0].issues == "list_heavy,insufficient_paragraphs,missing_overview_diagram"
    signals = spark.createDataFrame([("warning", "b", "x"), ("critical", "z", "y"), ("warning", "a", "w")], "severity string, stage string, code string")
    assert [r.code for r in signals.orderBy(*report.by_signal()).collect()] == ["y", "w", "x"]
    assert {r.severity: r.n for r in report.signal_counts(signals).collect()} == {"critical": 1, "warning": 2, "info": 0}
    sections = spark.createDataFrame([("s", True, 0, 5, 0.5)], "section_id string, low_evidence boolean, search_hits int, heuristic_hits int, quality double")
    assert {r.code for r in report.section_signals(sections).collect()} == {"low_evidence_section", "semantic_hits_zero", "heuristic_dominant", "writer_quality_low"}


def test_diff(spark):
    text = "diff --git a/x y.go b/x y.go\n--- a\n+++ b\n@@ -1 +1,3 @@\n+a\n@@ -9,2 +11,0 @@ f()\n@@ -20 +18 @@\ndiff --git a/old.go b/new.go\nrename"
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text.split("\n"))], "diff string, line_no long, line string")
    assert [(r.path, r.changed_lines) for r in diff.parse(lines).orderBy("path").collect()] == [("new.go", []), ("x y.go", [1, 2, 3, 18])]


GO = {
    "models/order.go": "package models\n\n// Order is sold.\ntype Order struct {\n\tID int\n\tLines []*Line `json:\"lines\"`\n}\n\ntype Line struct{ Sku string }\n",
    "logic/run.go": 'package logic\n\nimport "fmt"\n\nconst apiKey = "abc"\n\n// Process works.\nfunc Process(o models.Order, n int) (models.Order, error) {\n\tfmt.Println(n)\n\tx := helper(o.ID)\n\treturn models.Order{ID: x}, nil\n}\n\nfunc helper(i int) int { return i + 1 }\n',
    "logic/run_test.go": "package logic\n\nfunc TestX() {}\n",
    "vendor/v.go": "package v\n\nfunc V() {}\n",
}


def test_scan_store_update(spark, tmp_path):
    root = tmp_path / "src"
    for name, text in GO.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.load("nodes") is None
    sync.scan(spark, str(root), store)
    nodes = {r.name: r for r in store.load("nodes").collect()}
    assert set(nodes) == {"Order", "Line", "apiKey", "Process", "helper"} and nodes["Process"].filepath == "logic/run.go"
    named = store.load("edges").join(store.load("nodes").select(F.col("id").alias("from_id"), F.col("name").alias("a")), "from_id").join(store.load("nodes").select(F.col("id").alias("to_id"), F.col("name").alias("b")), "to_id")
    assert {(r.a, r.b, r.kind) for r in named.collect()} == {("Process", "Order", "uses_type"), ("Process", "Order", "instantiates"), ("Process", "helper", "calls")}
    assert store.node(nodes["helper"].id).count() == 1 and store.nodes_of_file("logic/run.go").count() == 3
    sync.index(store, hashing_embedder(8))
    before = {r.id: r.content_hash for r in store.load("chunks").collect()}
    assert nodes["Process"].id in before and "models/order.go" in before and store.count_files().first().n == 2
    changed = GO["logic/run.go"].replace("i + 1", "i + 2")
    edit = spark.createDataFrame([("logic/run.go", [14])], "path string, changed_lines array<int>")
    sync.update_graph(store, edit, spark.createDataFrame([("logic/run.go", changed)], "filepath string, content string"))
    assert store.load("edges").count() == 3, "edges of unchanged files stay"
    sync.index(store, hashing_embedder(8))
    after = {r.id: r.content_hash for r in store.load("chunks").collect()}
    assert before.keys() == after.keys() and {k for k in after if after[k] != before[k]} == {nodes["helper"].id, "logic/run.go"}
    sources = spark.createDataFrame([("s", nodes["Process"].id, "logic/run.go", 0.9)], "section_id string, symbol_id string, file_path string, confidence double")
    hit, _ = sync.plan_sections(store, edit, sources)
    assert [r.section_id for r in hit.collect()] == ["s"]
    gone = spark.createDataFrame([("logic/run.go", [])], "path string, changed_lines array<int>")
    sync.update_graph(store, gone, spark.createDataFrame([], "filepath string, content string"))
    assert store.load("nodes").count() == 2 and store.load("edges").count() == 0


def test_snapshot_replaces_nodes_and_edges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    node = "id string, filepath string, start_line int"
    edge = "from_id string, to_id string, kind string"
    store.save_graph(spark.createDataFrame([("A", "f", 1), ("B", "f", 2)], node), spark.createDataFrame([("A", "B", "calls")], edge))
    store.save_graph(spark.createDataFrame([("B", "f", 1), ("B", "g", 0), ("C", "f", 2)], node), spark.createDataFrame([("C", "B", "calls")] * 2, edge))
    assert sorted((r.id, r.filepath) for r in store.load("nodes").collect()) == [("B", "g"), ("C", "f")]
    assert [tuple(r) for r in store.load("edges").collect()] == [("C", "B", "calls")]
    store.save_graph(spark.createDataFrame([], node), spark.createDataFrame([], edge))
    assert store.load("nodes").count() == 0 and store.load("edges").count() == 0


def test_units_of_a_file():
    units = {u["name"]: u for u in code.go_units("logic/run.go", GO["logic/run.go"])}
    assert units["apiKey"]["value"] == '"[REDACTED]"' and '"abc"' in units["apiKey"]["content"]
    p = units["Process"]
    assert p["description"] == "Process works." and p["signature"].endswith("(models.Order, error)")
    assert [(r["target"], r["kind"]) for r in p["relations"]] == [("models.Order", "uses_type"), ("models.Order", "uses_type"), ("helper", "calls"), ("models.Order", "instantiates")]
    assert code.go_units("x.go", "package x\nfunc (") is not None and code.go_units("x.go", "") == []
    with pytest.raises(ValueError, match="unsupported"):
        code.extract(None, "cobol")


def test_git_changes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.go").write_text("one\ntwo\nthree\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a.go").write_text("one\nTWO\nthree\nfour\n")
    assert [(r.path, r.changed_lines) for r in diff.changed_since(spark, str(tmp_path), "HEAD").collect()] == [("a.go", [2, 4])]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("index:\n  max_embed_chunks: 5 # few\n  embedder: x\n")
    (tmp_path / ".env").write_text("WEFTLINE_EMBEDDER=y\n")
    c = config.load(str(tmp_path / "c.yaml"), str(tmp_path / ".env"), {"WEFTLINE_MAX_HOPS": "4", "WEFTLINE_ENABLE_LLM_ROUTING": "yes", "OTHER": "1"})
    assert (c.max_embed_chunks, c.embedder, c.max_hops, c.enable_llm_routing) == (5, "y", 4, True)
    assert config.load("none", "none", {}) == config.Config()
    assert os.path.exists(tmp_path)
