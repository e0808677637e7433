import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, link, planning
from weftline.plans.sync import reach_sections

SYMBOL = "id string, name string, package string, filepath string, start_line int, end_line int"
EDGE = "from_id string, to_id string, kind string, resolver string, confidence double"
RELATION = "from_id string, ord int, target string, kind string, resolver string, confidence double"
CHANGE = "path string, changed_lines array<int>"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, k, "heuristic", c) for a, b, k, c in pairs], EDGE)


@pytest.fixture
def symbols(spark):
    return spark.createDataFrame([("A", "FuncA", "pkg1", "a.go", 10, 40), ("B", "FuncB", "pkg1", "b.go", 1, 9), ("C", "TypeC", "pkg2", "c.go", 1, 9)], SYMBOL)


def test_names_resolve_by_bare_and_qualified_name(spark, symbols):
    rel = spark.createDataFrame([("A", 0, "FuncB", "calls", "heuristic", 0.7), ("A", 1, "pkg2.TypeC", "uses_type", "heuristic", 0.65), ("A", 2, "Missing", "calls", "heuristic", 0.7)], RELATION)
    found, missing = link.link(rel, symbols)
    assert rows(found, "from_id", "to_id", "kind") == [("A", "B", "calls"), ("A", "C", "uses_type")]
    assert rows(missing, "target", "reason") == [("Missing", "no_candidate")]
    assert rows(link.reason_counts(missing), "reason", "n") == [("no_candidate", 1)]
    assert rows(graph.neighbors_in(found, symbols), "id", "neighbor") == [("B", "A"), ("C", "A")]


def test_targets_lose_one_star_then_one_slice(spark):
    s = spark.createDataFrame([("n", "Node", "graph", "g.go", 1, 2)], SYMBOL)
    targets = ["*Node", "[]Node", "graph.Node", "[]*graph.Node", "g.Node", "[]*Node", "map[string]Node"]
    found, missing = link.link(spark.createDataFrame([(t, 0, t, "calls", "heuristic", 0.7) for t in targets], RELATION), s)
    assert {r[0] for r in rows(found, "from_id")} == set(targets[:5])
    assert {r[0] for r in rows(missing, "target")} == set(targets[5:])


def test_homonyms_all_get_edges_unless_own_package_wins(spark):
    s = spark.createDataFrame([("1", "Run", "a", "a.go", 1, 2), ("2", "Run", "b", "b.go", 1, 2), ("3", "Main", "a", "m.go", 1, 2)], SYMBOL)
    rel = spark.createDataFrame([("3", 0, "Run", "calls", "heuristic", 0.7)], RELATION)
    assert rows(link.link(rel, s)[0], "to_id") == [("1",), ("2",)]
    assert rows(link.link_within_package(rel, s), "to_id") == [("1",)]


def test_unique_keys_resolve_and_others_stay(spark, symbols):
    s = symbols.unionByName(spark.createDataFrame([("B2", "FuncB", "pkg9", "z.go", 1, 2)], SYMBOL))
    left = spark.createDataFrame([("A", 0, "TypeC", "calls", "heuristic", 0.7, ""), ("A", 1, "FuncB", "calls", "heuristic", 0.7, ""), ("A", 2, "Nope", "calls", "heuristic", 0.7, "")], RELATION + ", reason string")
    new, rest = link.resolve_unique(left, link.name_index(s), edges(spark))
    assert rows(new, "from_id", "to_id", "resolver", "confidence") == [("A", "C", "types", 0.9)]
    assert rows(rest, "target", "reason") == [("FuncB", "ambiguous"), ("Nope", "typecheck_failed")]


def test_resolver_chain_counts_what_each_stage_resolves(spark):
    left = spark.createDataFrame([("a", 0, "x", "calls", "h", 0.5), ("a", 1, "y", "calls", "h", 0.5)], RELATION).withColumn("reason", F.lit(""))
    take = lambda t: lambda e, u: (u.filter(F.col("target") == t).select("from_id", F.col("target").alias("to_id"), "kind", "resolver", "confidence"), u.filter(F.col("target") != t))
    found, rest, stages = link.run_chain(edges(spark), left, [("r1", take("x")), ("r2", take("y"))])
    assert rows(stages, "stage", "name", "before_n", "after_n") == [(0, "r1", 2, 1), (1, "r2", 1, 0)]
    assert found.count() == 2 and rest.count() == 0


def changes(spark, *pairs):
    return spark.createDataFrame(list(pairs), CHANGE)


def test_expand_hops_scores_and_filters(spark, symbols):
    e = edges(spark, ("A", "B", "calls", 0.9), ("B", "C", "calls", 0.9))
    start = graph.seeds(symbols, changes(spark, ("a.go", [20])))
    assert rows(start, "id") == [("A",)]
    nodes, inner = graph.expand(e, start, 1)
    assert rows(nodes, "id", "depth", "score") == [("A", 0, 1.0), ("B", 1, 0.9)]
    assert rows(inner, "from_id", "to_id") == [("A", "B")]
    nodes, _ = graph.expand(e, start, 2)
    assert [(a, round(b, 6)) for a, b in rows(nodes, "id", "score")] == [("A", 1.0), ("B", 0.9), ("C", 0.81)]
    nodes, inner = graph.expand(edges(spark, ("A", "B", "calls", 0.3)), start, 2, least=0.7)
    assert rows(nodes, "id") == [("A",)] and inner.count() == 0
    nodes, inner = graph.expand(edges(spark, ("A", "B", "calls", 0.9), ("A", "C", "uses_type", 0.9)), start, 1, kinds=("uses_type",))
    assert rows(nodes, "id") == [("A",), ("C",)] and inner.count() == 1
    nodes, _ = graph.expand(edges(spark, ("A", "B", "calls", 0.0)), start, 1)
    assert rows(nodes, "id", "score") == [("A", 1.0), ("B", 0.5)]


def test_expand_beyond_a_staged_round(spark):
    e = edges(spark, *((str(i), str(i + 1), "calls", 0.9) for i in range(6)))
    nodes, _ = graph.expand(e, spark.createDataFrame([("0",)], "id string"), 5)
    assert [(i, d) for i, d in rows(nodes, "id", "depth")] == [(str(i), i) for i in range(6)]


def test_no_lines_seed_a_file_but_have_no_impact(spark, symbols):
    c = changes(spark, ("a.go", []), ("b.go", [9]))
    assert rows(graph.seeds(symbols, c), "id") == [("A",), ("B",)]
    e = edges(spark, ("C", "B", "calls", 0.9), ("B", "A", "calls", 0.9))
    assert rows(graph.impact(symbols, e, c), "id", "level") == [("B", "direct"), ("C", "indirect")]


def test_doc_relevant_within_two_steps_of_an_exported_symbol(spark):
    s = spark.createDataFrame([(c, n, "p", "f.go", 1, 2) for c, n in (("1", "Open"), ("2", "b"), ("3", "c"), ("4", "d"))], SYMBOL)
    assert rows(graph.doc_relevant(s, edges(spark, ("1", "2", "calls", 0.1), ("3", "2", "calls", 0.1), ("3", "4", "calls", 0.1))), "id") == [("1",), ("2",), ("3",)]


SOURCE = "section_id string, symbol_id string, file_path string, confidence double"
NODE = "id string, score double"


def test_section_impact(spark):
    src = spark.createDataFrame([("overview", "A", "a.go", None), ("dev", "A", "a.go", None), ("dev", "B", "b.go", None)], SOURCE)
    nodes = spark.createDataFrame([("A", 0.9), ("B", 0.7), ("C", 0.4)], NODE)
    hit = planning.section_impact(src, nodes, spark.createDataFrame([("a.go",)], "path string")).orderBy(*planning.by_impact())
    got = [(r.section_id, r.score, round(r.confidence, 4)) for r in hit.collect()]
    assert got == [("dev", 2.67, 0.6333), ("overview", 1.53, 0.6)]
    assert rows(planning.unmatched_symbols(nodes, src), "id") == [("C",)]
    src = spark.createDataFrame([("high", "H", "h.go", 0.95), ("low", "L", "l.go", 0.4)], SOURCE)
    hit = planning.section_impact(src, spark.createDataFrame([("H", 0.9), ("L", 0.4)], NODE), spark.createDataFrame([("h.go",), ("l.go",)], "path string")).orderBy(*planning.by_impact())
    assert [(r.section_id, r.score, r.confidence) for r in hit.collect()] == [("high", 1.535, 0.6125), ("low", 1.43, 0.35)]


def test_reach_sections_end_to_end(spark, symbols):
    src = spark.createDataFrame([("s", "B", "b.go", 0.5)], SOURCE)
    hit, rest = reach_sections(symbols, edges(spark, ("A", "B", "calls", 0.9)), changes(spark, ("a.go", [20])), src)
    assert rows(hit, "section_id") == [("s",)] and rows(rest, "id") == [("A",)]


def test_routing(spark):
    c = spark.createDataFrame([(i, f, "n", "p", "") for i, f in (("A", "x"), ("B", "y"), ("C", "z"))], "id string, file_path string, name string, package string, description string")
    dealt = planning.route_round_robin(c, ("overview", "development"))
    assert rows(dealt, "id", "section_id") == [("A", "overview"), ("B", "development"), ("C", "overview")]
    assert planning.route_round_robin(c, ()).count() == 0
    files = spark.createDataFrame([("s1", "x"), ("s2", "x")], "section_id string, file_path string")
    cascade = planning.route_cascade(c, files)
    assert rows(cascade, "id", "section_id", "stage") == [("A", "s1", "file"), ("A", "s2", "file"), ("B", "key-features", "heuristic"), ("C", "key-features", "heuristic")]
    chosen = planning.route_cascade(c, files, heuristic=False, chosen=lambda rest: planning.route_by_choice(rest, ["s1", "s9"], lambda toc, text: 1, 1))
    assert rows(chosen, "id", "section_id", "stage")[2:] == [("B", "s9", "choice"), ("C", "updates", "new")]
    new = planning.route_cascade(c, files, heuristic=False, most_new=1)
    assert rows(new.filter("stage = 'new'"), "id") == [("B",)]
    order = planning.section_order(spark.createDataFrame([("overview", 1), ("key-features", 5), ("development", 1)], "section_id string, n int"), ("development", "overview"))
    assert [r.section_id for r in order.orderBy("pos").collect()] == ["development", "overview", "key-features"]


def test_files_and_deleted_files(spark, symbols):
    assert rows(graph.files(symbols), "path") == [("a.go",), ("b.go",), ("c.go",)]
    assert rows(graph.deleted_files(symbols, spark.createDataFrame([("a.go",)], "path string")), "path") == [("b.go",), ("c.go",)]
