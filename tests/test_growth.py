"""Rows that joins make and shuffles carry grow with the tables, not with the square of a name's symbols."""

from pyspark.sql import functions as F

from tests.test_graph import RELATION, SYMBOL
from weftline import catalog
from weftline.operators import capability, docmodel, graph, link, retrieval, skew
from weftline.sources.store import Store


def counted(df):
    """(node, rows) of each join and shuffle of a plan that has run."""
    run = df._jdf
    run.collectToPython()

    def walk(p):
        kind, metrics = p.getClass().getSimpleName(), p.metrics()
        for name in ("numOutputRows", "shuffleRecordsWritten"):
            if ("Join" in kind or "Exchange" in kind) and metrics.contains(name):
                yield kind, metrics.apply(name).value()
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        children = p.children()
        for c in [inner] if inner is not None else [children.apply(i) for i in range(children.size())]:
            yield from walk(c)

    return list(walk(run.queryExecution().executedPlan()))


def homonyms(spark, n):
    symbols = spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("Ping").alias("name"), F.lit("p").alias("package"), F.lit("f.go").alias("filepath"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    assert symbols.columns == SYMBOL.replace(",", "").split()[::2]
    rel = spark.range(n).select(F.concat(F.lit("r"), "id").alias("from_id"), F.lit(0).alias("ord"), F.lit("Ping").alias("target"), F.lit("calls").alias("kind"), F.lit("h").alias("resolver"), F.lit(0.5).alias("confidence"))
    return symbols, rel


def test_a_relation_meets_a_names_ends_not_all_its_symbols(spark):
    symbols, rel = homonyms(spark, 300)
    none = spark.createDataFrame([], "from_id string, to_id string, kind string, resolver string, confidence double")
    _, rest = link.resolve_unique(rel.withColumn("reason", F.lit("")), link.name_index(symbols), none)
    assert {(r.reason, r["count"]) for r in rest.groupBy("reason").count().collect()} == {("ambiguous", 300)}
    assert max(n for _, n in counted(rest)) <= 2 * 300


def test_symbols_without_ids_and_one_symbol_behind_two_keys(spark):
    index = spark.createDataFrame([("a", None), ("b", None), ("b", "1"), ("x.c", "2"), ("c", "2"), ("d", "3"), ("x.d", "4")], "key string, id string")
    rel = spark.createDataFrame([(t, 0, t, "calls", "h", 0.5, "") for t in ("a", "b", "x.c", "x.d", "e")], RELATION + ", reason string")
    none = rel.limit(0).select("from_id", F.lit("").alias("to_id"), "kind", "resolver", "confidence")
    new, rest = link.resolve_unique(rel, index, none)
    assert {(r.from_id, r.to_id) for r in new.collect()} == {("b", "1"), ("x.c", "2")}
    assert {(r.target, r.reason) for r in rest.collect()} == {("a", "typecheck_failed"), ("x.d", "ambiguous"), ("e", "typecheck_failed")}


def test_edges_are_not_shuffled_once_relations_have_met_symbols(spark):
    symbols, rel = homonyms(spark, 300)
    edges, _ = link.link(rel, symbols)
    assert edges.count() == 300 * 300
    assert max(n for kind, n in counted(edges) if "Exchange" in kind) <= 2 * 300


def test_edges_that_several_relations_give_are_one(spark):
    symbols = spark.createDataFrame([("1", "Run", "a", "a.go", 1, 2), ("2", "Run", "b", "b.go", 1, 2)], SYMBOL)
    rel = [("f", 0, "Run", "calls", "h", 0.5), ("f", 1, "*Run", "calls", "t", 0.7), ("f", 2, "a.Run", "calls", "u", 0.9), ("f", 3, "a.Run", "uses", "h", 0.4), ("g", 0, "Run", "calls", "h", 0.3)]
    edges, _ = link.link(spark.createDataFrame(rel, RELATION), symbols)
    got = sorted((r.from_id, r.to_id, r.kind, r.resolver, r.confidence) for r in edges.collect())
    assert got == [("f", "1", "calls", "u", 0.9), ("f", "1", "uses", "h", 0.4), ("f", "2", "calls", "t", 0.7), ("g", "1", "calls", "h", 0.3), ("g", "2", "calls", "h", 0.3)]


def test_texts_are_searched_once_for_a_list_of_words(spark):
    chunks = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Flow"), F.col("id") % 7).alias("name"), *(F.lit(x).alias(c) for c, x in (("description", ""), ("signature", ""), ("content", "the entry"), ("unit_type", "other"))))
    rows = [(f"s{i}", 3 + i % 2, [" Flow1", "entry"] if i % 3 else ["entry", "flow1", ""]) for i in range(60)] + [("none", 2, None), ("odd", 2, ["no such"])]
    found = retrieval.keyword_top_k_each(chunks, spark.createDataFrame(rows, "section string, top_k int, words array<string>"), 4)
    got = sorted((r.section, r.pos, r.id) for r in found.collect())
    first = sorted(str(i) for i in range(200) if i % 7 == 1)
    want = [(f"s{i}", n + 1, first[n]) for i in range(60) for n in range(3 + i % 2)] + [(s, n + 1, str(n)) for s, n in (("none", 0), ("odd", 0))] + [(s, 2, "1") for s in ("none", "odd")]
    assert got == sorted(want)


def test_no_join_of_texts_and_sections(spark, monkeypatch):
    lists = []
    monkeypatch.setattr(retrieval, "blocks", lambda df, key: lists.append(df.count()) or [df])
    chunks = spark.createDataFrame([("1", "a", "", "", "", "x")], "id string, name string, description string, signature string, content string, unit_type string")
    sections = spark.createDataFrame([(f"s{i}", 1, ["a"]) for i in range(50)], "section string, top_k int, words array<string>")
    assert retrieval.keyword_top_k_each(chunks, sections, 1).count() == 50 and lists == [1]


def test_no_text_passes_the_windows_of_a_list(spark):
    plan = catalog.QUERIES["diversity_rerank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    between = plan[plan.index("Window") : plan.rindex("Window")]
    assert "_rich#" in between and not any(f"{c}#" in between for c in ("text", "description", "content"))


def test_edges_are_grouped_by_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    for n in (1_000, 3_000):
        edges = spark.range(n).select(F.concat(F.lit("a"), "id").alias("from_id"), F.concat(F.lit("b"), "id").alias("to_id"), F.lit("calls").alias("kind"), F.lit(0.5).alias("confidence"))
        both = graph._both_ways(edges)
        assert both.rdd.getNumPartitions() == 2 * n / 100 and both.count() == 2 * n
    lines = catalog.Views(spark, "/root/testdata/sf0.001")
    assert lines.edges.rdd.getNumPartitions() >= lines.table("lineitem").count() / 100


def test_pairs_of_an_index_are_told_apart_by_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    for n in (1_000, 3_000):
        edges = spark.range(n).select(F.concat(F.lit("a"), "id").alias("from_id"), F.concat(F.lit("b"), F.col("id") % 7).alias("to_id"))
        pairs = Store._pairs("edges", "targets", edges.unionByName(edges), "from_id", whole=True)
        assert pairs.rdd.getNumPartitions() == 2 * n / 100 and pairs.count() == n


def test_documents_are_split_once_for_a_model(spark):
    docs = spark.createDataFrame([("d", "# A\nb\n"), ("empty", ""), ("null", None)], "doc string, content string")
    made = docmodel.build_model(docs)
    splits = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("posexplode(")
    assert splits(made) == 1 and splits(docmodel.normalize(made)) == 0 and splits(docmodel.violations(made)) == 0


def test_rows_of_a_draft_are_cut_before_groups_meet(spark):
    rows = catalog.Views(spark, "/root/testdata/sf0.001").chunks.withColumnRenamed("file_path", "section")
    for section in ("overview", "notes"):
        plan = capability.draft_claims(rows, section, ("section",))._jdf.queryExecution().executedPlan().toString().splitlines()
        cuts = [i for i, line in enumerate(plan) if "WindowGroupLimit" in line and "Partial" in line]
        below = [plan[i : next(j for j in range(i, len(plan)) if "FileScan" in plan[j])] for i in cuts]
        assert cuts and not any("Join" in line or "Exchange" in line for lines in below for line in lines)


def test_the_first_semantic_rows_are_those_of_the_whole_group(spark):
    kinds = ("file_module", "symbol_segment", "function", "struct")
    of = F.array(*map(F.lit, kinds))
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 13).alias("section"), F.format_string("%03d", 397 * F.col("id") % 400).alias("id"), F.lit("n").alias("name"), F.element_at(of, F.when(F.col("id") % 13 < 3, F.col("id") % 2 + 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("unit_type"))
    for by in (("section",), ()):
        told = lambda df: sorted(map(tuple, df.select("section", "id", "unit_type").collect()))
        assert told(retrieval.first_semantic(rows, 5, by)) == told(retrieval.first_by_name(retrieval.semantic_only(rows, by), 5, by))


def test_pairs_of_nodes_are_shuffled_once_for_both_ways(spark):
    rows = [("a", "b", 0.5), ("b", "a", 0.9), ("c", "c", 0.7), ("c", "a", 0.2), (None, "a", 0.3), ("a", None, 0.6)]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, confidence double")
    both = graph._both_ways(edges)
    assert sorted((str(r.u), str(r.v)) for r in both.collect()) == sorted([("a", "b"), ("b", "a"), ("c", "c"), ("c", "a"), ("a", "c"), ("None", "a"), ("a", "None")])
    w = {(r.u, r.v): r.w for r in both.collect()}
    assert w["a", "b"] == w["b", "a"] > w["c", "c"] and w[None, "a"] == w["a", None] > w["a", "c"] == w["c", "a"]
    plan = both._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("explode(") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange")


def test_lines_are_dealt_with_numbers_of_their_ends(spark):
    lines = catalog.Views(spark, "/root/testdata/sf0.001")
    for edges in (lines.edges, lines.doc_edges):
        plan = edges.dropDuplicates(["from_id", "to_id", "kind"])._jdf.queryExecution().executedPlan().toString()
        deals = [i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line]
        assert len(deals) == 1 and not any("AS from_id" in line for line in plan.splitlines()[deals[0] :])
    want = {(f"p{r.l_partkey}", f"s{r.l_suppkey}") for r in lines.table("lineitem").select("l_partkey", "l_suppkey").collect()}
    assert {(r.from_id, r.to_id) for r in lines.edges.collect()} == want


def test_files_of_a_bucket_have_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    edges = spark.range(1_000).select(F.lit("a").alias("from_id"), F.concat(F.lit("b"), "id").alias("to_id"), F.lit("calls").alias("kind"))
    store.save(edges=edges)
    for table in ("edges", "edges.targets"):
        saved = store.load(table)
        rows = [r["count"] for r in saved.groupBy(F.input_file_name()).count().collect()]
        assert max(rows) <= 100 and sum(rows) == 1_000
    assert store.load("edges").exceptAll(edges).count() == 0
    assert store.find("edges", "targets", spark.createDataFrame([("b7",)], "k string")).count() == 1_000  # the rows of from_id a


def test_edges_of_a_name_are_written_by_many_tasks_in_little_space(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(skew, "LEAST_LISTED", 512, raising=False)
    symbols, rel = homonyms(spark, 3_000)
    edges, _ = link.link(rel.filter("ord = 0 AND substr(from_id, 2) < 200"), symbols)
    edges.write.parquet(f"{tmp_path}/edges")
    files = list(tmp_path.glob("edges/*.parquet"))
    written = spark.read.parquet(f"{tmp_path}/edges")
    rows = written.count()
    assert rows == written.distinct().count() == 3_000 * rel.filter("substr(from_id, 2) < 200").count()
    assert len(files) > 1 and sum(f.stat().st_size for f in files) < rows / 2
