import pytest
from pyspark.sql import functions as F

from weftline.functions.exprs import embeddable_text
from weftline.operators import chunk, order, retrieval, vector

SYMBOL = "id string, filepath string, package string, language string, start_line int, end_line int, content string, content_hash string, unit_type string, role string, name string, description string, signature string, receiver string"
EDGE = "from_id string, to_id string, kind string, resolver string, confidence double"


def symbol(id_, path="a.go", kind="function", name=None, content="x", start=1, package="p", description=""):
    return (id_, path, package, "go", start, start + 5, content, "h" + id_, kind, "", name or id_, description, "", "")


def test_symbol_and_file_chunks(spark):
    s = spark.createDataFrame([symbol("1", "logic.go", name="ProcessOrder", content="func ProcessOrder() {", package="logic"), symbol("2", "models.go", "struct", "Order", "type Order struct {", package="models")], SYMBOL)
    e = spark.createDataFrame([("1", "2", "uses_type", "h", 0.6), ("1", "gone", "calls", "h", 0.6)], EDGE)
    c = {r.id: r for r in chunk.prepare(s, e).withColumn("text", embeddable_text()).collect()}
    assert c["1"].dependencies == ["Order"] and c["2"].used_by == ["ProcessOrder"]
    assert "Symbol: ProcessOrder (function)" in c["1"].text and "Depends on: Order" in c["1"].text
    assert [(x.symbol_id, x.relation, x.confidence) for x in c["1"].sources] == [("1", "primary", 0.9)]
    f = c["models.go"]
    assert f.unit_type == "file_module" and f.description.startswith("Module `models.go` in package `models` containing:\n- **Order** (struct)")
    assert f.signature == "type Order struct {\n\n" and f.content == "// struct Order\ntype Order struct {\n\n"


def test_segments(spark):
    s = spark.createDataFrame([symbol("1", content="\n".join(str(i) for i in range(73)), start=10), symbol("2", content="a\n" * 30)], SYMBOL)
    got = chunk.segments(chunk.symbol_chunks(s, spark.createDataFrame([], EDGE))).orderBy("id").collect()
    assert [(r.id, r.sources[0].start_line, r.sources[0].end_line, r.sources[0].relation) for r in got] == [("1::seg:1", 10, 49, "context"), ("1::seg:2", 42, 81, "context"), ("1::seg:3", 74, 82, "context")]


def chunks(spark, rows):
    schema = "id string, file_path string, name string, unit_type string, package string, description string, signature string, content string, content_hash string, dependencies array<string>, used_by array<string>, sources array<struct<symbol_id:string,file_path:string,start_line:int,end_line:int,relation:string,confidence:double>>"
    base = {"file_path": "f.go", "name": "n", "unit_type": "function", "package": "p", "description": "", "signature": "", "content": "c", "content_hash": "h", "dependencies": [], "used_by": [], "sources": []}
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return spark.createDataFrame([[(base | r)[n] for n in names] for r in rows], schema)


def test_budget_takes_the_quota_then_fills_up(spark):
    c = chunks(spark, [{"id": f"s{i:03}"} for i in range(77)] + [{"id": f"f{i:03}", "unit_type": "file_module"} for i in range(24)])
    assert chunk.budget(c, 1).collect()[0].id == "s000"
    for most in (0, 1, 4, 8, 100, 500):
        n = chunk.budget(c, most).count()
        assert n == (101 if most == 0 else min(101, most))
    phases = {r.phase: r["count"] for r in chunk.budget(c, 100).groupBy("phase").count().collect()}
    assert phases == {0: 98 + 1, 1: 1} or phases == {0: 99, 1: 1}


def test_hash_skip_upsert_delete(spark):
    c = chunks(spark, [{"id": "a", "content_hash": "1"}, {"id": "b", "content_hash": "2"}, {"id": " ", "content_hash": "3"}, {"id": "c", "content_hash": ""}])
    stored = spark.createDataFrame([("a", "1"), ("b", "old"), ("c", "")], "id string, content_hash string")
    assert sorted(r.id for r in chunk.unchanged(c, stored).collect()) == ["b", "c"]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), spark.createDataFrame([("b", 2), ("b", 3)], "id string, v int")
    assert sorted(map(tuple, chunk.upsert(old, new, order="v").collect())) == [("a", 1), ("b", 3)]
    d = chunks(spark, [{"id": "a"}, {"id": "b", "file_path": "g.go"}, {"id": "c", "file_path": "k.go"}])
    assert [r.id for r in chunk.delete(d, spark.createDataFrame([("a",), ("g.go",)], "target string")).collect()] == ["c"]


def test_index_health(spark):
    ids = lambda x: spark.createDataFrame([(c,) for c in x], "id string")
    h = vector.index_health(ids("abcd"), ids("bcde")).first()
    assert (h.coverage, h.freshness, h.stale_ratio, h.rebuild) == (0.75, 0.5, 0.25, True)
    h = vector.index_health(ids(""), ids("")).first()
    assert (h.coverage, h.freshness, h.stale_ratio, h.rebuild) == (1.0, 1.0, 0.0, True)
    assert not vector.index_health(ids("ab"), ids("ab")).first().rebuild


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("d", [0.0, 0.0])], "id string, embedding array<float>")
    assert [r.id for r in vector.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "c"]
    near = spark.createDataFrame([("b", 1)], "id string, depth int")
    assert [(r.id, r.score) for r in vector.hybrid_top_k(v, near, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("c", 1.0), ("b", 0.2)]
    embed = vector.hashing_embedder(16)
    assert embed(["x y"]) == embed(["x  y"]) and len(embed([""])[0]) == 16
    e = vector.embed_column(spark.createDataFrame([("1", "alpha beta"), ("2", "gamma")], "id string, t string"), F.col("t"), embed)
    assert [r.id for r in vector.search_text(e, "gamma", embed, 1).collect()] == ["2"]
    assert [r.id for r in vector.related(e, "gamma", embed, 1, "2").collect()] == ["1"]


def test_diversity_and_evidence(spark):
    rows = [("a1", "a.go"), ("a2", "a.go"), ("a3", "a.go"), ("b1", "b.go"), ("c1", "c.go")]
    c = chunks(spark, [{"id": i, "file_path": f} for i, f in rows]).withColumn("pos", F.substring("id", 2, 1).cast("int") + 10 * F.ascii("file_path"))
    assert [r.id for r in retrieval.diversity_rerank(c, 4, 1).orderBy("rank").collect()] == ["a1", "b1", "c1", "a2"]
    assert retrieval.diversity_rerank(c, 9, 1).count() == 5
    source = lambda x: [{"symbol_id": "s", "file_path": "f", "start_line": 1, "end_line": 1, "relation": "primary", "confidence": x}]
    e = chunks(spark, [{"id": "1", "file_path": "a", "sources": source(0.9)}, {"id": "2", "file_path": "b", "sources": source(0.8)}]).withColumn("section", F.lit("s"))
    s = retrieval.evidence_stats(e, ["section"], F.lit(4), F.lit(2)).first()
    assert (s.coverage, s.confidence, s.low_evidence, s.chunk_count) == (0.5, 1.0, True, 2)


def test_keywords_queries_and_selection(spark):
    c = chunks(spark, [{"id": "1", "content": "the Parser"}, {"id": "2", "unit_type": "constant", "content": "none"}, {"id": "3", "content": "parser config"}])
    assert [(r.id, r.score) for r in retrieval.keyword_top_k(c, ["parser", "config"], 5).collect()] == [("3", 7), ("1", 4)]
    only = c.filter("id = '2'")
    assert [r.id for r in retrieval.keyword_top_k(only, ["zzz"], 5).collect()] == ["2"]
    q = retrieval.section_queries("key-features", "Key", "core capabilities", ["Intent", "Usage"], ["core capabilities"], [("T", "intent")])
    assert len(q) >= 4 and "core capabilities" in q[0]
    assert retrieval.per_query_k(20, 8) == 4 and retrieval.per_query_k(16, 1) == 16
    ranked = c.filter("id = '1'").withColumn("pos", F.lit(1))
    assert sorted(r.id for r in retrieval.select_evidence(c, ranked, "key-features", 4, ["config"]).collect()) == ["1", "3"]


def test_hydration(spark):
    lines = spark.createDataFrame([("f.go", i, f"Step{'ABCDEFG'[i - 1]}") for i in range(1, 8)], "path string, line_no int, text string")
    schema = "claim_id string, src_ord int, text string, confidence double, symbol_id string, file_path string, start_line int, end_line int"
    claims = spark.createDataFrame([("c", 0, "x", 0.4, "sym.stepA", "f.go", 3, 5)], schema)
    b = retrieval.hydrate(claims, lines).first()
    assert b.id == "evidence:sym.stepA:1-7" and "StepB" in b.content
    claims = spark.createDataFrame([(f, 0, t, c, s, "f.go", i, i) for i, (f, t, c, s) in enumerate((("flow-1", "the pipeline then", 0.8, "sym.a"), ("flow-2", "before route when", 0.8, "sym.b"), ("other", "plain", 0.4, "sym.c")), 1)], schema)
    rich = chunks(spark, [{"id": f"c{i}", "dependencies": ["d"] * i} for i in range(10)])
    told = [r.id for r in retrieval.draft_context(rich, retrieval.hydrate(claims, lines)).orderBy("pos").collect()]
    assert told[:2] == ["c9", "c8"] and len(told) == 11 and told[8].startswith("evidence:sym.")
    assert retrieval.file_count(rich).first().n == 1
    got = retrieval.layer_b(retrieval.hydrate(claims, lines), 3).collect()
    assert len(got) == 3 and sum(r.flow for r in got[:2]) == 2


def test_positions_and_sums_need_no_single_task(spark):
    df = spark.range(500).selectExpr("id", "id * 7919 % 503 AS k", "id % 5 AS v").repartition(6)
    got = {r.k: (r.row, r.before) for r in order.summed(df, [F.asc("k")], "t", before=F.col("v")).collect()}
    rows = sorted((i * 7919 % 503, i % 5) for i in range(500))
    assert got == {k: (n, sum(v for _, v in rows[:n])) for n, (k, _) in enumerate(rows)}
    assert order.summed(df.limit(0), [F.asc("k")], "t").count() == 0


def test_queries_and_sections_go_in_blocks(spark, monkeypatch):
    vectors = spark.range(60).selectExpr("cast(id AS string) AS id", "array(cast(sin(id) AS float), cast(cos(id) AS float), 1f) AS embedding")
    queries = vectors.limit(20).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    sections = vectors.limit(9).select(F.concat(F.lit("s"), "id").alias("section_id"), F.col("id").cast("int").alias("ord"), F.col("embedding").alias("vector"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(vector.top_k_each(vectors, queries, 4)), rows(vector.assign(vectors, sections))
    monkeypatch.setattr(vector, "BLOCK", 6)
    assert (rows(vector.top_k_each(vectors, queries, 4)), rows(vector.assign(vectors, sections))) == whole
    assert len(vector.blocks(queries, "query_id")) > 3 and len(whole[0]) == 80
    with pytest.raises(ValueError, match="repeats"):
        vector.blocks(queries.withColumn("query_id", F.lit("one")), "query_id")


def test_code_after_the_cut_is_not_collected(spark):
    symbols = spark.range(30).selectExpr("cast(id AS string) AS id", "'a.go' AS filepath", "int(id) AS start_line", "int(id) AS end_line", "repeat('x', 400) AS content")
    chunks = symbols.selectExpr("id", "filepath AS file_path", "concat('F', id) AS name", "'function' AS unit_type", "'p' AS package", "'' AS description", "'' AS signature", "content", "'h' AS content_hash", "cast(array() AS array<string>) AS dependencies", "cast(array() AS array<string>) AS used_by", "array(1) AS sources")
    want = "".join(f"// function F{i}\n{'x' * 400}\n\n" for i in sorted(range(30)))
    row = chunk.file_chunks(symbols, chunks).first()
    assert row.content == want[:3000] + chunk.CUT_SUFFIX and len(row.sources) == 30
