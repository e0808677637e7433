import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import link, typed
from weftline.plans import sync
from weftline.sources import code
from weftline.sources.store import Store

FILES = {
    "x/a/a.go": """package a

import (
	"fmt"
	other "mod/b/v2" // not this one: "mod/z"
)

type Base struct{ N int }

func (b *Base) Ping() *Leaf { return nil }

type Leaf struct{}

func (l Leaf) Drop() {}

type Mid struct {
	*Base
	Name string
}
type Top struct {
	Mid
	Next *other.Far
}
type Twin struct{}

func (t Twin) Ping() {}

type Two struct {
	Base
	Twin
}

func (t *Two) Own() {}

func NewTop() (*Top, error) { return &Top{}, nil }

var shared = NewTop()
var plain other.Far

func Use(x *Top, two Two, f func()) {
	x.Ping()
	x.Mid.Base.Ping()
	v := other.NewFar(1)
	v.Go()
	w, err := NewTop()
	w.Next.Go()
	two.Ping()
	two.Own()
	f()
	shared.Ping()
	plain.Go()
	y := other.Far{}
	z := w.Ping()
	z.Drop()
	fmt.Sprint(y)
	nothing.Here()
}
""",
    "x/b/b.go": """package b

type Far struct{}

func NewFar(n int) *Far { return nil }

func (f *Far) Go() {}

type Face interface {
	Ping() *Far
	Other
}
type Other interface{ Rest() }

func Call(q Face, r int) {
	q.Ping()
	r := q.Ping()
	s := q.Ping()
	s.Go()
	r.Go()
	q.Rest()
}
""",
}
#: Targets in order, and what each refers to.
WANT = {
    "Use": {
        "x.Ping": "a.Base.Ping", "x.Mid.Base.Ping": "a.Base.Ping", "other.NewFar": "b.NewFar", "v.Go": "b.Far.Go", "NewTop": "a.NewTop", "w.Next.Go": "b.Far.Go", "two.Own": "a.Two.Own",
        "shared.Ping": "a.Base.Ping", "plain.Go": "b.Far.Go", "other.Far": "b.Far", "w.Ping": "a.Base.Ping", "z.Drop": "a.Leaf.Drop",
    },
    "NewTop": {"Top": "a.Top"},
    "Call": {"q.Ping": "b.Face.Ping", "s.Go": "b.Far.Go", "q.Rest": "b.Other.Rest"},
}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(list(FILES.items()), "filepath string, content string")
    units = code.extract(files).withColumn("id", code.unit_id()).cache()
    return files, units, code.symbols(units), code.relations(units)


def test_imports(spark, tree):
    got = sorted(map(tuple, typed.imports(tree[0]).collect()))
    assert got == [("x/a/a.go", "fmt", "fmt"), ("x/a/a.go", "other", "mod/b/v2")]
    odd = 'package p\nimport "a/b"\n/* import "no" */\nimport q "c"; import . "d/v3"\nimport (\n\t_ "e/f"; z "g"\n)\n'
    got = sorted(tuple(r)[1:] for r in typed.imports(spark.createDataFrame([("f", odd)], "filepath string, content string")).collect())
    assert got == [(".", "d/v3"), ("_", "e/f"), ("b", "a/b"), ("q", "c"), ("z", "g")]


def test_references_follow_declared_types(spark, tree):
    """Promoted, imported, chained, returned and package-level ones; two of one depth (two.Ping), a variable of two types (r) and unknown names have none."""
    files, units, symbols, relations = tree
    refs = typed.references(units, typed.imports(files), relations)
    named = refs.join(relations, ["from_id", "ord"]).join(symbols.select(F.col("id").alias("from_id"), "name"), "from_id")
    got = {}
    for r in named.collect():
        assert got.setdefault(r.name, {}).setdefault(r.target, r.key) == r.key
    assert got == WANT


def test_types_tell_homonyms_apart(spark, tree):
    files, units, symbols, relations = tree
    refs = typed.references(units, typed.imports(files), relations)
    edges, _ = link.link_typed(relations, symbols, refs)
    at = symbols.select("id", F.concat_ws(".", "package", F.nullif(typed.receiver_type(F.col("receiver")), F.lit("")), "name").alias("n"))
    named = edges.join(at.select(F.col("id").alias("from_id"), F.col("n").alias("a")), "from_id").join(at.select(F.col("id").alias("to_id"), F.col("n").alias("b")), "to_id")
    pairs = {(r.a, r.b): r.resolver for r in named.filter("kind = 'calls'").collect()}
    assert pairs["a.Use", "a.Base.Ping"] == "types" and pairs["a.Use", "b.Far.Go"] == "types"
    # two.Ping is ambiguous, so names decide and both homonyms get an edge.
    assert pairs["a.Use", "a.Twin.Ping"] == "heuristic"
    plain, _ = link.link(relations, symbols)
    assert plain.filter("resolver = 'types'").count() == 0


def test_embedding_that_goes_round_ends(spark):
    own = spark.createDataFrame([("p.A", "M", "p.A.M", None), ("p.B", "N", "p.B.N", None), ("p.C", "N", "p.C.N", None)], "type string, member string, key string, result string")
    embeds = spark.createDataFrame([("p.A", "p.B"), ("p.B", "p.A"), ("p.D", "p.B"), ("p.D", "p.C"), ("p.E", "p.D")], "outer string, inner string")
    got = {(r.type, r.member): r.key for r in typed.members(own, embeds).collect()}
    want = {("p.A", "M"): "p.A.M", ("p.A", "N"): "p.B.N", ("p.B", "N"): "p.B.N", ("p.B", "M"): "p.A.M", ("p.C", "N"): "p.C.N"}
    assert got == want | {("p.D", "N"): None, ("p.D", "M"): "p.A.M", ("p.E", "N"): None, ("p.E", "M"): "p.A.M"}
    assert typed.members(own.limit(0), embeds).count() == 0


def test_evidence_lines_lead_to_nodes(spark):
    """A relation without a node of its own target has all nodes of its kind on its lines, also over buckets."""
    nodes = spark.createDataFrame([("f", "a.go", "calls", "x.A", 60), ("f", "a.go", "calls", "x.B", 70), ("f", "a.go", "instantiates", "C", 65), ("f", "b.go", "calls", "x.D", 65)], "id string, filepath string, kind string, target string, line int")
    schema = "from_id string, ord int, kind string, target string, evidence struct<filepath:string,start_line:int,end_line:int>"
    rel = spark.createDataFrame([("f", 0, "calls", "x.A", ("a.go", 60, 200)), ("g", 1, "calls", "z", ("a.go", 1, 128)), ("g", 2, "calls", "z", ("a.go", 61, 69)), ("g", 3, "calls", "z", ("a.go", 0, 0))], schema)
    assert sorted(map(tuple, typed.near(rel, nodes).collect())) == [("f", 0, "f", "x.A"), ("g", 1, "f", "x.A"), ("g", 1, "f", "x.B")]


def source(rng, n):
    """A file with homonyms, embedded types, methods and calls of other files' names."""
    k = lambda: rng.randrange(5)
    return (
        f"package p{n % 2}\n\ntype T{n} struct {{\n\tT{k()}\n\tV *T{k()}\n}}\n\nfunc (t *T{n}) Run{k()}() {{\n\tt.Run{k()}()\n\tt.V.Run{k()}()\n}}\n\n"
        f"func Make{n}() *T{k()} {{\n\treturn &T{k()}{{}}\n}}\n\nfunc Use{k()}(u{n} int) {{\n\ta := Make{k()}()\n\ta.Run{k()}()\n\tShared()\n}}\n" + (f"\nfunc Shared(s{n} int) {{\n\town{n}()\n}}\n" if rng.random() < 0.5 else "")
    )


@pytest.mark.parametrize("types", [False, True])
def test_an_update_equals_a_full_scan(spark, tmp_path, types):
    """Files changed, added and deleted: the graph is that of a scan of the new tree, and the relations that are linked anew are few."""
    rng = random.Random(21)
    root, (store, fresh) = tmp_path / "t", (Store(spark, f"file://{tmp_path}/{x}", buckets=4) for x in ("s", "full"))
    root.mkdir()
    for n in range(8):
        (root / f"f{n}.go").write_text(source(rng, n))
    sync.scan(spark, str(root), store, types=types)
    (root / "f1.go").write_text(source(rng, 1))
    (root / "f8.go").write_text(source(rng, 8))
    (root / "f5.go").unlink()
    changes = spark.createDataFrame([(f"f{n}.go", []) for n in (1, 5, 8)], "path string, changed_lines array<int>")
    present = spark.createDataFrame([(f"f{n}.go", (root / f"f{n}.go").read_text()) for n in (1, 8)], "filepath string, content string")
    sync.update_graph(store, changes, present)
    sync.scan(spark, str(root), fresh, types=types)
    for table, columns in (("nodes", ["id", "filepath", "name"]), ("relations", ["from_id", "ord", "target"]), ("edges", ["from_id", "to_id", "kind"]), ("nodes.names", ["k", "id"]), ("relations.names", ["k", "id"]), ("edges.targets", ["k", "id"])):
        got, want = (sorted(map(tuple, s.load(table).select(*columns).collect())) for s in (store, fresh))
        assert got == want, table


def test_an_update_reads_the_relations_it_concerns(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "t", Store(spark, f"file://{tmp_path}/s", buckets=16)
    root.mkdir()
    for n in range(40):
        (root / f"f{n}.go").write_text(f"package p\n\nfunc Use{n}() {{\n\tHelp{n}()\n}}\n\nfunc Help{n}() {{}}\n")
    sync.scan(spark, str(root), store)
    before, seen = store.version(), []
    linked = link.link
    monkeypatch.setattr(link, "link", lambda r, s: seen.append((r.count(), s.count())) or linked(r, s))
    sync.update_graph(store, spark.createDataFrame([("f3.go", [])], "path string, changed_lines array<int>"), spark.createDataFrame([("f3.go", "package p\n\nfunc Use3() {\n\tHelp4()\n}\n")], "filepath string, content string"))
    assert seen == [(1, 2)], "one relation is linked, against its own symbol and the one that it names"
    after = store.version()
    for table, most in (("nodes", 3), ("relations", 2), ("edges", 2)):
        assert 1 <= sum(before[table]["parts"].get(b) != after[table]["parts"].get(b) for b in {*before[table]["parts"], *after[table]["parts"]}) <= most


@pytest.mark.parametrize(
    ("text", "kept", "fault"),
    [
        ("package p\nvar c = 1\n", ["c"], None), ("", [], None), (None, [], None), ("package p\nvar c = 1\nfunc", ["c"], "a declaration breaks off"), ("package p\nfunc A() {\n}\nfunc (t", ["A"], "a declaration breaks off"),
        ("package p\nfunc A() {\n", ["A"], "brackets do not match"), ("package p\nvar s = \"(\"\n", ["s"], None), ("package p\ntype", [], None),
    ],
)
def test_broken_files_are_told_and_kept_as_far_as_they_go(text, kept, fault):
    units = code.go_units("f.go", text)
    assert [u["name"] for u in units if u["unit_type"] != "error" and u["name"] in "cAs"] == kept
    assert [u["description"] for u in units if u["unit_type"] == "error"] == ([fault] if fault else [])


def test_errors_are_rows(spark):
    files = spark.createDataFrame([("a.go", "package p\nvar c = 1\n"), ("b.go", "package p\nvar d = 1\nfunc")], "filepath string, content string")
    assert [tuple(r) for r in code.errors(files).collect()] == [("b.go", 2, 3, "a declaration breaks off")]
    assert sorted(r.name for r in code.extract(files).collect()) == ["c", "d"]


def test_an_index_that_broke_off_asks_for_the_rest(spark, tmp_path):
    """Each part is stored when it is whole, so texts that were embedded before the fault are not asked for again."""
    root, store, log = tmp_path / "t", Store(spark, f"file://{tmp_path}/s", buckets=4), tmp_path / "asked"
    root.mkdir()
    for n in range(6):
        (root / f"f{n}.go").write_text(f"package p\n\nfunc Use{n}(a{n} int) {{\n}}\n\nfunc Help{n}(b{n} int) {{\n}}\n")
    sync.scan(spark, str(root), store)

    def embedder(most):
        def embed(texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            if log.stat().st_size > most:
                raise OSError("the service is gone")
            return [[1.0, 0.0]] * len(texts)

        return embed

    with pytest.raises(Exception, match="the service is gone"):
        sync.index(store, embedder(9), commit=3)
    kept = {r.id for r in store.load("chunks").collect()}
    assert 0 < len(kept) <= 9
    log.write_text("")
    sync.index(store, embedder(1000), commit=3)
    held = store.load("chunks")
    assert held.count() == 18 and held.filter("embedding IS NULL").count() == 0
    assert log.stat().st_size == 18 - len(kept)


def test_single_texts_are_embedded_once():
    from weftline.operators.vector import CachedEmbedder

    asked = []
    embed = CachedEmbedder(lambda texts: asked.extend(texts) or [[float(len(t))] for t in texts])
    assert embed(["ab"]) == embed(["ab"]) == [[2.0]] and embed(["ab", "c"]) == [[2.0], [1.0]]
    assert asked == ["ab", "ab", "c"]
