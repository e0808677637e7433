import os
import random

import pytest

from weftline.sources import files
from weftline.sources import store as stores
from weftline.sources.store import Store


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_crash_leaves_the_snapshot_before(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.save(a=rows(spark, 1), b=rows(spark, 2))
    for name in ("put", "read"):
        with monkeypatch.context() as m:
            m.setattr(files, name, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                store.save(a=rows(spark, 9))
        assert ids(store.load("a")) == [1] and ids(store.load("b")) == [2]


def test_two_writers_lose_no_table(spark, tmp_path, monkeypatch):
    """A pointer that another writer has made in between is taken over."""
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.save(a=rows(spark, 1))
    put, met = files.put, []

    def late(spark_, path, text, replace=True):
        if not met:
            met.append(path)
            two.save(b=rows(spark, 2))
        return put(spark_, path, text, replace)

    monkeypatch.setattr(files, "put", late)
    one.save(c=rows(spark, 3))
    assert [ids(one.load(t)) for t in "abc"] == [[1], [2], [3]]


def test_old_snapshots_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.save(still=rows(spark, 0))
    for i in range(7):
        store.save(a=rows(spark, i))
    names = os.listdir(tmp_path / "s")
    assert ids(store.load("a")) == [6] and ids(store.load("still")) == [0]
    assert sum(n.startswith("a-") for n in names) == stores.KEEP and sum(n.startswith("SNAPSHOT-") for n in names) == stores.KEEP
    assert not [n for n in names if n.endswith(".tmp")]


def test_files_are_put_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a b/x.json"
    assert files.names(spark, f"file://{tmp_path}/a b") == [] and not files.exists(spark, path)
    assert files.put(spark, path, "one\n") and files.read(spark, path) == "one\n"
    assert files.put(spark, path, "two \u00e9") and files.read(spark, path) == "two \u00e9"
    assert not files.put(spark, path, "three", replace=False) and files.read(spark, path) == "two \u00e9"
    assert files.names(spark, f"file://{tmp_path}/a b") == ["x.json"]
    files.delete(spark, path)
    assert not files.exists(spark, path)


NODE = "id string, filepath string, package string, name string, receiver string, unit_type string, start_line int"


def node(i, file=None, name=None):
    return (f"n{i}", file or f"f{i % 40}.go", "p", name or f"Name{i % 60}", "", "function", i)


def parts(store, name):
    return store.version()[name]["parts"]


def test_a_merge_writes_the_buckets_it_hits_and_old_readers_agree(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=32)
    store.save(nodes=spark.createDataFrame([node(i) for i in range(400)], NODE))
    before, old = {t: parts(store, t) for t in ("nodes", "nodes.files", "nodes.names")}, store.load("nodes")
    store.save_node(spark.createDataFrame([node(7, "new.go", "Renamed")], NODE))
    changed = {t: {b for b in set(before[t]) | set(parts(store, t)) if before[t].get(b) != parts(store, t).get(b)} for t in before}
    assert len(changed["nodes"]) == 1 and all(1 <= len(changed[t]) <= 4 for t in ("nodes.files", "nodes.names"))
    assert old.filter("id = 'n7'").first().name == "Name7" and store.node("n7").first().name == "Renamed"
    assert old.count() == store.load("nodes").count() == 400
    for _ in range(stores.KEEP + 1):
        store.save_node(spark.createDataFrame([node(7, "new.go", "Renamed")], NODE))
    named = {f.partition("/")[0] for v in store._pointers() for f in store._folders(store._tables(v))}
    assert {n for n in os.listdir(tmp_path / "s") if not n.startswith("SNAPSHOT")} == named, "what no snapshot names is gone"


def test_lookups_open_a_handful_of_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=32)
    store.save(nodes=spark.createDataFrame([node(i) for i in range(2000)], NODE))
    every = len(store.load("nodes").inputFiles())
    assert every >= 32 and len(store.node("n77").inputFiles()) <= 2 and ids(store.node("n77")) == ["n77"]
    one = Store(spark, f"file://{tmp_path}/t", buckets=32)
    one.save(nodes=spark.createDataFrame([node(i, f"f{i // 3}.go") for i in range(2000)], NODE))
    found = one.nodes_of_file("f5.go")
    assert ids(found) == ["n15", "n16", "n17"] and len(found.inputFiles()) <= 4
    assert ids(one.node("absent")) == ids(one.nodes_of_file("absent")) == []


def test_merges_and_indexes_equal_a_plain_table(spark, tmp_path):
    rng = random.Random(4)
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    held = {f"n{i}": node(i) for i in range(60)}
    store.save(nodes=spark.createDataFrame(list(held.values()), NODE))
    for _ in range(3):
        new = [node(i, f"f{rng.randrange(9)}.go", f"Name{rng.randrange(9)}") for i in rng.sample(range(80), 12)]
        gone = [f"n{i}" for i in rng.sample(range(80), 8)]
        store.merge(nodes=(spark.createDataFrame(new, NODE), spark.createDataFrame([(g,) for g in gone], "id string")))
        held = {k: v for k, v in held.items() if k not in gone} | {n[0]: n for n in new}
        assert sorted(map(tuple, store.load("nodes").collect())) == sorted(held.values())
        for index, of in (("files", lambda r: [r[1]]), ("names", lambda r: [r[3], f"p.{r[3]}"])):
            want = sorted((k, r[0]) for r in held.values() for k in of(r))
            assert sorted(map(tuple, store.load(f"nodes.{index}").collect())) == want
    assert ids(store.find("nodes", "names", spark.createDataFrame([("p.Name3",)], "k string"))) == sorted(k for k, r in held.items() if r[3] == "Name3")


def test_two_writers_of_one_bucket_lose_no_row(spark, tmp_path, monkeypatch):
    one, two = Store(spark, f"file://{tmp_path}/s", buckets=1), Store(spark, f"file://{tmp_path}/s", buckets=1)
    one.save(nodes=spark.createDataFrame([node(1)], NODE))
    put, met = files.put, []

    def late(spark_, path, text, replace=True):
        if not met:
            met.append(path)
            two.save_node(spark.createDataFrame([node(2)], NODE))
        return put(spark_, path, text, replace)

    monkeypatch.setattr(files, "put", late)
    one.save_node(spark.createDataFrame([node(3)], NODE))
    assert ids(one.load("nodes")) == ["n1", "n2", "n3"]
