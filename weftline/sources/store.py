"""Stored tables: versioned Parquet folders with numbered pointers, and JSON and Markdown files.

A save writes new folders and then the next pointer, a file that no other writer has made;
if one has, its tables are taken over and the number after it is tried. The newest pointer
is the store, so a crash leaves the snapshot before and a reader sees one whole snapshot.
Pointers older than the last KEEP go, with the folders that only they name.

Tables of ``KEYS`` are kept in buckets, folders of rows by a hash of their key; the pointer names the folder
of each. ``merge`` reads and rewrites the buckets that its keys fall in, and points at these beside the old
ones; if another writer has changed one of them meanwhile, it starts again from that writer's snapshot. ``lookup`` opens the
buckets of its keys only. Indexes (``INDEXES``) are tables (k, id) in buckets by k that say which keys have rows
with a value, such as a file's symbols; saves and merges keep them, and ``find`` goes through one. Buckets are sorted by file and key,
with Bloom filters on both, so a lookup skips row groups. Rows are written through Spark's rebalancing, which splits
a bucket that many rows fall in, as a name that a third of all relations use. A file has at most TASK_ROWS rows: Spark counts
4 MB for opening one, so a task's files have bounded rows, however well these compress.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import skew
from weftline.operators.chunk import delete, snapshot
from weftline.operators.link import candidate_keys
from weftline.operators.typed import receiver_type
from weftline.operators.vector import top_k
from weftline.sources import files
from weftline.staging import drop, stage

#: Snapshots that stay, so that readers of one can finish while others are saved.
KEEP = 4
#: Tables in buckets, and the key of each.
KEYS = {"nodes": "id", "chunks": "id", "edges": "from_id", "relations": "from_id", "units": "filepath", "imports": "filepath", "typed_refs": "from_id"}
#: Buckets of a table that is saved whole; for large stores, as many as give buckets of some hundred thousand rows.
BUCKETS = 16
_BUCKET = "_bucket"


def _symbol_names() -> Column:
    """What a symbol is found by: its name, package.name and, for a method, package.receiver.name."""
    of = receiver_type(F.col("receiver"))
    method = F.when((F.col("unit_type") == "method") & (of != ""), F.concat_ws(".", "package", of, "name"))
    return F.array("name", F.concat_ws(".", "package", "name"), method)


#: For tables the indexes: columns that it needs, and the array of values that a row is found by.
INDEXES: dict[str, dict[str, tuple[tuple[str, ...], Callable[[], Column]]]] = {
    "nodes": {
        "files": (("filepath",), lambda: F.array("filepath")),
        "names": (("name", "package", "receiver", "unit_type"), _symbol_names),
    },
    "chunks": {"files": (("file_path",), lambda: F.array("file_path"))},
    "edges": {"targets": (("to_id",), lambda: F.array("to_id"))},
    "relations": {"names": (("target",), lambda: F.array(*candidate_keys(F.col("target"))))},
}


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # Pointers. A table is a folder's name, or a dict of key, n, schema and parts: the folder of each bucket.

    def _pointers(self) -> list[int]:
        found = (n.removeprefix("SNAPSHOT-") for n in files.names(self.spark, self.root) if n.startswith("SNAPSHOT-"))
        return sorted(int(n) for n in found if n.isdigit())

    def _tables(self, number: int) -> dict:
        return json.loads(files.read(self.spark, f"{self.root}/SNAPSHOT-{number}"))

    def version(self) -> dict:
        """The tables of the newest snapshot; empty before the first."""
        found = self._pointers()
        return self._tables(found[-1]) if found else {}

    def _point(self, new: dict, patches: dict[str, tuple[dict, dict[str, str | None]]] | None = None) -> bool:
        """Makes the next pointer. patches: for tables the state that was read and the new folders of buckets; False if another writer has changed what they replace."""
        while True:
            last = max(self._pointers(), default=0)
            tables = (self._tables(last) if last else {}) | new
            for name, (base, parts) in (patches or {}).items():
                there = tables.get(name)
                if not isinstance(there, dict) or there["n"] != base["n"] or any(there["parts"].get(b) != base["parts"].get(b) for b in parts):
                    return False
                both = there["parts"] | parts
                tables[name] = there | {"parts": {b: f for b, f in both.items() if f}}
            if files.put(self.spark, f"{self.root}/SNAPSHOT-{last + 1}", json.dumps(tables), replace=False):
                return True

    @staticmethod
    def _folders(tables: dict) -> set[str]:
        return {f for t in tables.values() for f in (t["parts"].values() if isinstance(t, dict) else [t])}

    def _forget(self) -> None:
        found = self._pointers()
        kept = {folder for n in found[-KEEP:] for folder in self._folders(self._tables(n))}
        for n in found[:-KEEP]:
            for folder in self._folders(self._tables(n)) - kept:
                files.delete(self.spark, f"{self.root}/{folder}")
                whole = folder.partition("/")[0]
                if whole != folder and not any(k.startswith(f"{whole}/") for k in kept):
                    files.delete(self.spark, f"{self.root}/{whole}")
            files.delete(self.spark, f"{self.root}/SNAPSHOT-{n}")

    # Buckets

    def _write(self, name: str, df: DataFrame, key: str, n: int) -> dict[str, str]:
        """Writes rows in new folders and returns those of the buckets that have any."""
        folder = f"{name}-{uuid.uuid4().hex}"
        order = [c for c in (_BUCKET, "filepath", "file_path", key) if c == _BUCKET or c in df.columns]
        rows = df.withColumn(_BUCKET, bucket_of(F.col(key), n)).hint("rebalance", _BUCKET).sortWithinPartitions(*order)
        writer = rows.write.partitionBy(_BUCKET).option("maxRecordsPerFile", skew.TASK_ROWS)
        for c in order[1:]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{folder}")
        found = (x for x in files.names(self.spark, f"{self.root}/{folder}") if x.startswith(f"{_BUCKET}="))
        return {x.partition("=")[2]: f"{folder}/{x}" for x in found}

    def _save_buckets(self, name: str, df: DataFrame, key: str) -> dict:
        return {"key": key, "n": self.buckets, "schema": df.schema.jsonValue(), "parts": self._write(name, df, key, self.buckets)}

    def _read(self, table: dict | str, buckets: list[str] | None = None) -> DataFrame:
        if isinstance(table, str):
            return self.spark.read.parquet(f"{self.root}/{table}")
        schema = T.StructType.fromJson(table["schema"])
        wanted = table["parts"] if buckets is None else {b: table["parts"][b] for b in buckets if b in table["parts"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in wanted.values()))

    @staticmethod
    def _hit(keys: DataFrame, n: int) -> list[str]:
        """The buckets of keys (one column): numbers below n, so few for the driver."""
        return [str(r[0]) for r in keys.select(bucket_of(F.col(keys.columns[0]), n)).distinct().collect()]

    @staticmethod
    def _pairs(name: str, index: str, df: DataFrame, key: str, whole: bool = False) -> DataFrame | None:
        """(k, id) of an index over rows, or None where these lack a column. whole: rows are a whole table, whose pairs are counted and dealt to tasks of bounded rows."""
        needs, values = INDEXES[name][index]
        if not set(needs) <= set(df.columns):
            return None
        pairs = df.select(F.explode(values()).alias("k"), F.col(key).alias("id")).filter("k IS NOT NULL AND k <> ''")
        return (skew.spread(pairs, pairs.count(), "k", "id") if whole else pairs).distinct()

    # Tables

    def save(self, **tables: DataFrame) -> None:
        """Replaces the named tables together, and their indexes."""
        new = {}
        for name, df in tables.items():
            key = KEYS.get(name)
            if key is None or key not in df.columns:
                new[name] = f"{name}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/{new[name]}")
                continue
            new[name] = self._save_buckets(name, df, key)
            rows = self._read(new[name])
            for index in INDEXES.get(name, {}):
                if (pairs := self._pairs(name, index, rows, key, whole=True)) is not None:
                    new[f"{name}.{index}"] = self._save_buckets(f"{name}.{index}", pairs, "k")
        self._point(new)
        self._forget()

    def load(self, name: str) -> DataFrame | None:
        """A table, or None if no snapshot has it."""
        table = self.version().get(name)
        return None if table is None else self._read(table)

    def columns(self, name: str) -> list[str]:
        return T.StructType.fromJson(self.version()[name]["schema"]).names

    def lookup(self, name: str, keys: DataFrame, version: dict | None = None) -> DataFrame:
        """Rows whose key is in keys (one column); only the buckets of these are opened."""
        table = (version or self.version())[name]
        column = table["key"]
        found = self._read(table, self._hit(keys, table["n"]))
        return found.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(found.columns)

    def find_keys(self, name: str, index: str, values: DataFrame, version: dict | None = None) -> DataFrame:
        """(k, id): keys of the rows of a table that an index finds by values (one column)."""
        return self.lookup(f"{name}.{index}", values, version)

    def find(self, name: str, index: str, values: DataFrame) -> DataFrame:
        """Rows that an index finds by values."""
        version = self.version()
        return self.lookup(name, self.find_keys(name, index, values, version).select("id"), version)

    def merge(self, **changes: tuple[DataFrame | None, DataFrame | None]) -> None:
        """For each named table (rows to put in place by key, keys to remove); both may be None. One snapshot, in which only the buckets hit are new.

        Every row of a key that is removed or put in place goes, and the new rows come.
        """
        own: list[DataFrame] = []

        def held(df: DataFrame | None) -> DataFrame | None:
            if df is None or getattr(df, "_staged_at", None):
                return df
            own.append(stage(df, "merge"))
            return own[-1]

        changes = {name: (held(new), held(gone)) for name, (new, gone) in changes.items()}
        while True:
            base, patches = self.version(), {}
            for name, (new, gone) in changes.items():
                self._patch(name, base, new, gone, patches)
            if self._point({}, patches):
                drop(*own)
                return self._forget()

    def _patch(self, name: str, base: dict, new: DataFrame | None, gone: DataFrame | None, patches: dict) -> None:
        table = base[name]
        key = table["key"]
        schema = T.StructType.fromJson(table["schema"])
        new = self.spark.createDataFrame([], schema) if new is None else new.select(schema.names)
        keys = new.select(F.col(key).alias("k"))
        if gone is not None:
            keys = keys.unionByName(gone.select(F.col(gone.columns[0]).cast(schema[key].dataType).alias("k")))
        keys = keys.distinct()
        hit = self._hit(keys, table["n"])
        old = self._read(table, hit)
        kept = old.join(keys.select(F.col("k").alias(key)), key, "left_anti").select(schema.names)
        patches[name] = (table, dict.fromkeys(hit) | self._write(name, kept.unionByName(new), key, table["n"]))
        left = old.join(keys.select(F.col("k").alias(key)), key, "left_semi").select(schema.names)
        for index in INDEXES.get(name, {}):
            own = base.get(f"{name}.{index}")
            if own is None:
                continue
            before, after = self._pairs(name, index, left, key), self._pairs(name, index, new, key)
            hit_k = self._hit(before.select("k").unionByName(after.select("k")), own["n"])
            stay = self._read(own, hit_k).join(keys.select(F.col("k").alias("id")), "id", "left_anti").select("k", "id")
            patches[f"{name}.{index}"] = (own, dict.fromkeys(hit_k) | self._write(f"{name}.{index}", stay.unionByName(after), "k", own["n"]))

    def _one(self, value: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(value).alias("k"))

    # Graph and chunks

    def save_graph(self, nodes: DataFrame, edges: DataFrame, relations: DataFrame | None = None) -> None:
        """Nodes, edges and relations as one snapshot; what is not in them is gone."""
        last, once = snapshot(nodes, edges)
        self.save(nodes=last, edges=once, **({} if relations is None else {"relations": relations}))

    def save_node(self, node: DataFrame) -> None:
        if "nodes" in self.version():
            self.merge(nodes=(node, None))
        else:
            self.save(nodes=node)

    def node(self, id_: str) -> DataFrame:
        return self.lookup("nodes", self._one(id_))

    def nodes_of_file(self, path: str) -> DataFrame:
        return self.find("nodes", "files", self._one(path)).filter(F.col("filepath") == path)

    def save_chunks(self, chunks: DataFrame) -> None:
        if "chunks" in self.version():
            self.merge(chunks=(chunks, None))
        else:
            self.save(chunks=chunks)

    def delete_chunks(self, targets: DataFrame) -> None:
        """Removes the chunks whose id or file is in targets (target)."""
        version = self.version()
        by_file = self.find_keys("chunks", "files", targets, version).select(F.col("id").alias("target"))
        # A key's rows go together; those of another file with a key that a target names by file only come back.
        keys = targets.select("target").unionByName(by_file).distinct()
        stay = delete(self.lookup("chunks", keys, version), targets)
        self.merge(chunks=(stay, keys))

    def chunk_ids(self) -> DataFrame:
        return self.load("chunks").select("id").filter(F.trim("id") != "")

    def hashes(self, ids: DataFrame) -> DataFrame:
        return self.lookup("chunks", ids.select("id")).select("id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))

    def count_chunks(self) -> int:
        return self.load("chunks").count()

    def count_files(self) -> DataFrame:
        return distinct_files(self.load("chunks"))


class Index(Protocol):
    """What a vector index does."""

    def add(self, items: DataFrame) -> None: ...
    def delete(self, targets: DataFrame) -> None: ...
    def search(self, query: list[float], k: int) -> DataFrame: ...
    def hashes(self, ids: DataFrame) -> DataFrame: ...


class StoredIndex:
    """An index over a store's chunks (with ``embedding``)."""

    def __init__(self, store: Store):
        self.store = store

    def add(self, items: DataFrame) -> None:
        self.store.save_chunks(items)

    def delete(self, targets: DataFrame) -> None:
        self.store.delete_chunks(targets)

    def search(self, query: list[float], k: int) -> DataFrame:
        return top_k(self.store.load("chunks"), query, k)

    def hashes(self, ids: DataFrame) -> DataFrame:
        return self.store.hashes(ids)


def distinct_files(chunks: DataFrame) -> DataFrame:
    """One row, n: distinct non-blank files."""
    return chunks.agg(F.count_distinct(F.when(F.trim("file_path") != "", F.col("file_path"))).alias("n"))


def read_json(spark: SparkSession, path: str, schema: str | None = None, whole: bool = False) -> DataFrame:
    """Rows of JSON files, one on each line as ``write_json`` has them; ``whole``: each file is one document."""
    reader = spark.read.option("multiLine", whole)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    """Rendered documents as text files, a folder for each ``doc``."""
    df.select("doc", F.col(column).alias("value")).write.mode("overwrite").partitionBy("doc").text(path)
