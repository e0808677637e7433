"""Whole runs: scan a tree into a stored graph, index it, and bring both up to date after a change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.exprs import embeddable_text
from weftline.operators import chunk, graph, link, planning, vector
from weftline.operators import typed as typed_
from weftline.sources import code
from weftline.sources.store import Store
from weftline.staging import stage

Embed = Callable[[list[str]], list[list[float]]]


def build_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, relations, edges, unresolved) of a source tree, linked by names."""
    units = stage(code.extract(code.scan(spark, root)), "units")
    symbols, relations = code.symbols(units), code.relations(units)
    edges, unresolved = link.link(relations, symbols)
    return symbols, relations, edges, unresolved


def scan(spark: SparkSession, root: str, store: Store, types: bool = False) -> None:
    """Stores the graph of a source tree. With ``types`` declared types decide before names, and what updates need for that is stored, too."""
    if not types:
        symbols, relations, edges, _ = build_graph(spark, root)
        return store.save_graph(symbols, edges, relations)
    sources = stage(code.scan(spark, root), "sources")
    units, imports = stage(_with_id(code.extract(sources)), "units"), stage(typed_.imports(sources), "imports")
    symbols, relations = code.symbols(units), stage(code.relations(units), "relations")
    refs = stage(typed_.references(units, imports, relations), "refs")
    nodes, edges = chunk.snapshot(symbols, link.link_typed(relations, symbols, refs)[0])
    store.save(nodes=nodes, edges=edges, relations=relations, units=units, imports=imports, typed_refs=refs)


def _with_id(units: DataFrame) -> DataFrame:
    return units.withColumn("id", code.unit_id())


def typed(symbols: DataFrame, refs: DataFrame | None = None) -> list[tuple[str, link.Resolver]]:
    """The resolver of what names leave over: by unique key, from references to types (from_id, ord, key) where there are any."""
    return [("types", lambda edges, unresolved: link.resolve_unique(unresolved, link.key_index(symbols), edges, refs))]


def update_graph(store: Store, changes: DataFrame, files: DataFrame, resolvers: Sequence[tuple[str, link.Resolver]] | None = None, refs: DataFrame | None = None, within_package: bool = False) -> DataFrame:
    """Replaces the symbols and relations of changed files (``files`` are those that still exist), and links anew what that concerns.

    Names of symbols that went or came lead, through the store's indexes, to the relations that ask for them; these, those that had an edge to a
    symbol that went, and those of the changed files are linked, against the symbols of their names only. All other edges stay
    as they are, and so do all buckets of the store that none of this falls in. Of a symbol that several files hold alike the store has
    the last file's; if that goes, the symbol does until the next scan.

    Names decide first, all symbols of a name or only those of the relation's package; then the resolvers (``typed``, if not given).
    In a store that was scanned with types, these decide before names; they are worked out for all relations, and relations whose references
    changed are linked anew, too. Returns the resolvers' stages, over the relations that were linked.
    """
    version = store.version()
    sources = files.filter(code.is_source(F.col("filepath")))
    units = stage(_with_id(code.extract(sources)), "units")
    paths = stage(changes.select(F.col("path").alias("filepath")).distinct(), "paths")
    old = stage(store.lookup("nodes", store.find_keys("nodes", "files", paths, version).select("id"), version).join(paths, "filepath", "left_semi").select(store.columns("nodes")), "gone")
    gone = old.select("id")
    added = code.symbols(units)
    # A symbol of the same id in another file is the same one; the last by file and line stands for it.
    twins = store.lookup("nodes", added.select("id"), version).join(paths, "filepath", "left_anti").select(added.columns)
    nodes = stage(chunk.last_by_id(added.unionByName(twins)), "nodes")
    relations = stage(code.relations(units), "relations")

    before, after = (link.key_index(df).select(F.col("key").alias("k"), "id") for df in (old, nodes))
    moved = before.exceptAll(after).unionByName(after.exceptAll(before)).select("k").distinct()
    asking = store.find_keys("relations", "names", moved, version).select("id")
    asking = asking.unionByName(store.find_keys("edges", "targets", gone, version).select("id"))
    new_refs = None
    if "typed_refs" in version:
        tables = {name: store.load(name).join(paths, "filepath", "left_anti") for name in ("units", "imports")}
        every = stage(store.load("relations").join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").unionByName(relations), "relations")
        new_imports = stage(typed_.imports(sources), "imports")
        new_refs = stage(typed_.references(tables["units"].unionByName(units), tables["imports"].unionByName(new_imports), every), "refs")
        had = store.load("typed_refs")
        other = had.exceptAll(new_refs.select(had.columns)).unionByName(new_refs.select(had.columns).exceptAll(had)).select("from_id").distinct()
        asking = asking.unionByName(other.select(F.col("from_id").alias("id")))
        refs = new_refs
    if refs is not None:
        asking = asking.unionByName(refs.join(moved.select(F.col("k").alias("key")), "key", "left_semi").select(F.col("from_id").alias("id")))
    asking = stage(asking.distinct().join(gone, "id", "left_anti").join(relations.select(F.col("from_id").alias("id")), "id", "left_anti"), "asking")

    concerned = stage(store.lookup("relations", asking, version).unionByName(relations), "concerned")
    keys = concerned.select(F.explode(F.array(*link.candidate_keys(F.col("target")))).alias("k"))
    if refs is not None:
        keys = keys.unionByName(refs.join(concerned.select("from_id").distinct(), "from_id", "left_semi").select(F.col("key").alias("k")))
    wanted = store.find_keys("nodes", "names", keys.filter("k <> ''").distinct(), version).select("id").unionByName(asking)
    known = store.lookup("nodes", wanted.distinct(), version).join(gone.unionByName(nodes.select("id")), "id", "left_anti").select(nodes.columns)
    symbols = stage(known.unionByName(nodes), "symbols")
    edges, unresolved = link.link(concerned, symbols) if new_refs is None else link.link_typed(concerned, symbols, new_refs)
    if within_package:
        edges = link.link_within_package(concerned, symbols)
    edges, _, stages = link.run_chain(edges, unresolved, typed(symbols, refs) if resolvers is None else resolvers)
    edges = stage(edges.dropDuplicates(["from_id", "to_id", "kind"]), "edges")
    stages = stage(stages, "stages")
    merged = {"nodes": (nodes, gone), "relations": (relations, gone), "edges": (edges, asking.unionByName(gone))}
    if new_refs is not None:
        merged |= {"units": (units, paths), "imports": (new_imports, paths), "typed_refs": (new_refs.join(other, "from_id", "left_semi"), other)}
    store.merge(**merged)
    return stages


def prepared(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks that an index should hold: those of symbols that matter to documents."""
    return chunk.prepare(symbols.join(graph.doc_relevant(symbols, edges), "id", "left_semi"), edges)


#: Chunks that are embedded and stored before the next are asked for; a run that is lost loses the work of so many.
COMMIT = 50_000


def index(store: Store, embed: Embed, most: int = 0, batch: int = 64, commit: int = COMMIT) -> None:
    """Embeds chunks that are new or changed, at most ``most`` of them, puts them in place, and drops those that are no longer there.

    What is stored already is skipped before the budget is cut. Chunks are embedded in parts of some ``commit`` rows, by a hash of their id,
    and each part is stored when it is whole: a run after one that broke off asks for the rest only.
    """
    symbols, edges = store.load("nodes"), store.load("edges")
    chunks = stage(prepared(symbols, edges), "chunks")
    old = store.load("chunks")
    wanted = chunks if old is None else chunk.unchanged(chunks, old)
    picked = stage(chunk.budget(wanted, most).select(chunks.columns), "picked")
    vectors = lambda df: vector.embed_column(df, embeddable_text(), embed, batch)
    if old is None:
        store.save(chunks=vectors(picked.limit(0)))
    parts = max(1, -(-picked.count() // commit))
    for part in range(parts):
        own = picked if parts == 1 else picked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        store.merge(chunks=(vectors(own), None))
    if old is not None:
        store.merge(chunks=(None, old.select("id").join(chunks.select("id"), "id", "left_anti")))


def plan_sections(store: Store, changes: DataFrame, sources: DataFrame, hops: int = 2, least: float = 0.0, kinds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(sections that a change affects, in order; symbols reached that no section refers to)."""
    symbols, edges = store.load("nodes"), store.load("edges")
    return reach_sections(symbols, edges, changes, sources, hops, least, kinds)


def reach_sections(symbols: DataFrame, edges: DataFrame, changes: DataFrame, sources: DataFrame, hops: int = 2, least: float = 0.0, kinds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    nodes, _ = graph.expand(edges, graph.seeds(symbols, changes), hops, least, kinds)
    hit = planning.section_impact(sources, nodes, changes.select("path").distinct())
    return hit.orderBy(*planning.by_impact()), planning.unmatched_symbols(nodes, sources)
