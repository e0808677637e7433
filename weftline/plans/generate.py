"""Documents from a stored graph and index: full generation, and updates of the sections that a change affects.

Evidence, drafts, diagrams and facts of all sections are found together, so the number of jobs doesn't depend on how many
sections there are. The driver collects texts and sources of a document's sections, and asks a writer for each.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import exprs
from weftline.functions.providers import Embed, Writer, parse_index
from weftline.operators import capability, chunk, docmodel, drafts, planning, report, retrieval, vector
from weftline.plans import sync
from weftline.sources import files
from weftline.sources import model as models
from weftline.sources.store import Store
from weftline.staging import stage


@dataclass(frozen=True)
class SectionPlan:
    id: str
    title: str
    goal: str
    blocks: Sequence[str] = ()
    hints: Sequence[str] = ()
    diagram: str = ""

    @property
    def top_k(self) -> int:
        return retrieval.SECTION_TOP_K.get(self.id, (*retrieval.FALLBACK_TOP_K, False))[0]

    @property
    def min_evidence(self) -> int:
        return retrieval.SECTION_TOP_K.get(self.id, (*retrieval.FALLBACK_TOP_K, False))[1]

    @property
    def may_rewrite(self) -> bool:
        return retrieval.SECTION_TOP_K.get(self.id, (0, 0, False))[2]

    @property
    def words(self) -> Sequence[str]:
        return retrieval.SECTION_KEYWORDS.get(self.id, f"{self.title} {self.id}".lower().split())


# Fixed values but for the goals: ids, titles, required blocks and query hints of sections, and the heading of a diagram.
PLAN = (
    SectionPlan("overview", "Overview", "Say what the system is for, where it ends, and how work flows through it.", ("Purpose", "End-to-End Flow", "Core Concepts"), ("system architecture", "runtime flow", "core components", "boundaries"), "## System Diagram"),
    SectionPlan("key-features", "Key Features", "Tell what each capability does, its limits and its use; files are not walked through.", ("Capability",), ("core capabilities", "business behavior", "constraints", "workflows")),
    SectionPlan("development", "Development", "Help maintainers to set up, configure and run the project.", ("Quick Start", "Configuration", "Architecture Snapshot"), ("development setup", "configuration", "cli", "testing", "runtime"), "## Architecture Snapshot"),
)


NOTHING = {"coverage": 0.0, "confidence": 0.0, "chunk_count": 0, "source_count": 0, "low_evidence": True}


def section_rows(spark: SparkSession, plans: Sequence[SectionPlan]) -> DataFrame:
    """Plans as a table: section, section_id, title, goal, heading, top_k, min_evidence, words."""
    rows = [(p.id, p.id, p.title, p.goal, p.diagram, p.top_k, p.min_evidence, list(p.words)) for p in plans]
    return spark.createDataFrame(rows, "section string, section_id string, title string, goal string, heading string, top_k int, min_evidence int, words array<string>")


def _stats(chunks: DataFrame, asked: DataFrame) -> dict[str, dict]:
    """Evidence statistics by section; asked: section, min_evidence, query_count."""
    rows = chunks.join(F.broadcast(asked), "section")
    return {r.section: r.asDict() for r in retrieval.evidence_stats(rows, ["section"], F.col("min_evidence"), F.col("query_count")).collect()}


def evidence(spark: SparkSession, chunks: DataFrame, plans: Sequence[SectionPlan], embed: Embed, capabilities: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, dict[str, dict]]:
    """(chunks of all sections with section and rank, each section's evidence statistics): one search and one selection, however many sections."""
    queries = {p.id: retrieval.section_queries(p.id, p.title, p.goal, p.blocks, p.hints, capabilities if p.id == "key-features" else ()) or [p.id] for p in plans}
    texts = [(s, i, q) for s, of in queries.items() for i, q in enumerate(of)]
    vectors = embed([q for _, _, q in texts])
    asked = spark.createDataFrame([(s, i, [float(x) for x in v]) for (s, i, _), v in zip(texts, vectors, strict=True)], "section string, n int, query array<float>")
    sections = section_rows(spark, plans)
    hits = stage(retrieval.search_each(chunks.select("id", "embedding"), asked, sections), "found")
    picked = stage(retrieval.select_each(chunks.drop("embedding"), hits, sections), "evidence")
    counts = spark.createDataFrame([(p.id, p.min_evidence, len(queries[p.id])) for p in plans], "section string, min_evidence int, query_count int")
    known = _stats(picked, counts)
    found = {r.section: r["count"] for r in hits.groupBy("section").count().collect()}
    return picked, {s: NOTHING | {"query_count": len(of)} | known.get(s, {}) | {"search_hits": found.get(s, 0)} for s, of in queries.items()}


def _read(spark: SparkSession, written: dict[str, str], sections: dict) -> dict:
    """A writer's texts by section, cleaned, as ``drafts.read`` tells; sections: rows of ``drafts.texts``, with the diagrams to put in."""
    if not written:
        return {}
    rows = [(s, sections[s].section_id, sections[s].heading, sections[s].diagram, text) for s, text in written.items()]
    df = spark.createDataFrame(rows, "section string, section_id string, heading string, diagram string, plain string")
    df = df.withColumn("plain", exprs.without_instructions(exprs.without_fences(F.col("plain"))))
    return {r.section: r for r in drafts.read(df).collect()}


def write_sections(spark: SparkSession, plans: Sequence[SectionPlan], chunks: DataFrame, stats: dict[str, dict], writer: Writer | None = None, budget: int = 0, writes: Collection[str] | None = None) -> dict[str, tuple[str, dict]]:
    """(content, trace) by section: a draft of claims, by a writer's words where there is one, and else or if it reads badly the plain listing.

    chunks: evidence of all sections (section, section_id). All drafts, listings and diagrams are one plan, and a writer's words are read
    in one more; words that are asked for again, ``budget`` at most, are read one by one. writes: the sections that the writer may
    write, all if not given. A trace holds its content's quality and issues.
    """
    read: dict[str, dict] = {}
    for r in drafts.texts(chunks, section_rows(spark, plans)).collect():
        read.setdefault(r.section, {})[r.choice] = r
    asked = [p.id for p in plans if writer is not None and 0 in read[p.id] and (writes is None or p.id in writes)]
    told: dict[str, list[str]] = {s: [] for s in asked}
    if asked:
        rich = retrieval.layer_a(docmodel.chunk_sources(chunks).filter(F.col("section").isin(*asked)), by=drafts.BY)
        for r in rich.select("section", "rich", "id", "name", "description").orderBy("section", F.desc("rich"), "id").collect():
            told[r.section].append(f"{r.name}: {r.description}")
    heads = {s: of[1] for s, of in read.items()}
    written = _read(spark, {s: writer.from_draft(read[s][0].plain, told[s]) for s in asked}, heads)
    out = {}
    for plan in plans:
        own, words = read[plan.id], written.get(plan.id)
        best = own.get(0)
        trace = {"used_draft": best is not None, "used_llm": False, "used_fallback": False}
        if words and plan.may_rewrite and budget > 0 and words.quality < report.QUALITY_LOW:
            words = _read(spark, {plan.id: writer.update_section(best.plain, told[plan.id])}, heads)[plan.id]
        if words and words.plain.strip() and not words.low:
            best, trace["used_llm"] = words, True
        if best is None or best.low or best.quality < report.QUALITY_LOW:
            best, trace["used_fallback"] = own[1], True
        budget -= trace["used_llm"]
        trace |= {"quality": best.quality, "issues": [x for x in best.issues.split(",") if x]}
        out[plan.id] = (best.noted if stats[plan.id]["low_evidence"] else best.content, trace)
    return out


def write_section(spark: SparkSession, plan: SectionPlan, chunks: DataFrame, stats: dict, writer: Writer | None = None, budget: int = 0) -> tuple[str, dict]:
    """(content, trace) of one section."""
    of = chunks.withColumn("section", F.lit(plan.id)).withColumn("section_id", F.lit(plan.id))
    return write_sections(spark, [plan], of, {plan.id: stats}, writer, budget)[plan.id]


@dataclass(frozen=True)
class Facts:
    """What a section's evidence comes from: its sources in order, and its numbers of chunks and files."""

    sources: Sequence[dict] = ()
    chunks: int = 0
    files: int = 0


def _facts(chunks: DataFrame) -> dict[str, Facts]:
    """Facts by section, in one job."""
    each = docmodel.chunk_sources(chunks).select("section", F.explode("sources").alias("s")).distinct()
    sources = each.groupBy("section").agg(F.sort_array(F.collect_list("s")).alias("sources"))
    counts = chunks.groupBy("section").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(exprs.file_key(F.col("file_path"), F.col("id"))).alias("files"))
    rows = counts.join(sources, "section", "left").collect()
    return {r.section: Facts([s.asDict() | {"commit_sha": "HEAD"} for s in r.sources or ()], r.chunks, r.files) for r in rows}


def _section(plan: SectionPlan, order: int, content: str, stats: dict, facts: Facts) -> dict:
    s = {"id": plan.id, "title": plan.title, "level": 1, "order": order, "parent_id": None, "content_md": content, "status": "active", "sources": list(facts.sources)}
    s["evidence"] = {k: stats[k] for k in ("coverage", "confidence", "chunk_count", "source_count", "query_count", "low_evidence")}
    lines = [x.strip() for x in content.split("\n")]
    s["summary"] = next((x[:120] for x in lines if x and not x.startswith("#")), "")
    return s | {"hash": models.section_digest(s), "last_updated": {"commit_sha": "HEAD", "timestamp": models.now()}}


def _report_row(plan: SectionPlan, stats: dict, trace: dict, facts: Facts) -> dict:
    rest = {k: v for k, v in trace.items() if k not in ("quality", "issues")}
    return {
        "section_id": plan.id, "title": plan.title, "query_count": stats["query_count"], "search_hits": stats["search_hits"],
        "heuristic_hits": max(facts.chunks - stats["search_hits"], 0), "chunk_count": stats["chunk_count"], "source_count": stats["source_count"],
        "evidence_confidence": stats["confidence"], "evidence_coverage": stats["coverage"], "low_evidence": stats["low_evidence"],
        "writer_quality_score": trace["quality"], "writer_quality_issues": trace["issues"], "file_diversity": facts.files, **rest,
    }


def _signals(spark: SparkSession, rows: Sequence[dict]) -> list[dict]:
    told = [(r["section_id"], bool(r["low_evidence"]), r["search_hits"], r["heuristic_hits"], r["writer_quality_score"]) for r in rows]
    df = spark.createDataFrame(told, "section_id string, low_evidence boolean, search_hits int, heuristic_hits int, quality double")
    at = {r["section_id"]: i for i, r in enumerate(rows)}
    found = sorted(report.section_signals(df).collect(), key=lambda r: at[r.section_id])
    return [{"stage": r.stage, "code": r.code, "severity": r.severity, "message": r.section_id} for r in found]


def ensure_index(store: Store, embed: Embed, batch: int = 64) -> None:
    """Drops stale chunks, and builds what is missing if the index is not healthy; both against the chunks that ``sync.index`` stores."""
    symbols, edges = store.load("nodes"), store.load("edges")
    old = store.load("chunks")
    if old is None:
        sync.index(store, embed, batch=batch)
        return
    expected = stage(sync.prepared(symbols, edges).select("id"), "expected")
    health = vector.index_health(expected, old).first()
    stale = vector.missing_and_stale(expected, old).filter("state = 'stale'").select(F.col("id").alias("target"))
    if health.stale:
        store.delete_chunks(stale)
    if health.rebuild:
        sync.index(store, embed, batch=batch)


def generate(spark: SparkSession, store: Store, out: str, embed: Embed, writer: Writer | None = None, rewrites: int = 1, batch: int = 64) -> dict:
    """Writes doc_model.json, documentation.md and report.json under ``out`` and returns the model."""
    run = models.Report("generate")
    with run.stage("index"):
        ensure_index(store, embed, batch)
    chunks = store.load("chunks")
    caps = [(r.title, r.intent) for r in capability.capabilities(chunks.drop("embedding"), 5).collect()]
    with run.stage("evidence") as counters:
        picked, stats = evidence(spark, chunks, PLAN, embed, caps)
        counters["chunks"] = sum(s["chunk_count"] for s in stats.values())
    with run.stage("sections") as counters:
        written = write_sections(spark, PLAN, picked, stats, writer, rewrites)
        facts = _facts(picked)
        sections = [_section(p, i, written[p.id][0], stats[p.id], facts.get(p.id, Facts())) for i, p in enumerate(PLAN)]
        run.sections += [_report_row(p, stats[p.id], written[p.id][1], facts.get(p.id, Facts())) for p in PLAN]
        run.signals += _signals(spark, run.sections)
        counters["sections"] = len(sections)
    model = models.new_model(sections)
    _publish(spark, model, out)
    run.save(spark, f"{out}/report.json")
    return model


def _publish(spark: SparkSession, model: dict, out: str) -> None:
    models.save_model(spark, f"{out}/doc_model.json", model)
    files.put(spark, f"{out}/documentation.md", docmodel.render(models.sections_of(spark, model), model["document"]["title"]).first().markdown)


def load_or_bootstrap(spark: SparkSession, out: str) -> dict:
    """The stored model; without one, a model made from the Markdown file, and saved."""
    model = models.load_model(spark, f"{out}/doc_model.json")
    if model is not None:
        return model
    text = files.read(spark, f"{out}/documentation.md")
    s = docmodel.normalize(docmodel.build_model(spark.createDataFrame([("main", text)], "doc string, content string")))
    model = models.new_model(models.rows_to_sections(s))
    models.save_model(spark, f"{out}/doc_model.json", model)
    return model


def update(spark: SparkSession, store: Store, changes: DataFrame, out: str, embed: Embed, writer: Writer | None = None, heuristic: bool = True, semantic: bool = False, most: int = 2, hops: int = 2, least: float = 0.0, routes: int = 0) -> list[str]:
    """Rewrites the sections that a change reaches, ``most`` by a writer, and returns their ids in order.

    Chunks of changed files go to sections by file, then to the sections of the plan in turn, by heuristic, by a
    writer's choice (of ``routes`` chunks), or by vector; what is left makes a new section of at most 8. The heuristic
    leaves nothing over, so asking a writer means going without it. Changes reach ``hops`` steps over edges of ``least`` confidence.
    """
    model = load_or_bootstrap(spark, out)
    sources = models.sources_of(spark, model)
    hit, _ = sync.plan_sections(store, changes, sources, hops, least)
    preferred = [r.section_id for r in hit.collect()]
    changed = changes.select(F.col("path").alias("file_path")).distinct()
    touched = stage(store.load("chunks").join(changed, "file_path", "left_semi"), "touched")
    vectors = chosen = None
    if writer is not None and routes > 0:
        heuristic, titles = False, [s["title"] for s in model["sections"]]
        ids = [s["id"] for s in model["sections"]]
        chosen = lambda rest: planning.route_by_choice(rest, ids, lambda _, text: parse_index(str(writer.insertion_point(titles, text)), len(titles)), routes)
    if semantic and not preferred and not heuristic:
        texts = embed([f"{s['title']}\n{s['content_md']}" for s in model["sections"]])
        vectors = spark.createDataFrame([(s["id"], i, [float(x) for x in v]) for i, (s, v) in enumerate(zip(model["sections"], texts, strict=True))], "section_id string, ord int, vector array<float>")
    routed = stage(planning.route_cascade(touched, sources.select("section_id", "file_path"), preferred, heuristic, vectors, chosen=chosen), "routed")
    order = [r.section_id for r in planning.section_order(routed.groupBy("section_id").agg(F.count(F.lit(1)).alias("n")), preferred).orderBy("pos").collect()]
    by_id = {s["id"]: s for s in model["sections"]}
    known = {p.id: p for p in PLAN}
    plans = [known.get(s) or SectionPlan(s, by_id[s]["title"] if s in by_id else "Updates", "Recent changes.") for s in order]
    of = touched.drop("embedding").join(routed.select("id", F.col("section_id").alias("section")).distinct(), "id")
    of = stage(of.withColumn("section_id", F.col("section")), "changed")
    asked = spark.createDataFrame([(p.id, p.min_evidence, 1) for p in plans], "section string, min_evidence int, query_count int")
    stats = {p.id: NOTHING | {"query_count": 1} for p in plans} | _stats(of, asked)
    allowed = {s for s, x in stats.items() if x["coverage"] >= 0.75 and x["confidence"] >= 0.6 and not x["low_evidence"]}
    facts, new = _facts(of), [p for p in plans if p.id not in by_id]
    fresh = write_sections(spark, new, of.filter(F.col("section").isin([p.id for p in new])), stats, writer, writes=allowed) if new else {}
    told: dict[str, list[str]] = {p.id: [] for p in plans}
    if writer is not None:
        for r in retrieval.first_by_name(of, 10, ("section",)).select("section", "id", "name", "content").orderBy("section", "id", "name").collect():
            told[r.section].append(r.content)
    done = []
    for plan in plans:
        section = plan.id
        may_write = writer is not None and section in allowed and len(done) < most
        made = _section(plan, len(model["sections"]), fresh[section][0] if section in fresh else "", stats[section], facts.get(section, Facts()))
        if section in by_id:
            old = by_id[section]
            held = {(s["symbol_id"], s["file_path"]) for s in old["sources"]}
            old["sources"] += [s for s in made["sources"] if (s["symbol_id"], s["file_path"]) not in held]
            if may_write:
                old["content_md"] = writer.update_section(old["content_md"], told[section]).strip() or old["content_md"]
            old |= {"evidence": made["evidence"], "last_updated": made["last_updated"]}
            old["hash"] = models.section_digest(old)
        else:
            content = fresh[section][0]
            if may_write:
                content = writer.new_section(told[section]).strip() or content
            made = _section(plan, len(model["sections"]), content, stats[section], facts.get(section, Facts()))
            if writer is not None:
                at = parse_index(str(writer.insertion_point([s["title"] for s in model["sections"]], content)), len(model["sections"]))
                model["sections"].insert(at + 1 if at >= 0 else len(model["sections"]), made)
            else:
                model["sections"].append(made)
        done.append(section)
    fixed = {r.id: r for r in docmodel.normalize(models.sections_of(spark, model)).collect()}
    for s in model["sections"]:
        r = fixed[s["id"]]
        s |= {"order": r.ord, "level": r.level, "title": r.title, "content_md": r.content_md, "summary": r.summary, "hash": r.hash}
    model["sections"].sort(key=lambda s: s["order"])
    model["meta"]["generated_at"] = models.now()
    _publish(spark, model, out)
    return done
