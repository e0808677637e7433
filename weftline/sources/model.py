"""The document model as one JSON file, its checks, and the report of a run.

A model is small (a document's sections), so it is a plain dict on the driver; as
DataFrames, ``sections_of`` and ``sources_of`` feed the operators.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import schema
from weftline.operators.docmodel import RELATIONS, SOURCE, STATUSES
from weftline.operators.planning import CANONICAL
from weftline.sources import files

# Fixed values of the document's schema: its version, the fields of a section, and the policies' names and values.
VERSION = "v0.1.0"
STYLE = {"tone": "technical, objective", "audience": "open-source maintainers", "code_block_language": "go", "focus_mode": "semantic", "avoid_call_graph_narration": True, "prefer_conceptual_diagrams": True, "prefer_task_oriented_examples": True}
FOCUS_MODES = ("semantic", "reference", "hybrid")
TEXT, NAME, STAMP, YES_NO = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "string", "format": "date-time"}, {"type": "boolean"}
UNIT = {"type": "number", "minimum": 0, "maximum": 1}


def _whole(least: int, most: int | None = None) -> dict:
    return {"type": "integer", "minimum": least} | ({} if most is None else {"maximum": most})


def _record(optional: str = "", **fields: dict) -> dict:
    """A closed object, all of whose fields but the optional ones are required."""
    return {"type": "object", "additionalProperties": False, "required": [f for f in fields if f not in optional.split()], "properties": fields}


SOURCE_REF = _record("commit_sha confidence", symbol_id=NAME, file_path=NAME, start_line=_whole(1), end_line=_whole(1), relation={"enum": list(RELATIONS)}, commit_sha=TEXT, confidence=UNIT)
EVIDENCE = _record(coverage=UNIT, confidence=UNIT, chunk_count=_whole(0), source_count=_whole(0), query_count=_whole(0), low_evidence=YES_NO)
SECTION = _record(
    "summary evidence last_updated",
    id={"type": "string", "pattern": "^[a-zA-Z0-9._:-]+$"}, title=NAME, level=_whole(1, 6), order=_whole(0), parent_id={"type": ["string", "null"]}, content_md=TEXT, summary=TEXT, status={"enum": list(STATUSES)},
    sources={"type": "array", "items": SOURCE_REF}, evidence=EVIDENCE, hash=TEXT, last_updated=_record("pr_number", commit_sha=TEXT, pr_number=_whole(1), timestamp=STAMP),
)
POLICIES = _record(
    required_section_ids={"type": "array", "items": TEXT, "uniqueItems": True}, max_section_chars=_whole(200),
    style=_record(**{k: YES_NO if isinstance(v, bool) else TEXT for k, v in STYLE.items()} | {"focus_mode": {"enum": list(FOCUS_MODES)}}),
)
MODEL_SCHEMA = _record(
    schema_version={"type": "string", "pattern": r"^v\d+\.\d+\.\d+$"}, document=_record(id=NAME, title=NAME, root_section_ids={"type": "array", "items": NAME, "uniqueItems": True}),
    sections={"type": "array", "items": SECTION}, policies=POLICIES, meta=_record("generator_version", repo=TEXT, default_branch=TEXT, generated_at=STAMP, generator_version=TEXT),
)


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def section_digest(section: dict) -> str:
    body = f"{section['title'].strip()}\n{section['content_md'].strip()}\n" + "".join(f"{s['symbol_id']}|{s['file_path']}|{s['relation']}\n" for s in section["sources"])
    return "sha256:" + hashlib.sha256(body.encode()).hexdigest()


def new_model(sections: list[dict], title: str = "Project Documentation", repo: str = ".") -> dict:
    roots = [s["id"] for s in sections if s.get("parent_id") is None]
    return {
        "schema_version": VERSION, "document": {"id": "main-doc", "title": title, "root_section_ids": [*(c for c in CANONICAL if c in roots), *(r for r in roots if r not in CANONICAL)]}, "sections": sections,
        "policies": {"required_section_ids": list(CANONICAL), "max_section_chars": 8000, "style": dict(STYLE)}, "meta": {"repo": repo, "default_branch": "main", "generated_at": now(), "generator_version": "weftline"},
    }


def problems(documents: DataFrame) -> DataFrame:
    """(doc, path, rule): what keeps models (doc, and their JSON in model) from being saved, of any number of them.

    Beside the rules of ``MODEL_SCHEMA``: a model without sections (``sections``), each id that several sections have (``repeated:id``),
    and each required section that is missing (``missing:id``).
    """
    none = F.array().cast("array<string>")
    named = lambda word, found: F.transform(found, lambda i: F.concat(F.lit(f"{word}:"), i))

    def rules(x: Column) -> Column:
        ids, needed = x["ids"], x["needed"]
        repeated = F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: i == j)) > 1)
        each = (F.when(F.size(ids) < 1, F.array(F.lit("sections"))), named("repeated", repeated), named("missing", F.array_except(needed, ids)))
        return F.transform(F.flatten(F.array(*(F.coalesce(r, none) for r in each))), lambda r: F.struct(F.lit("$.sections").alias("path"), r.alias("rule")))

    def more(document: Column) -> Column:
        ids = F.filter(F.transform(F.try_variant_get(document, "$.sections", "array<variant>"), lambda s: F.try_variant_get(s, "$.id", "string")), lambda i: i.isNotNull())
        needed = F.try_variant_get(document, "$.policies.required_section_ids", "array<string>")
        return F.flatten(F.transform(F.array(F.struct(F.coalesce(ids, none).alias("ids"), needed.alias("needed"))), rules))

    return schema.violations(documents, MODEL_SCHEMA, more=more)


def models_of(sections: DataFrame) -> DataFrame:
    """(doc, model): the models of documents' sections as JSON texts, a row for each document. sections: doc, ord, section (a struct of a section's fields)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.to_json("section", {"ignoreNullFields": "false"}).alias("text")))), lambda x: x["text"])
    frame = json.dumps(new_model([]) | {"sections": "@"}, ensure_ascii=False).split('"@"')
    return sections.groupBy("doc").agg(F.concat(F.lit(frame[0] + "["), F.array_join(ordered, ","), F.lit("]" + frame[1])).alias("model"))


def save_model(spark: SparkSession, path: str, model: dict) -> None:
    text = json.dumps(model, indent=2, ensure_ascii=False) + "\n"
    if found := problems(spark.createDataFrame([("main", text)], "doc string, model string")).orderBy("path", "rule").collect():
        raise ValueError("document model: " + "; ".join(f"{r.path} {r.rule}" for r in found))
    files.put(spark, path, text)


def load_model(spark: SparkSession, path: str) -> dict | None:
    return json.loads(files.read(spark, path)) if files.exists(spark, path) else None


def sections_of(spark: SparkSession, model: dict, doc: str = "main") -> DataFrame:
    rows = [(doc, s["id"], s["title"], s["level"], s["order"], s.get("parent_id"), s["content_md"], s.get("summary") or "", s["status"], [tuple(r.get(k) for k in ("symbol_id", "file_path", "start_line", "end_line", "relation", "confidence")) for r in s["sources"]], s["hash"]) for s in model["sections"]]
    return spark.createDataFrame(rows, f"doc string, id string, title string, level int, ord int, parent_id string, content_md string, summary string, status string, sources array<{SOURCE}>, hash string")


def sources_of(spark: SparkSession, model: dict) -> DataFrame:
    rows = [(s["id"], r["symbol_id"], r["file_path"], r.get("confidence")) for s in model["sections"] for r in s["sources"]]
    return spark.createDataFrame(rows, "section_id string, symbol_id string, file_path string, confidence double")


def rows_to_sections(sections: DataFrame) -> list[dict]:
    """Sections as the model has them, in order."""
    out = []
    for r in sections.orderBy("ord").collect():
        sources = [s.asDict() | {"commit_sha": "HEAD"} for s in r.sources or []]
        out.append({"id": r.id, "title": r.title, "level": r.level, "order": r.ord, "parent_id": r.parent_id, "content_md": r.content_md, "summary": r.summary, "status": r.status, "sources": sources, "hash": r.hash, "last_updated": {"commit_sha": "HEAD", "timestamp": now()}})
    return out


class Report:
    """Stages, sections and signals of a run."""

    def __init__(self, mode: str):
        self.mode, self.stages, self.sections, self.signals = mode, [], [], []

    @contextmanager
    def stage(self, name: str):
        counters: dict[str, float] = {}
        row = {"name": name, "status": "ok", "started_at": now(), "counters": counters}
        began = time.perf_counter()
        try:
            yield counters
        except Exception as e:
            row |= {"status": "failed", "error": str(e)}
            raise
        finally:
            self.stages.append(row | {"finished_at": now(), "duration_ms": round(1000 * (time.perf_counter() - began))})

    def as_dict(self) -> dict:
        rank = {"critical": 0, "warning": 1}
        signals = sorted(self.signals, key=lambda s: (rank.get(s["severity"], 2), s["stage"], s["code"]))
        counts = {"critical": 0, "warning": 0, "info": 0} | Counter(s["severity"] for s in signals)
        quality = [s["writer_quality_score"] for s in self.sections]
        summary = {"stage_count": len(self.stages), "section_count": len(self.sections), "failed_stages": sum(s["status"] != "ok" for s in self.stages), "low_evidence_sections": sum(s["low_evidence"] for s in self.sections), "avg_writer_quality": sum(quality) / len(quality) if quality else 0.0, "signals_by_severity": counts}
        return {"version": "v1", "mode": self.mode, "generated_at": now(), "stages": self.stages, "sections": self.sections, "signals": signals, "summary": summary}

    def save(self, spark: SparkSession, path: str) -> None:
        files.put(spark, path, json.dumps(self.as_dict(), indent=2) + "\n")
