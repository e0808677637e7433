"""python -m weftline scan|generate|sync|update [ROOT] --store DIR [--out DIR] [--ref HEAD]"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline import staging
from weftline.functions import providers
from weftline.plans import generate, sync
from weftline.sources import code, config, diff
from weftline.sources.store import Store


def services(settings: config.Config) -> tuple[providers.Embed, providers.Writer | None]:
    """The embedder and the writer that the settings name."""
    http = {"url": settings.embed_url, "model": settings.embed_model, "key": settings.embed_key, "batch": settings.embed_batch}
    embed = providers.embedder(settings.embedder, settings.embed_dimension, **({} if settings.embedder == "hashing" else http))
    named = {} if settings.writer in ("", "none") else {"url": settings.writer_url, "model": settings.writer_model, "key": settings.writer_key}
    return embed, providers.writer(settings.writer, **named)


def run(spark: SparkSession, command: str, settings: config.Config, root: str, store: Store, out: str, ref: str = "HEAD") -> None:
    """One command over the project under ``root``; what it stages is deleted at its end."""
    embed, writer = services(settings)
    first = not store.version()
    if command == "scan" or first:
        sync.scan(spark, root, store, types=settings.types)
    if command == "generate" or command == "sync" and first:
        generate.generate(spark, store, out, embed, writer, settings.max_llm_sections, settings.embed_batch)
    elif command in ("sync", "update") and not first:
        changes = diff.changed_since(spark, root, ref)
        files = code.scan(spark, root).join(changes.select(F.col("path").alias("filepath")), "filepath", "left_semi")
        refs = spark.read.parquet(settings.typed_refs) if settings.typed_refs else None
        sync.update_graph(store, changes, files, refs=refs, within_package=settings.package_first)
        sync.index(store, embed, settings.max_embed_chunks, settings.embed_batch)
        routes = settings.max_llm_routes if settings.enable_llm_routing else 0
        generate.update(spark, store, changes, out, embed, writer, semantic=settings.enable_semantic_match, most=settings.max_llm_sections, hops=settings.max_hops, least=settings.min_confidence, routes=routes)
    staging.clear(spark)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("command", choices=("scan", "generate", "sync", "update"))
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--store", required=True)
    p.add_argument("--out")
    p.add_argument("--ref", default="HEAD")
    a = p.parse_args(args)
    settings = config.load(os.path.join(a.root, "config.yaml"), os.path.join(a.root, ".env"))
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    root = os.path.abspath(os.path.join(a.root, settings.project_root))
    run(spark, a.command, settings, root, Store(spark, a.store, settings.store_buckets), a.out or a.store, a.ref)


if __name__ == "__main__":
    main()
