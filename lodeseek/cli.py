"""Command line: init, index, search, read, list, remove, status, export, import, re-embed, gc, summarize."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources import config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeseek")
    p.add_argument("--config")
    p.add_argument("--store", default=os.environ.get("LODESEEK_STORE", "lodeseek-store"))
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init")
    a = c.add_parser("index")
    a.add_argument("name", nargs="?")
    a.add_argument("--all", action="store_true")
    a.add_argument("--git")
    a.add_argument("--branch", default="main")
    a.add_argument("--path")
    a = c.add_parser("search")
    a.add_argument("query")
    a.add_argument("--top-k", type=int)
    for x in ("--branch", "--source-name", "--source-type", "--path-prefix"):
        a.add_argument(x)
    a = c.add_parser("read")
    for x in ("--chunk-id", "--path", "--header-path", "--branch", "--source-name"):
        a.add_argument(x)
    for x in ("--start-line", "--end-line"):
        a.add_argument(x, type=int)
    a.add_argument("--context", type=int, default=0)
    a = c.add_parser("list")
    a.add_argument("--type", dest="kind")
    a = c.add_parser("remove")
    a.add_argument("name")
    c.add_parser("status")
    a = c.add_parser("export")
    a.add_argument("target")
    a.add_argument("--source", action="append")
    a.add_argument("--sql", action="store_true")
    a = c.add_parser("import")
    a.add_argument("target")
    a.add_argument("--on-conflict", choices=("skip", "force", "fail"), default="skip")
    a.add_argument("--remap", nargs=2)
    a = c.add_parser("re-embed")
    a.add_argument("--source")
    a.add_argument("--force", action="store_true")
    a = c.add_parser("gc")
    a.add_argument("--grace-minutes", type=int, default=60)
    a = c.add_parser("summarize")
    a.add_argument("--source")
    a.add_argument("--limit", type=int)
    a.add_argument("--dry-run", action="store_true")
    return p


def execute(engine: Engine, o: argparse.Namespace):
    if o.command == "init":
        engine.store.commit({})
        return {"store": engine.store.folder}
    if o.command == "index":
        if o.all:
            done, errors = engine.index_all()
            return {"indexed": done, "errors": errors}
        if o.git:
            return engine.index_git(o.git, o.branch)
        if o.path:
            return engine.index_path(o.path, o.name)
        found = next((s for s in engine.config["sources"] if s["name"] == o.name), None)
        if not found:
            raise ValueError(f"no source {o.name}")
        return engine.index_git(found["url"], found.get("branch", "main"), name=o.name) if found["type"] == "git" else engine.index_path(found["path"], o.name, found.get("include"), found.get("exclude"))
    if o.command == "search":
        rows = engine.search(o.query, o.top_k, o.branch, None, o.source_name, o.source_type, o.path_prefix)
        return [r.asDict(recursive=True) for r in rows.orderBy("place").collect()]
    if o.command == "read":
        return engine.read_source(o.chunk_id, o.path, o.header_path, o.start_line, o.end_line, o.context, o.branch, o.source_name)
    if o.command == "list":
        return [r.asDict() for r in engine.list_sources(o.kind).collect()]
    if o.command == "remove":
        return {"removed": engine.remove(o.name)}
    if o.command == "status":
        return engine.status()
    if o.command == "export":
        return engine.export(o.target, o.source, o.sql)
    if o.command == "import":
        return dict(zip(("imported", "skipped", "warnings"), engine.import_(o.target, on_conflict=o.on_conflict, remap=o.remap)))
    if o.command == "re-embed":
        return {"embedded": engine.re_embed(o.source, o.force)}
    if o.command == "gc":
        return engine.gc(o.grace_minutes)
    return engine.summarize(o.source, o.limit, o.dry_run)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lodeseek").getOrCreate()
    try:
        print(json.dumps(execute(Engine(spark, o.store, config.load(o.config)), o), default=str, indent=2))
        return 0
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
