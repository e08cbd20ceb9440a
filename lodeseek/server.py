"""The engine's four read tools over standard input and output: one JSON-RPC 2.0 message a line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .engine import Engine
from .sources import config

STRING, NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS = {
    "search": ({"query": STRING, "topK": {"type": "integer", "minimum": 1, "maximum": 100}, "branch": STRING, "sourceId": STRING, "sourceName": STRING, "sourceType": STRING, "pathPrefix": STRING}, ["query"]),
    "read_source": ({"chunkId": STRING, "path": STRING, "headerPath": STRING, "startLine": NUMBER, "endLine": NUMBER, "contextLines": NUMBER, "branch": STRING, "sourceName": STRING}, []),
    "list_sources": ({"sourceType": STRING, "path": STRING, "limit": NUMBER}, []),
    "status": ({}, []),
}


def call(engine: Engine, tool: str, a: dict):
    if unknown := set(a) - set(TOOLS[tool][0]):
        raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
    if missing := [x for x in TOOLS[tool][1] if not a.get(x)]:
        raise ValueError(f"missing arguments: {', '.join(missing)}")
    if tool == "search":
        rows = engine.search(a["query"], a.get("topK"), a.get("branch"), a.get("sourceId"), a.get("sourceName"), a.get("sourceType"), a.get("pathPrefix"))
        return [r.asDict(recursive=True) for r in rows.orderBy("place").collect()]
    if tool == "read_source":
        return engine.read_source(a.get("chunkId"), a.get("path"), a.get("headerPath"), a.get("startLine"), a.get("endLine"), a.get("contextLines", 0), a.get("branch"), a.get("sourceName"))
    if tool == "list_sources":
        return [r.asDict() for r in engine.list_sources(a.get("sourceType"), a.get("path"), a.get("limit")).collect()]
    return engine.status()


def answer(engine: Engine, message: dict) -> dict | None:
    """The reply to a message; None for a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseek", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (p, r) in TOOLS.items()]}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            text, wrong = json.dumps(call(engine, params["name"], params.get("arguments") or {}), default=str), False
        except (ValueError, RuntimeError) as e:
            text, wrong = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": wrong}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: Engine, lines: TextIO, out: TextIO) -> None:
    """Answers each line; nothing but replies is written to out."""
    for line in lines:
        if line.strip():
            try:
                reply = answer(engine, json.loads(line))
            except json.JSONDecodeError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()


def main() -> None:
    p = argparse.ArgumentParser(prog="lodeseek-server")
    p.add_argument("--config")
    p.add_argument("--store", default=os.environ.get("LODESEEK_STORE", "lodeseek-store"))
    o = p.parse_args()
    serve(Engine(SparkSession.builder.appName("lodeseek-server").getOrCreate(), o.store, config.load(o.config)), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
