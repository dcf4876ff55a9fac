"""A tool server over standard input and output: JSON-RPC, one message a line."""

from __future__ import annotations

import json
import sys
from typing import IO

from pyspark.sql import SparkSession

from lodestone.config import load_config
from lodestone.functions.vectors import ModelNotCachedError, load_embedder
from lodestone.plans import hybrid
from lodestone.store import Index

NOT_READY = "The embedding model is not on this machine. Install it, then try again."


def _tools(layers: list[str]) -> list[dict]:
    text = {"type": "string"}
    return [
        {"name": "search", "description": "Finds a feature's code from a description: literal matches, nearest chunks by layer (" + ", ".join(layers) + ") and module, imports and links by shared strings. An empty layer is a valid result.", "inputSchema": {"type": "object", "properties": {"query": text}, "required": ["query"]}},
        {"name": "index_codebase", "description": "Brings the index up to date; unchanged files are skipped unless force is set.", "inputSchema": {"type": "object", "properties": {"force": {"type": "boolean"}}}},
        {"name": "install_model", "description": "Checks that the configured embedding model is ready.", "inputSchema": {"type": "object", "properties": {}}},
    ]


def call(index: Index, name: str, args: dict) -> str:
    """What a tool answers; a missing model is an answer, not an error."""
    config = load_config(index.root)
    try:
        if name == "search":
            notice = index.notice()
            text = hybrid.render(args["query"], hybrid.search_hybrid(index, args["query"], config))
            return f"NOTE: {notice}\n\n{text}" if notice else text
        if name == "index_codebase":
            run = index.update(config, force=bool(args.get("force")))
            lines = [f"changed={run.changed_files} unchanged={run.unchanged_files} deleted={run.deleted_files} new_chunks={run.new_chunks}"]
            if run.parse_errors:
                lines.append(f"parse errors: {len(run.parse_errors)} (first: {run.parse_errors[0]})")
            return "\n".join(lines)
        if name == "install_model":
            load_embedder(index.model)
            return f"{index.model} is ready"
    except ModelNotCachedError:
        return NOT_READY
    raise ValueError(f"no such tool: {name}")


def answer(index: Index, message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": _tools(load_config(index.root).layers)}}
    if method == "tools/call":
        try:
            text, failed = call(index, params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001 - the client gets it
            text, failed = repr(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}


def serve(spark: SparkSession, root: str, model: str, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    index = Index(spark, root, model)
    for line in source:
        if line.strip():
            reply = answer(index, json.loads(line))
            if reply is not None:
                print(json.dumps(reply), file=sink, flush=True)
