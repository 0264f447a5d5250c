"""A JSON-RPC 2.0 server over two streams, a message a line, with tools that read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TextIO

from .plans.query import QueryError
from .sources.files import ManifestError

Tool = Callable[[dict], Iterator[str]]
#: of each tool: what it says about itself, its arguments (type, whether it must be given)
TOOLS = {
    "ask": ("Ask a question about the graph", {"query": ("string", True), "all": ("boolean", False), "max_len": ("integer", False)}),
    "lint": ("All findings", {}),
    "history": ("The commits behind a node", {"qname": ("string", True)}),
    "stats": ("Counts of nodes, edges, claims and findings", {}),
}
_TYPES = {"string": str, "boolean": bool, "integer": int}


class _Fault(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _listed() -> list[dict]:
    schema = lambda args: {"type": "object", "properties": {k: {"type": t} for k, (t, _) in args.items()}, "required": [k for k, (_, must) in args.items() if must]}
    return [{"name": n, "description": d, "inputSchema": schema(args)} for n, (d, args) in TOOLS.items()]


def _call(params, tools: dict[str, Tool]) -> dict:
    if not isinstance(params, dict) or params.get("name") not in tools:
        raise _Fault(-32602, "no such tool")
    given = params.get("arguments") or {}
    for name, (kind, must) in TOOLS[params["name"]][1].items():
        if must and name not in given or name in given and not isinstance(given[name], _TYPES[kind]):
            raise _Fault(-32602, f"{name} must be a {kind}")
    try:
        text, wrong = "\n".join(tools[params["name"]](given)), False
    except (QueryError, ManifestError, ValueError) as e:  # a bad question is the tool's answer, not a fault of the protocol
        text, wrong = str(e), True
    return {"content": [{"type": "text", "text": text}], "isError": wrong}


def handle(line: str, tools: dict[str, Tool]) -> str | None:
    """The reply to one message; None to a notification."""
    number = None
    try:
        try:
            message = json.loads(line)
        except ValueError as e:
            raise _Fault(-32700, f"no JSON: {e}") from e
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            raise _Fault(-32600, "no request")
        number, method = message.get("id"), message["method"]
        if "id" not in message:
            return None
        if method == "initialize":
            result = {"protocolVersion": (message.get("params") or {}).get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "intentloom", "version": "0.2"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": _listed()}
        elif method == "tools/call":
            result = _call(message.get("params"), tools)
        else:
            raise _Fault(-32601, f"no method {method}")
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": result})
    except _Fault as e:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}})


def serve(source: TextIO, sink: TextIO, tools: dict[str, Tool]) -> None:
    for line in source:
        if line.strip() and (reply := handle(line, tools)) is not None:
            sink.write(reply + "\n")
            sink.flush()
