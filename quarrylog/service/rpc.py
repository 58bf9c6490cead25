"""JSON-RPC over lines of text: initialize, tools/list, tools/call."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Iterable
from typing import IO

from .tools import Tools

# Error codes of JSON-RPC, and the protocol version.
PARSE_ERROR, INVALID_PARAMS, UNKNOWN_METHOD = -32700, -32602, -32601
PROTOCOL = "2024-11-05"


def schema_of(tool) -> dict:
    kinds = {"str": "string", "int": "integer", "bool": "boolean", "dict": "object"}
    parameters = list(inspect.signature(tool).parameters.values())
    return {
        "type": "object",
        "properties": {p.name: {"type": kinds.get(str(p.annotation).split(" ")[0], "string")} for p in parameters},
        "required": [p.name for p in parameters if p.default is inspect.Parameter.empty],
    }


def handle(tools: Tools, line: str) -> dict | None:
    """The reply to one request; notifications get none."""
    try:
        request = json.loads(line)
        method, ident, params = request["method"], request.get("id"), request.get("params") or {}
    except (ValueError, KeyError, TypeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "Parse error"}}
    if ident is None:
        return None
    reply = lambda **x: {"jsonrpc": "2.0", "id": ident} | x
    if method == "initialize":
        return reply(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarrylog", "version": "1"}})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": f"{n.replace('_', ' ')} over the log directory", "inputSchema": schema_of(getattr(tools, n))} for n in tools.NAMES]})
    if method == "tools/call":
        try:
            text = tools.call(params.get("name"), params.get("arguments"))
        except (ValueError, TypeError) as e:
            if params.get("name") not in tools.NAMES:
                return reply(error={"code": INVALID_PARAMS, "message": str(e)})
            return reply(result={"content": [{"type": "text", "text": str(e)}], "isError": True})
        except Exception as e:  # a failing query still gets its reply
            return reply(result={"content": [{"type": "text", "text": f"{type(e).__name__}: {str(e)[:500]}"}], "isError": True})
        return reply(result={"content": [{"type": "text", "text": text}]})
    return reply(error={"code": UNKNOWN_METHOD, "message": f"Unknown method {method}"})


def serve(tools: Tools, requests: Iterable[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    for line in requests:
        if line.strip() and (got := handle(tools, line)) is not None:
            out.write(json.dumps(got, ensure_ascii=False) + "\n")
            out.flush()
