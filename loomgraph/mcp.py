"""A model-context server over one graph: JSON-RPC lines, a closed set of tools with closed schemas, and four resources."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from . import report
from .schema import GraphError
from .service import Service
from .snapshot import to_json

PROTOCOL = "2025-06-18"
TEXT, WHOLE, FLAG = {"type": "string"}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
LIST = {"type": "array", "items": {"type": "string"}}
#: What a structural graph doesn't answer: refused by name rather than as unknown.
SEMANTIC = frozenset("summarize classify extract_claims infer_intent recommend_refactor".split())
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


@dataclass(frozen=True)
class Tool:
    name: str
    method: str
    description: str
    properties: dict
    required: tuple[str, ...] = ()

    def schema(self) -> dict:
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}}


FIND = {"query": TEXT, "node_ids": LIST, "max_results": WHOLE, "cursor": TEXT, "max_examined": WHOLE}
TOOLS = (
    Tool("graph_capabilities", "capabilities", "What this server answers.", {}),
    Tool("graph_health", "health", "Counts, and whether the graph is whole.", {}),
    Tool("graph_query", "query", "Nodes by words, best first.", FIND, ("query",)),
    Tool("graph_explain", "explain", "Nodes by words, with what made each a hit.", FIND, ("query",)),
    Tool("graph_neighborhood", "neighborhood", "Nodes around one.", {"node_id": TEXT, "depth": WHOLE, "max_results": WHOLE, "edge_kinds": LIST, "node_kinds": LIST}, ("node_id",)),
    Tool("graph_path", "path", "The first shortest way between two nodes.", {"source_id": TEXT, "target_id": TEXT, "max_hops": WHOLE, "edge_kinds": LIST}, ("source_id", "target_id")),
    Tool("graph_report", "report", "Counts, most connected nodes and nodes alone.", {"top_n": WHOLE}),
    Tool("graph_export", "export", "The graph as DOT, Mermaid or JSON.", {"format": TEXT}),
    Tool("graph_json_export", "json_export", "The graph under the names that other tools read.", {}),
    Tool("graph_investigate", "investigate", "Matches among a preset's nodes, with what surrounds them.", {"query": TEXT, "preset": TEXT, "max_results": WHOLE}, ("query",)),
    Tool("graph_refresh", "refresh", "The graph anew from its root.", {}),
)
RESOURCES = (("graph://status", "status", "Capabilities and health."), ("graph://snapshot", "snapshot", "The canonical snapshot."), ("graph://report", "report", "The structural report."), ("graph://precise-index", "precise index", "What was taken from precise indexes."))
TEMPLATE = "graph://node/{id}"


def check(schema: dict, given: Any, where: str = "arguments") -> None:
    """Refuses what a closed object schema doesn't allow; a boolean is no integer."""
    if not isinstance(given, dict):
        raise GraphError("invalid_params", f"{where} must be an object")
    if unknown := sorted(set(given) - set(schema["properties"])):
        raise GraphError("invalid_params", f"{where} has unknown keys", keys=unknown)
    if missing := sorted(set(schema["required"]) - set(given)):
        raise GraphError("invalid_params", f"{where} lacks keys", keys=missing)
    for key, value in given.items():
        want = schema["properties"][key]
        ok = {"string": lambda v: isinstance(v, str), "integer": lambda v: type(v) is int and v >= want.get("minimum", v), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)}[want["type"]]
        if not ok(value):
            raise GraphError("invalid_params", f"{where}.{key} must be of type {want['type']}")


class Server:
    def __init__(self, service: Service, refresh: Callable[[], Service] | None = None) -> None:
        self.service, self.again = service, refresh
        self.tools = {t.name: t for t in TOOLS}
        self.methods: dict[str, Callable[[dict], Any]] = {
            "initialize": self.initialize, "ping": lambda p: {}, "tools/list": lambda p: {"tools": [t.schema() for t in TOOLS]}, "tools/call": self.call,
            "resources/list": lambda p: {"resources": [{"uri": u, "name": n, "description": d, "mimeType": "application/json"} for u, n, d in RESOURCES]},
            "resources/templates/list": lambda p: {"resourceTemplates": [{"uriTemplate": TEMPLATE, "name": "node", "mimeType": "application/json"}]}, "resources/read": self.read,
        }

    def initialize(self, p: dict) -> dict:
        return {"protocolVersion": PROTOCOL, "serverInfo": {"name": "loomgraph", "version": "1"}, "capabilities": {"tools": {"listChanged": False}, "resources": {"listChanged": False, "subscribe": False}}}

    def call(self, p: dict) -> dict:
        name, given = p.get("name"), p.get("arguments", {})
        if name in SEMANTIC or str(name).removeprefix("graph_") in SEMANTIC:
            raise GraphError("unsupported_tool", "this server has facts, no judgements", name=name)
        tool = self.tools.get(name)
        if tool is None:
            raise GraphError("unknown_tool", "no such tool", name=name)
        check(tool.schema()["inputSchema"], given)
        if tool.method == "refresh":
            if self.again is None:
                raise GraphError("refresh_unavailable", "the graph came from a snapshot, not from a root")
            self.service = self.again()
            answer = {"result": {"ok": True}}
        else:
            answer = self.service.handle({"id": 0, "method": tool.method, "params": given})
        body = answer.get("result", answer.get("error"))
        return {"content": [{"type": "text", "text": json.dumps(body, sort_keys=True, default=str)}], "isError": "error" in answer}

    def read(self, p: dict) -> dict:
        uri = p.get("uri", "")
        s = self.service.snapshot
        made = {
            "graph://status": lambda: self.service.health({}) | {"methods": sorted(self.service.methods)}, "graph://snapshot": lambda: json.loads(to_json(s)), "graph://report": lambda: self.service.report({}),
            "graph://precise-index": lambda: {"symbols": s.nodes.where("kind like 'scip\\_%'").count(), "mentions": s.edges.where("kind = 'mentions'").count(), "header": s.header.get("precise", {})},
        }
        if uri in made:
            body = made[uri]()
        elif isinstance(uri, str) and uri.startswith("graph://node/"):
            row = s.nodes.where(s.nodes["id"] == uri.removeprefix("graph://node/")).first()
            if row is None:
                raise GraphError("not_found", "no such node", uri=uri)
            body = row.asDict()
        else:
            raise GraphError("unknown_resource", "no such resource", uri=uri)
        return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(body, sort_keys=True, default=str)}]}

    def handle(self, request: Any) -> dict | None:
        """The answer, or nothing to a notification."""
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return self._error(None, REQUEST, "not a request")
        rid, params = request.get("id"), request.get("params", {})
        if "id" not in request:
            return None
        method = self.methods.get(request["method"])
        if method is None:
            return self._error(rid, METHOD, "no such method")
        if not isinstance(params, dict):
            return self._error(rid, PARAMS, "params must be an object")
        try:
            return {"jsonrpc": "2.0", "id": rid, "result": method(params)}
        except GraphError as e:
            return self._error(rid, PARAMS, e.message, {"code": e.code, **e.details})
        except Exception as e:  # noqa: BLE001  a client learns the kind, not the inside
            return self._error(rid, INTERNAL, type(e).__name__)

    def _error(self, rid: Any, code: int, message: str, data: dict | None = None) -> dict:
        return {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": message} | ({"data": data} if data else {})}

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError:
                answer = self._error(None, PARSE, "not JSON")
            if answer is not None:
                out.write(json.dumps(answer, sort_keys=True, default=str) + "\n")
                out.flush()


def client_config(command: str, store: str) -> dict:
    """What a client puts in its own settings to start this server."""
    return {"servers": {"loomgraph": {"command": command, "args": ["-m", "loomgraph", "mcp", store]}}}


def smoke(server: Server) -> dict:
    """Asks for everything once that needs no arguments; which of it failed."""
    asked = ["initialize", "ping", "tools/list", "resources/list"]
    failed = [m for m in asked if "error" in (server.handle({"jsonrpc": "2.0", "id": 1, "method": m}) or {})]
    failed += [t.name for t in TOOLS if not t.required and t.method != "refresh" and server.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": t.name}}).get("result", {}).get("isError", True)]
    return {"ok": not failed, "failed": failed}


def markdown(server: Server) -> str:
    return report.report_md(server.service.snapshot)
