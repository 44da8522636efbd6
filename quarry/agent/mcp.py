"""The tools and the manifest of an index for other programs, over the Model Context Protocol.

Messages are JSON-RPC 2.0, an object a line.  Requests get one reply each;
notifications get none.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import TextIO

from .tools import Tool

#: Versions of the protocol that are answered for; the first is offered to clients of others.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
MANIFEST = "index://manifest"
_KINDS = {str: "string", int: "integer", bool: "boolean"}
PARSE_ERROR, INVALID, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def schema(tool: Tool) -> dict:
    """A tool's arguments as a JSON schema."""
    properties = {}
    for name, a in tool.arguments.items():
        own = {"type": _KINDS[a.kind]} | ({} if a.default is None else {"default": a.default})
        properties[name] = own | ({} if a.low is None else {"minimum": a.low, "maximum": a.high})
    return {"type": "object", "properties": properties, "required": [n for n, a in tool.arguments.items() if a.default is None], "additionalProperties": False}


class Server:
    def __init__(self, manifest: dict, tools: dict[str, Tool]):
        self.manifest, self.tools = manifest, tools
        self.methods = {
            "initialize": self.initialize, "ping": lambda _: {}, "tools/list": self.list_tools, "tools/call": self.call_tool,
            "resources/list": self.list_resources, "resources/read": self.read_resource,
        }

    def initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        name = "-".join((self.manifest.get("project_name") or "documents").lower().split())
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": f"quarry-{name}", "version": "1.0.0"}}

    def list_tools(self, params: dict) -> dict:
        return {"tools": [{"name": t.name, "description": t.description, "inputSchema": schema(t)} for t in self.tools.values()]}

    def call_tool(self, params: dict) -> dict:
        tool, given = self.tools.get(params.get("name")), params.get("arguments") or {}
        if tool is None:
            raise RpcError(BAD_PARAMS, f"unknown tool: {params.get('name')}")
        if not isinstance(given, dict):
            raise RpcError(BAD_PARAMS, "arguments must be an object")
        result = tool(**given)
        return {"content": [{"type": "text", "text": result.text}], "isError": result.is_error}

    def list_resources(self, params: dict) -> dict:
        return {"resources": [{"uri": MANIFEST, "name": "manifest", "description": "What the index was built from and how", "mimeType": "application/json"}]}

    def read_resource(self, params: dict) -> dict:
        if params.get("uri") != MANIFEST:
            raise RpcError(BAD_PARAMS, f"unknown resource: {params.get('uri')}")
        return {"contents": [{"uri": MANIFEST, "mimeType": "application/json", "text": json.dumps(self.manifest, indent=2)}]}

    def reply(self, line: str) -> dict | None:
        """The reply to one message; None if it wants none."""
        try:
            message = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}}
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "not a request"}}
        if "id" not in message:
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            method, params = self.methods.get(message["method"]), message.get("params") or {}
            if method is None:
                raise RpcError(NO_METHOD, f"unknown method: {message['method']}")
            if not isinstance(params, dict):
                raise RpcError(BAD_PARAMS, "params must be an object")
            return out | {"result": method(params)}
        except RpcError as e:
            return out | {"error": {"code": e.code, "message": str(e)}}

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers messages until the input ends."""
        for line in lines:
            if line.strip() and (reply := self.reply(line)) is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()
