"""The code search as a tool over standard input and output: one JSON-RPC message a line.

Answers hold paths relative to the project only; what went wrong is told in one of a few fixed sentences, never with the text of an exception.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable

PROTOCOL = "2024-11-05"
TOOL = {"name": "search", "description": "Ranked search over the indexed code of this project.",
        "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1, "maximum": 50}}, "required": ["query"]}}
#: What callers are told of an error, by its kind.
ERRORS = ((FileNotFoundError, "the project is not indexed"), (ValueError, "the query is empty or not valid"), (RuntimeError, "the index is older than the project"))


def public_error(error: Exception) -> str:
    return next((text for kind, text in ERRORS if isinstance(error, kind)), "the search failed")


def answer(message: dict, search: Callable[[str, int], list[dict]]) -> dict | None:
    """The reply to one message; None for notifications."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "loomstack", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [TOOL]}
    elif method == "tools/call" and params.get("name") == TOOL["name"]:
        given = params.get("arguments") or {}
        try:
            if not isinstance(given.get("query"), str):
                raise ValueError("no query")
            hits = [{k: h[k] for k in ("path", "start_line", "end_line", "score", "snippet")} for h in search(given["query"], int(given.get("top_k") or 0))]
            result = {"content": [{"type": "text", "text": json.dumps(hits, ensure_ascii=False)}], "isError": False}
        except Exception as e:  # noqa: BLE001 - whatever it is, only its kind is told
            result = {"content": [{"type": "text", "text": public_error(e)}], "isError": True}
    elif method == "ping":
        result = {}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": "unknown method or tool"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(lines: Iterable[str], write: Callable[[str], None], search: Callable[[str, int], list[dict]]) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            if not isinstance(message, dict):
                raise ValueError("no object")
        except ValueError:
            write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a message"}}) + "\n")
            continue
        reply = answer(message, search)
        if reply:
            write(json.dumps(reply, ensure_ascii=False) + "\n")


def main(root: str = ".") -> None:
    from loomstack import project
    from loomstack.operators.index import CodeIndex
    from loomstack.runtime import local_session
    from loomstack.sources.files import TOOL_DIR

    at = project.repository_root(root) or root
    index = CodeIndex(local_session("mcp"), f"file://{at}/{TOOL_DIR}/index", 8)

    def search(query: str, top_k: int) -> list[dict]:
        index.ensure_fresh(project.git_facts(at)["commit"])
        return [r.asDict() for r in index.search(query, top_k).collect()]

    def write(text: str) -> None:
        sys.stdout.write(text)
        sys.stdout.flush()

    serve(sys.stdin, write, search)


if __name__ == "__main__":
    main(*sys.argv[1:2])
