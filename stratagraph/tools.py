"""The engine as tools: named calls with plain arguments and plain results, one JSON object a line."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import functions as F

from stratagraph.api import Engine


class Tools:
    """Every tool returns what JSON can hold; what goes wrong comes back as ``{"error": ...}`` and stops nothing."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self.calls: dict[str, Callable[..., Any]] = {"query": self.query, "index": self.index, "history": engine.history, "syntax_tree": engine.syntax_tree, "dependencies": self.dependencies, "node_types": engine.node_types, "edge_types": engine.edge_types, "amend": self.amend}

    def call(self, name: str, arguments: dict | None = None) -> Any:
        if name not in self.calls:
            return {"error": f"unknown tool {name!r}; there are {', '.join(self.calls)}"}
        try:
            return self.calls[name](**(arguments or {}))
        except Exception as e:  # noqa: BLE001 - a caller gets every failure as an answer
            return {"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}

    def query(self, query: str = "", limit: int = 10, as_text: bool = False, **options: Any) -> dict:
        """A page of results with message, author, date and the related nodes with their attributes, or the same as text."""
        page = self.engine.query(query, limit=limit, **{"min_score": 0.0, "depth": 2, **options})
        if as_text:
            return {"text": self.engine.text(page)}
        rows = page.orderBy(F.desc("relevance"), "id").collect()  # at most ``limit``
        related = lambda c: {"id": c["id"], "type": c["type"], "distance": c["distance"], "attributes": json.loads(c["attributes"] or "{}")}
        return {"results": [{**{k: r[k] for k in ("id", "message", "author", "date", "relevance")}, "reasons": list(r["reasons"]), "related": [related(c) for c in r["connections"]]} for r in rows]}

    def index(self, repositories: str, **options: Any) -> dict:
        return {"nodes": self.engine.index(repositories, **options)}

    def dependencies(self, node: str) -> list[dict]:
        return [r.asDict() for r in self.engine.dependencies(node).collect()]  # the neighbours of one node

    def amend(self, action: str, entity_type: str, data: str | dict) -> dict:
        return {"id": self.engine.amend(action, entity_type, json.loads(data) if isinstance(data, str) else data)}


def serve(engine: Engine, source: IO[str], sink: IO[str]) -> None:
    """Answer lines ``{"tool": name, "arguments": {...}}`` until the source ends; a line that is no such object gets an error."""
    tools = Tools(engine)
    for line in filter(str.strip, source):
        try:
            asked = json.loads(line)
            answer = tools.call(asked["tool"], asked.get("arguments"))
        except (ValueError, KeyError, TypeError, AttributeError):
            answer = {"error": "a line has to be an object with tool and arguments"}
        sink.write(json.dumps(answer, ensure_ascii=False, default=str) + "\n")
        sink.flush()
