"""Command line: build, prepare, query, tree, history, dependencies, types, amend, serve."""

from __future__ import annotations

import argparse
import json
import sys

from stratagraph.api import Engine
from stratagraph.session import local_session
from stratagraph.tools import serve


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="stratagraph")
    p.add_argument("--graph", required=True, help="folder of the graph")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("repositories", help="local paths or, with --cache, addresses, separated by commas")
    b.add_argument("--cache", default="", help="folder of clones")
    b.add_argument("--token", default="", help="for https addresses")
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--with-bots", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("query", nargs="?", default="")
    q.add_argument("--repo")
    q.add_argument("--depth", type=int, default=0)
    q.add_argument("--filter", action="append", default=[])
    q.add_argument("--traverse", action="append", default=[])
    q.add_argument("--exclude-type", action="append", default=[])
    q.add_argument("--exclude-commit", action="append", default=[])
    q.add_argument("--negative", default="")
    q.add_argument("--min-score", type=float, default=0.0)
    q.add_argument("--top", type=int, default=5)
    q.add_argument("--offset", type=int, default=0)
    q.add_argument("--limit", type=int, help="results shown of those ranked")
    for flag in ("semantic-only", "all-matches", "all-files"):
        q.add_argument(f"--{flag}", action="store_true")
    t = sub.add_parser("tree")
    t.add_argument("node")
    t.add_argument("--max-depth", type=int, default=0)
    t.add_argument("--query", default="")
    sub.add_parser("history").add_argument("function")
    sub.add_parser("dependencies").add_argument("node")
    sub.add_parser("types").add_argument("kind", choices=["node", "edge"])
    m = sub.add_parser("amend")
    m.add_argument("action")
    m.add_argument("entity_type")
    m.add_argument("payload", type=json.loads)
    sub.add_parser("prepare", help="make the folder and check the session")
    sub.add_parser("serve", help="answer tool calls, a JSON object a line")
    a = p.parse_args(args)
    engine = Engine(local_session("*"), a.graph, overwrite=getattr(a, "overwrite", False))
    if a.command == "build":
        print(engine.index(a.repositories, skip_bots=not a.with_bots, cache=a.cache, token=a.token), "nodes")
    elif a.command == "query":
        print(engine.text(engine.query(a.query, a.repo, a.depth, a.traverse, a.exclude_type, a.semantic_only, a.min_score, a.top, a.filter, a.all_matches, a.all_files, a.exclude_commit, a.offset, a.negative, limit=a.limit)))
    elif a.command == "tree":
        for r in engine.syntax_tree(a.node, a.max_depth, a.query):
            print("  " * r["depth"] + r["type"], r["text"] or "")
    elif a.command == "history":
        print(engine.history(a.function))
    elif a.command == "dependencies":
        for r in engine.dependencies(a.node).collect():
            print(r["direction"], r["edge_type"], r["other_type"], r["name"])
    elif a.command == "types":
        print("\n".join(engine.node_types() if a.kind == "node" else engine.edge_types()))
    elif a.command == "prepare":
        print(f"{engine.catalog.root}: Spark {engine.spark.version}, {engine.catalog.count_nodes()} nodes")
    elif a.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
    else:
        print(engine.amend(a.action, a.entity_type, a.payload))


if __name__ == "__main__":
    main()
