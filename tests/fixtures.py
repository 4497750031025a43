"""The demonstration repository as rows and as a graph, and a graph by hand."""

from __future__ import annotations

import json

from codegraph.demo import SOURCES, URI, make_checkout, source_files

__all__ = ["SOURCES", "URI", "base_graph", "files", "graph", "make_checkout", "write_graph"]


def files(spark, commit: str = "c1", uri: str = URI, sources: dict | None = None):
    return source_files(spark, commit, uri, sources)


def graph(spark, commit: str = "c1"):
    from codegraph.operators import build, classify, extract

    nodes, edges = build.build_graph(extract.records(classify.stored(files(spark, commit))).persist())
    return nodes.persist(), edges.persist()  # every check and query reads them again


def base_graph() -> dict:
    """The smallest graph that has every node type but a class, and is valid."""
    node = lambda i, kind, **properties: {"id": i, "type": kind, "properties": properties}
    edge = lambda source, kind, target: {"source": source, "type": kind, "target": target, "properties": {}}
    origin = {"source_id": "u", "snapshot_id": "c"}
    return {
        "schema_version": 1,
        "nodes": [
            node("repo", "Repository", uri="u"), node("rev", "Revision", commit="c"), node("f", "File", path="a.cpp", name="a.cpp", provenance=origin),
            node("fn", "Function", name="ebb", qualified_name="ebb"), node("call", "CallSite", callee="x"),
        ],
        "edges": [edge("repo", "HAS_REVISION", "rev"), edge("rev", "CONTAINS", "f"), edge("f", "DEFINES", "fn"), edge("f", "CONTAINS", "call"), edge("fn", "HAS_CALL_SITE", "call")],
    }


def write_graph(path: str, **changes) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(base_graph() | changes, out)
