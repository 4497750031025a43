"""Queries over a selected graph: describe, status, symbol search, bounded traversal.

A graph is the dict that validate.select_graph returns.  Traversals are hop
loops: every hop is one join of the frontier with the edges, ranked in the
breadth-first order of emission, so cuts at a limit are exact prefixes of that
order.  Frontiers are bounded by the limits, never collected; reach has no limit
and keeps them distributed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import casefold
from ..schemas import RELATION_NAMES
from ..storage import stored
from .classify import BadInput
from .validate import prop

MAX_VISITED = 5000
EXACT_SCORE = 1000


class Unsupported(NotImplementedError):
    """Something the graph can't answer by design."""


def relation_set(requested: list[str] | None, required: bool = False) -> list[str]:
    """The relations to follow; none named means all, unless naming them is required."""
    if requested is not None and (not isinstance(requested, list) or not all(isinstance(r, str) for r in requested)):
        raise BadInput("relations must be a list of names")
    if required and not requested:
        raise BadInput("name the relations to follow")
    unknown = sorted(set(requested or ()) - set(RELATION_NAMES))
    if unknown:
        raise Unsupported(f"Unsupported relations: {unknown}")
    return sorted(set(requested)) if requested else list(RELATION_NAMES)


def describe(graph: dict, node_id: str | None = None) -> DataFrame:
    """(id, type, properties, path) of one node or all; path is that of the owning file."""
    nodes = graph["nodes"] if node_id is None else graph["nodes"].filter(F.col("id") == node_id)
    own = graph["owners"].select(F.col("node").alias("id"), "path")
    return nodes.join(own, "id", "left").select("id", "type", "properties", "path")


def _part(graph: dict, ids: DataFrame) -> dict:
    """A graph with the nodes and owners of ids(id) only: what is described is cut down before it is joined."""
    own = graph["owners"].join(ids.select(F.col("id").alias("node")), "node", "left_semi")
    return graph | {"nodes": graph["nodes"].join(ids, "id", "left_semi"), "owners": own}


def known(graph: dict, node_id: str) -> None:
    if not graph["nodes"].filter(F.col("id") == node_id).limit(1).collect():
        raise BadInput(f"Unknown node ID: {node_id}")


def status(graph: dict) -> DataFrame:
    """One row: counts of nodes, edges and file paths, the paths of partial parses, the relations."""
    files = graph["nodes"].filter("type = 'File'")
    partial = prop(F.col("properties"), "parse_status") == "partial"
    path = prop(F.col("properties"), "path")
    per_file = files.agg(F.count_distinct(path).alias("files"), F.sort_array(F.collect_set(F.when(partial, path))).alias("partial_files"))
    return per_file.join(graph["nodes"].agg(F.count("*").alias("nodes")), F.lit(True)).join(graph["edges"].agg(F.count("*").alias("edges")), F.lit(True)).withColumn("supported_relations", F.array(*map(F.lit, RELATION_NAMES)))


def symbol_scores(symbols: DataFrame, query: str, path_filter: str = "", exact_fold: bool = True) -> DataFrame:
    """Scores of symbols(id, type, name, qualified_name, signature, own_path, path): exact hits and term counts.

    Exact means a case-sensitive match of the whole query on id, name or
    qualified name; else every term that the folded names contain counts, as
    often as the query has it.
    """
    ranked = symbols.filter(F.col("type").isin("Function", "Class", "File"))
    if path_filter:
        ranked = ranked.filter(F.coalesce(F.col("path"), F.lit("")).contains(path_filter))
    whole = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "qualified_name", "signature", "own_path")))
    hit = lambda c: F.coalesce(F.col(c) == query, F.lit(False))
    exact = hit("id") | hit("name") | hit("qualified_name")
    score: Column = F.lit(0)
    for term in re.findall(r"[a-z0-9_]+", query.casefold()):
        score = score + F.when(F.col("_text").contains(term), 1).otherwise(0)
    out = ranked.withColumn("_text", casefold(whole, exact_fold)).withColumn("exact", exact)
    return out.withColumn("score", F.when(F.col("exact"), EXACT_SCORE).otherwise(score)).drop("_text").filter("score > 0")


def symbols_of(graph: dict) -> DataFrame:
    p = F.col("properties")
    text = lambda name: F.coalesce(prop(p, name), F.when(F.array_contains(F.json_object_keys(p), name), F.lit("None")), F.lit(""))
    return describe(graph).withColumns({"name": text("name"), "qualified_name": text("qualified_name"), "signature": text("signature"), "own_path": text("path")})


def name_index(symbols: DataFrame, column: str = "name") -> DataFrame:
    """(name, n): how many symbols of a graph bear each name; an index that tells ambiguous ones."""
    return symbols.filter(F.col(column) != "").groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


def find_symbols(graph: dict, query: str, path_filter: str = "", limit: int = 10) -> dict:
    """matches (a DataFrame in rank order), ambiguous and truncated."""
    found = symbol_scores(symbols_of(graph), query, path_filter)
    row = found.agg(F.count("*").alias("n"), F.count_if("exact").alias("exact")).first()
    top = found.orderBy(F.desc("score"), "id").limit(limit).select("id", "type", "properties", "path", "score")
    return {"matches": top, "ambiguous": row["exact"] > 1, "truncated": row["n"] > limit}


def steps(edges: DataFrame, frontier: DataFrame, allowed: list[str], direction: str = "out") -> DataFrame:
    """(node, neighbor, source, target, type, …frontier) of all edges at the frontier(node, …)."""
    if direction not in ("out", "in", "both"):
        raise BadInput("direction must be out, in or both")
    kept = edges.filter(F.col("type").isin(allowed)).select("source", "target", "type", "properties")
    parts = []
    if direction in ("out", "both"):
        parts.append(frontier.join(kept, F.col("node") == F.col("source")).withColumn("neighbor", F.col("target")))
    if direction in ("in", "both"):
        parts.append(frontier.join(kept, F.col("node") == F.col("target")).withColumn("neighbor", F.col("source")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def levels(graph: dict, start: str, allowed: list[str], direction: str = "out", depth: int = 1, until: str | None = None) -> DataFrame:
    """(node, hops) of all nodes within `depth` hops of start, itself included, without a limit; no hop goes beyond `until`."""
    known(graph, start)
    frontier = graph["nodes"].sparkSession.sql("SELECT :start AS node", {"start": start})  # of known size, so edges aren't shuffled to meet it
    visited = frontier.withColumn("hops", F.lit(0).cast("long"))
    for hop in range(1, depth + 1):
        found = steps(graph["edges"], frontier, allowed, direction).select(F.col("neighbor").alias("node")).distinct()
        frontier = stored(found.join(visited, "node", "left_anti"), "level")  # a plan of all hops would grow with their product
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier.withColumn("hops", F.lit(hop).cast("long")))
        if until is not None and frontier.filter(F.col("node") == until).limit(1).collect():
            break
    return visited


def reach(graph: dict, start: str, allowed: list[str], direction: str = "out", depth: int = 1) -> DataFrame:
    """The nodes within `depth` hops of start."""
    return describe(_part(graph, levels(graph, start, allowed, direction, depth).select(F.col("node").alias("id"))))


def neighborhood(graph: dict, start: str, allowed: list[str], direction: str = "out", depth: int = 1, limit: int = 30) -> dict:
    """Edges in breadth-first order up to `limit`, the nodes they reach, and whether more edges exist.

    Emission order: frontier nodes in the order they were found, the edges of
    one by (source, target, type), each edge once.
    """
    known(graph, start)
    spark = graph["nodes"].sparkSession
    key = ["source", "target", "type"]
    frontier = spark.createDataFrame([(start, 0)], "node string, place int")
    visited, emitted, n = frontier.select("node"), None, 0
    for hop in range(depth):
        # the frontier, what is emitted and what is visited are bounded by the limit; the edges stay where they are
        found = steps(graph["edges"], F.broadcast(frontier), allowed, direction)
        # the same edge may be met from both ends: its first meeting counts
        first = Window.partitionBy(*key).orderBy("place", *key)
        found = found.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
        if emitted is not None:
            found = found.join(F.broadcast(emitted.select(*key)), key, "left_anti")
        # the order needs limit + 1 rows only, so the global rank is over a bounded table
        found = found.orderBy("place", *key).limit(limit + 1 - n).withColumn("rank", F.row_number().over(Window.orderBy("place", *key)))
        found = found.withColumn("hop", F.lit(hop)).select("hop", "rank", *key, "properties", "neighbor")
        found = spark.createDataFrame(found.collect(), found.schema)  # at most limit + 1 rows
        emitted = found if emitted is None else emitted.unionByName(found)
        n += found.count()
        fresh = found.groupBy("neighbor").agg(F.min("rank").alias("place")).join(F.broadcast(visited), F.col("neighbor") == F.col("node"), "left_anti")
        frontier = fresh.select(F.col("neighbor").alias("node"), "place")
        visited = visited.unionAll(frontier.select("node"))
        if n > limit or not frontier.limit(1).collect():
            break
    edges = emitted.orderBy("hop", "rank").limit(limit)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).unionAll(spark.createDataFrame([(start,)], "id string")).distinct()
    return {"nodes": describe(_part(graph, F.broadcast(nodes))).orderBy("id"), "edges": edges.select(*key, "properties"), "depth": depth, "truncated": n > limit}


def shortest_path(graph: dict, source: str, target: str, allowed: list[str], max_hops: int, max_visited: int | None = None) -> dict:
    """A directed path of fewest edges with the first discoverer as parent, or not found.

    With `max_visited` the search counts visited nodes in discovery order and
    ends, not found and truncated, where a node beyond it would be added;
    without it the whole graph is searched.
    """
    known(graph, source)
    known(graph, target)
    if max_visited is None:
        return _shortest_of_all(graph, source, target, allowed, max_hops)
    spark = graph["nodes"].sparkSession
    key = ["source", "target", "type"]
    levels: list[dict] = [{source: None}]
    seen, truncated = {source}, False
    while target not in levels[-1] and levels[-1] and len(levels) <= max_hops and not truncated:
        # frontier and visited nodes are bounded by max_visited; the edges stay distributed
        frontier = spark.createDataFrame([(n, i) for i, n in enumerate(levels[-1])], "node string, place long")
        old = spark.createDataFrame([(n,) for n in seen], "neighbor string")
        found = steps(graph["edges"], F.broadcast(frontier), allowed).join(F.broadcast(old), "neighbor", "left_anti")
        first = Window.partitionBy("neighbor").orderBy("place", *key)
        found = found.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
        rows = found.orderBy("place", *key).limit(max_visited + 1 - len(seen)).select("neighbor", "node", *key, "properties").collect()
        level: dict = {}
        for r in rows:
            if len(seen) >= max_visited:
                truncated = True
                break
            seen.add(r["neighbor"])
            level[r["neighbor"]] = (r["node"], (r["source"], r["target"], r["type"], r["properties"]))
        levels.append(level)
        if truncated:
            break
    if target in levels[-1] and target != source and len(levels) <= max_hops and not truncated:
        # the nodes found before the target are expanded before its turn comes, which may use up the visits
        ahead = list(levels[-1])[: list(levels[-1]).index(target)]
        if ahead:
            frontier = spark.createDataFrame([(n, i) for i, n in enumerate(ahead)], "node string, place long")
            old = spark.createDataFrame([(n,) for n in seen], "neighbor string")
            fresh = steps(graph["edges"], F.broadcast(frontier), allowed).join(F.broadcast(old), "neighbor", "left_anti").select("neighbor").distinct()
            truncated = fresh.limit(max_visited + 1 - len(seen)).count() > max_visited - len(seen)
            if truncated:
                return {"nodes": None, "edges": None, "found": False, "truncated": True, "max_hops": max_hops, "visited": max_visited}
    if target in levels[-1] and not (truncated and target != source):
        path, at = [], target
        for level in reversed(levels[1:]):
            parent, edge = level[at]
            path.append(edge)
            at = parent
        path.reverse()
        return _found(graph, source, path)
    return {"nodes": None, "edges": None, "found": False, "truncated": truncated, "max_hops": max_hops, "visited": len(seen)}


def _found(graph: dict, source: str, path: list[tuple]) -> dict:
    spark = graph["nodes"].sparkSession
    place = spark.createDataFrame(list(enumerate([source, *(e[1] for e in path)])), "place int, id string")
    nodes = describe(graph).join(F.broadcast(place), "id").orderBy("place").drop("place")
    return {"nodes": nodes, "edges": spark.createDataFrame(path, "source string, target string, type string, properties string"), "found": True, "truncated": False}


def _shortest_of_all(graph: dict, source: str, target: str, allowed: list[str], max_hops: int) -> dict:
    """The path that a breadth-first search finds, whatever it has to visit; levels stay distributed.

    Discovery order is the order of the paths by their edges, so the first
    discovered path goes, hop by hop, to the smallest node that is one hop
    nearer to the target.
    """
    near = levels(graph, target, allowed, "in", 0 if source == target else max_hops, until=source)
    first = near.filter(F.col("node") == source).select("hops").collect()
    if not first:
        return {"nodes": None, "edges": None, "found": False, "truncated": False, "max_hops": max_hops, "visited": levels(graph, source, allowed, "out", max_hops).count()}
    path, at = [], source
    for hops in range(first[0]["hops"] - 1, -1, -1):
        ways = graph["edges"].filter((F.col("source") == at) & F.col("type").isin(allowed)).join(near.filter(F.col("hops") == hops), F.col("target") == F.col("node"), "left_semi")
        edge = ways.orderBy("target", "type").limit(1).select("source", "target", "type", "properties").collect()[0]
        path.append(tuple(edge))
        at = edge["target"]
    return _found(graph, source, path)
