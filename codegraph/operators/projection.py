"""Projection of model tasks into a second graph with task-scoped identities.

tasks(task_id, generation, source_uri, revision, path, name, code): code is a
model of version 2, or of version 1 (no local ids).  Nodes and edges come
distinct, so replaying a task changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import identity


def _file_id() -> Column:
    return F.concat(F.col("task_id").cast("string"), F.lit(":"), F.col("generation").cast("string"))


def _local(file_id: Column, item: Column, version: Column, legacy: str) -> Column:
    return F.concat(file_id, F.lit("::"), F.when(version >= 2, item["id"]).otherwise(item[legacy]))


def _items(tasks: DataFrame, array: str) -> DataFrame:
    return tasks.select(_file_id().alias("file_id"), F.col("code")["schema_version"].alias("version"), F.explode(F.col("code")[array]).alias("item"))


def functions_of(tasks: DataFrame) -> DataFrame:
    rows = _items(tasks, "functions")
    return rows.select("file_id", "version", _local(F.col("file_id"), F.col("item"), F.col("version"), "qualified_name").alias("id"), F.col("item")["name"].alias("name"), F.col("item")["id"].alias("local"), F.col("item")["qualified_name"].alias("qualified_name"))


def projection_nodes(tasks: DataFrame) -> DataFrame:
    """(id, label, name), each once; stub callees of version 1 included."""
    n = lambda df, label, i, name: df.select(i.alias("id"), F.lit(label).alias("label"), name.alias("name"))
    classes = _items(tasks, "classes")
    calls = _items(tasks, "calls").filter("version >= 2")
    parts = [
        n(tasks, "Repository", F.col("source_uri"), F.col("source_uri")),
        n(tasks, "Revision", identity(F.col("source_uri"), F.col("revision")), F.col("revision")),
        n(tasks, "File", _file_id(), F.col("path")),
        n(functions_of(tasks), "Function", F.col("id"), F.col("name")),
        n(classes, "Class", _local(F.col("file_id"), F.col("item"), F.col("version"), "name"), F.col("item")["name"]),
        n(calls, "CallSite", F.concat("file_id", F.lit("::"), F.col("item")["id"]), F.col("item")["callee"]),
        n(stub_callees(tasks), "Function", F.col("id"), F.col("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("id", "label").agg(F.max("name").alias("name"))


def projection_edges(tasks: DataFrame) -> DataFrame:
    """(source, type, target, line), each once; line is null but for CALLS."""
    e = lambda df, s, kind, t, line=None: df.select(s.alias("source"), F.lit(kind).alias("type"), t.alias("target"), F.lit(line).cast("long").alias("line"))
    fid, item, version = F.col("file_id"), F.col("item"), F.col("version")
    revision = identity(F.col("source_uri"), F.col("revision"))
    calls = _items(tasks, "calls").filter("version >= 2")
    owned = calls.filter(item["caller_id"] != "").select("file_id", "item", F.concat(fid, F.lit("::"), item["caller_id"]).alias("caller"))
    callers = functions_of(tasks).select(F.col("id").alias("caller")).distinct()
    parts = [
        e(tasks, F.col("source_uri"), "HAS_REVISION", revision),
        e(tasks, revision, "CONTAINS", _file_id()),
        e(functions_of(tasks), fid, "DEFINES", F.col("id")),
        e(_items(tasks, "classes"), fid, "DEFINES", _local(fid, item, version, "name")),
        e(calls, fid, "CONTAINS", F.concat(fid, F.lit("::"), item["id"])),
        e(owned.join(callers, "caller"), F.col("caller"), "HAS_CALL_SITE", F.concat(fid, F.lit("::"), item["id"])),
        legacy_calls(tasks).select(F.col("caller").alias("source"), F.lit("CALLS").alias("type"), F.col("callee").alias("target"), "line"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def legacy_calls(tasks: DataFrame) -> DataFrame:
    """Version 1 only: (caller, callee, line, name) of calls whose caller exists."""
    fid, item = F.col("file_id"), F.col("item")
    calls = _items(tasks, "calls").filter("version < 2").select(F.concat(fid, F.lit("::"), item["caller"]).alias("caller"), F.concat(fid, F.lit("::"), item["callee"]).alias("callee"), item["line"].alias("line"), item["callee"].alias("name"))
    return calls.join(functions_of(tasks).filter("version < 2").select(F.col("id").alias("caller")).distinct(), "caller").distinct()


def stub_callees(tasks: DataFrame) -> DataFrame:
    """Callees of version 1 calls that no file defines."""
    known = functions_of(tasks).select(F.col("id").alias("callee"))
    return legacy_calls(tasks).join(known, "callee", "left_anti").select(F.col("callee").alias("id"), "name").distinct()


def broken_uniqueness(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).filter("n > 1")
