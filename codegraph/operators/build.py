"""Model records to a typed property graph with global identities."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import identity
from .classify import BadInput, fail_on


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def bad_span(span: Column) -> Column:
    ok = (span["start_byte"] >= 0) & (span["start_byte"] <= span["end_byte"]) & (span["start_line"] >= 0) & (span["start_line"] <= span["end_line"])
    return ~F.coalesce(ok, F.lit(False))


def invalid_records(records: DataFrame) -> DataFrame:
    """The records that break the contract, with a reason."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    file, code = F.col("file"), F.col("code")
    is_code = F.col("model_type") == "code"
    parser = F.lit(False)
    for name in ("name", "runtime_version", "grammar", "grammar_version", "extractor_version"):
        parser = parser | code["parser"][name].isNull()
    any_bad = lambda array, test: F.coalesce(F.exists(array, test), F.lit(False))
    known = F.transform(code["functions"], lambda f: f["id"])
    reason = (
        F.when(empty(F.col("artifact_id")), "artifact_id")
        .when(~F.coalesce(F.col("model_type").isin("code", "document"), F.lit(False)), "model_type")
        .when(empty(file["provenance"]["source_id"]) | empty(file["provenance"]["snapshot_id"]), "provenance")
        .when(empty(file["path"]), "path")
        .when(is_code & ~code["schema_version"].eqNullSafe(F.lit(2)), "schema_version")
        .when(is_code & parser, "parser")
        .when(is_code & ~F.coalesce(code["parse_status"].isin("complete", "partial"), F.lit(False)), "parse_status")
        .when(is_code & (code["functions"].isNull() | code["calls"].isNull() | code["classes"].isNull()), "arrays")
        .when(~is_code & F.col("sections").isNull(), "sections")
        .when(is_code & (F.size(F.array_distinct(known)) < F.size(known)), "duplicate function")
        .when(is_code & (any_bad(code["functions"], lambda x: bad_span(x["span"])) | any_bad(code["classes"], lambda x: bad_span(x["span"])) | any_bad(code["calls"], lambda x: bad_span(x["span"]))), "span")
        .when(is_code & any_bad(code["calls"], lambda c: ~c["resolution_status"].eqNullSafe(F.lit("unresolved"))), "resolved call")
        .when(is_code & any_bad(code["calls"], lambda c: (c["caller_id"] != "") & ~F.array_contains(known, c["caller_id"])), "unknown caller")
    )
    return records.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def with_file_id(records: DataFrame) -> DataFrame:
    f = F.col("file")
    version = F.when(F.col("model_type") == "code", F.col("code")["parser"]["extractor_version"]).otherwise("")
    return records.withColumn("file_id", identity(f["provenance"]["source_id"], f["provenance"]["snapshot_id"], f["path"], F.col("model_type"), version))


def _leaves(kind: T.StructType, at: Column | None = None) -> list[Column]:
    """A struct's fields, those of structs inside it in their place, each with whether it is null."""
    out = []
    for f in kind.fields:
        own = F.col(f"`{f.name}`") if at is None else at[f.name]
        out += [own.isNull(), *_leaves(f.dataType, own)] if isinstance(f.dataType, T.StructType) else [own]
    return out


def _rebuilt(kind: T.DataType, at: Iterator[int]) -> Column:
    """The column whose leaves are numbered from the next of `at` on."""
    own = F.col(f"_{next(at)}")
    if not isinstance(kind, T.StructType):
        return own
    return F.when(~own, F.struct(*(_rebuilt(f.dataType, at).alias(f.name) for f in kind.fields)))


def distinct_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records once each by file id, and the file ids that name different records."""
    keyed = with_file_id(records)
    digest = F.unhex(F.sha2(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}), 256))
    grouped = keyed.withColumn("_record", digest).groupBy("file_id").agg(F.count_distinct("_record").alias("versions"))
    # a digest has one record, hence one file; the fields of a struct go apart through the shuffle, so unread ones stay behind
    flat = records.select(F.substring(digest, 1, 16).alias("_record"), *(c.alias(f"_{i}") for i, c in enumerate(_leaves(records.schema))))
    dealt = flat.repartition("_record").dropDuplicates(["_record"])
    at = iter(range(len(flat.columns)))
    once = with_file_id(dealt.select(*(_rebuilt(f.dataType, at).alias(f.name) for f in records.schema.fields)))
    return once, grouped.filter("versions > 1")


def graph_nodes(records: DataFrame) -> DataFrame:
    """(id, type, properties) of distinct valid records; equal nodes once."""
    f, code, prov = F.col("file"), F.col("code"), F.col("file")["provenance"]
    base = records.select(identity(prov["source_id"]).alias("id"), F.lit("Repository").alias("type"), _json(F.struct(prov["source_id"].alias("uri"))).alias("properties")).distinct()
    revisions = records.select(identity(prov["source_id"], prov["snapshot_id"]).alias("id"), F.lit("Revision").alias("type"), _json(F.struct(prov["snapshot_id"].alias("commit"))).alias("properties")).distinct()
    plain = F.struct("artifact_id", "model_type", "file.*")
    parsed = F.struct("artifact_id", "model_type", "file.*", code["parser"].alias("parser"), code["parse_status"].alias("parse_status"), code["diagnostics"].alias("diagnostics"))
    files = records.select(F.col("file_id").alias("id"), F.lit("File").alias("type"), F.when(F.col("model_type") == "code", _json(parsed)).otherwise(_json(plain)).alias("properties"))
    parts = [base, revisions, files]
    for kind, array in (("Function", "functions"), ("Class", "classes"), ("CallSite", "calls")):
        items = records.filter("model_type = 'code'").select("file_id", F.explode(code[array]).alias("item"))
        parts.append(items.select(symbol_id(kind, F.col("file_id"), F.col("item")["id"]).alias("id"), F.lit(kind).alias("type"), _json(F.col("item")).alias("properties")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def symbol_id(kind: str, file_id: Column, local: Column) -> Column:
    return identity(F.lit(kind.lower()), file_id, local)


def graph_edges(records: DataFrame) -> DataFrame:
    """(source, type, target, properties), each once."""
    code, prov = F.col("code"), F.col("file")["provenance"]
    repo, revision = identity(prov["source_id"]), identity(prov["source_id"], prov["snapshot_id"])

    def edge(source: Column, kind: str, target: Column) -> list[Column]:
        return [source.alias("source"), F.lit(kind).alias("type"), target.alias("target")]

    own = records.filter("model_type = 'code'")
    parts = [records.select(*edge(repo, "HAS_REVISION", revision)), records.select(*edge(revision, "CONTAINS", F.col("file_id")))]
    for kind, array, relation in (("Function", "functions", "DEFINES"), ("Class", "classes", "DEFINES"), ("CallSite", "calls", "CONTAINS")):
        items = own.select("file_id", F.explode(code[array]).alias("item"))
        parts.append(items.select(*edge(F.col("file_id"), relation, symbol_id(kind, F.col("file_id"), F.col("item")["id"]))))
    calls = own.select("file_id", F.explode(code["calls"]).alias("item")).filter(F.col("item")["caller_id"] != "")
    parts.append(calls.select(*edge(symbol_id("Function", F.col("file_id"), F.col("item")["caller_id"]), "HAS_CALL_SITE", symbol_id("CallSite", F.col("file_id"), F.col("item")["id"]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct().withColumn("properties", F.lit("{}"))


def build_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of model records; bad or conflicting ones raise before anything is returned."""
    numbered = records if "record" in records.columns else records.withColumn("record", F.lit(None).cast("long"))
    fail_on(invalid_records(numbered), "Invalid record", "reason", "artifact_id", order="record")
    once, conflicts = distinct_records(records.drop("record"))
    fail_on(conflicts, "Conflicting file records", "file_id", order="file_id")
    nodes = graph_nodes(once)
    fail_on(nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "Conflicting node", "id", order="id")
    return nodes, graph_edges(once)


def ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The deterministic order of an export: nodes by id, edges by their JSON key."""
    # a column: the sort would make an expression anew in every comparison; all keys begin with the same two characters
    keyed = edges.withColumn("_key", F.substring(F.to_json(F.array("source", "type", "target")), 3, 1 << 30))
    return nodes.orderBy("id"), keyed.orderBy("_key").drop("_key")


def placed(rows: DataFrame) -> DataFrame:
    """Rows in the order of an orderBy, with their `place` from 1 on.

    Each partition of the range sort numbers its own rows and adds the rows of
    the partitions before it, so no task sees all rows.
    """
    at = F.monotonically_increasing_id()  # partition in the upper 31 bits, row in the lower 33
    numbered = rows.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).persist()
    before, total = [], 0
    for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        before.append((r["_part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    return numbered.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write one graph.json of a (bounded) repository graph; an existing file is never overwritten."""
    import json
    import os

    n, e = ordered(nodes, edges)
    graph = {
        "edges": [{"properties": json.loads(r.properties), "source": r.source, "target": r.target, "type": r.type} for r in e.toLocalIterator()],
        "nodes": [{"id": r.id, "properties": json.loads(r.properties), "type": r.type} for r in n.toLocalIterator()],
        "schema_version": 1,
    }
    try:
        with open(path, "x", encoding="utf-8") as out:
            json.dump(graph, out, indent=2, sort_keys=True, ensure_ascii=False)
            out.write("\n")
    except FileExistsError as error:
        raise BadInput(f"{path} exists") from error
    except BaseException:
        os.unlink(path)
        raise
