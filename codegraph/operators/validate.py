"""Checks of a property graph: each is a DataFrame of violations, empty if all is well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_path
from ..schemas import NODE_TYPES, RELATION_NAMES, RELATIONS
from ..storage import stored
from .classify import BadInput, fail_on


#: Reads the rows whose column a field of hashes leaves, from where that is cheaper than sifting all.
Reader = Callable[[str, DataFrame], DataFrame]
#: Words of 64 bits in a field of hashes; the field is broadcast, so its size is fixed.
FIELD_WORDS = 1 << 20


def _word(h: str) -> str:
    return f"({h} & {FIELD_WORDS - 1}L)"


def _bits(h: str) -> str:
    """Four bits of a word: with one, what passes by chance would grow with the square of the input."""
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftright({h}, {n}) & 63 as int))" for n in (20, 26, 32, 38)) + ")"


def field_of(ids: DataFrame, column: str) -> DataFrame:
    """(_word, _bits): four bits for the hash of every id, in at most FIELD_WORDS rows."""
    return _field(ids.select(F.xxhash64(column).alias("_hash")), "_hash")


def sifted(rows: DataFrame, column: str, field: DataFrame) -> DataFrame:
    """The rows whose column may be among the ids of a field: all that are, and a few others.

    A broadcast semi join, which the optimizer moves to the tables below unions
    and joins, so that rows which can't match are never shuffled.
    """
    h = f"xxhash64({column})"
    return rows.join(F.broadcast(field), F.expr(f"{_word(h)} = _word AND ({_bits(h)} & ~_bits) = 0"), "left_semi")


def among(rows: DataFrame, column: str, ids: DataFrame, name: str, field: DataFrame | None = None) -> DataFrame:
    """The rows whose column is among ids.name: a semi join of what a field of hashes leaves."""
    kept = sifted(rows, column, field_of(ids, name) if field is None else field)
    return kept.join(ids.select(F.col(name).alias("_among")), F.col(column) == F.col("_among"), "left_semi")


def prop(properties: Column, name: str) -> Column:
    return F.get_json_object(properties, f"$.{name}")


def _relations(edges: DataFrame) -> DataFrame:
    """The fixed table of six rows."""
    return edges.sparkSession.createDataFrame(list(RELATIONS), "type string, source_type string, target_type string")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def bad_nodes(nodes: DataFrame) -> DataFrame:
    """Empty ids, unknown types, properties that are no object."""
    known = F.col("type").isin(*NODE_TYPES)
    return nodes.filter((F.coalesce(F.col("id"), F.lit("")) == "") | ~F.coalesce(known, F.lit(False)) | F.json_object_keys("properties").isNull()).select("id", "type")


def bad_edges(edges: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return edges.filter(blank("source") | blank("target") | blank("type") | F.json_object_keys("properties").isNull()).select("source", "type", "target")


def _code(column: str, names: tuple[str, ...]) -> Column:
    """The place of a value among names, from 1 on; 0 if it isn't one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(column)), F.lit(0)).cast("byte")


def _field(hashes: DataFrame, column: str) -> DataFrame:
    """The field of ids whose hashes are known."""
    bits = hashes.select(F.expr(_word(column)).alias("_word"), F.expr(_bits(column)).alias("_bits"))
    return bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("source", "type", "target", F.explode(F.array("source", "target")).alias("id"))


def dangling_edges(nodes: DataFrame, edges: DataFrame, read: Reader | None = None) -> DataFrame:
    """Edges with an end that no node is.

    Of all ends only two hashes of 64 bits are shuffled.  The edges with a hash
    that no node has are read again, `read` being a cheaper way to those that a
    field leaves, and compared by the ids themselves.
    """
    read = read or (lambda role, field: sifted(edges, role, field))
    pair = lambda c: (F.xxhash64(c).alias("_a"), F.xxhash64(F.lit(1), c).alias("_b"))
    ends = edges.select(F.explode(F.array(*(F.struct(*pair(c), F.lit(c == "target").alias("_target")) for c in ("source", "target")))).alias("_end")).select("_end.*")
    lost = stored(ends.join(nodes.filter(F.col("id").isNotNull()).select(*pair("id")), ["_a", "_b"], "left_anti").select("_a", "_target").distinct(), "lost-ends")
    found = edges.select("source", "type", "target").limit(0)
    for role in ("source", "target"):
        own = lost.filter(F.col("_target") == (role == "target"))
        if not own.isEmpty():
            found = found.unionAll(read(role, _field(own, "_a")).select("source", "type", "target"))
    found = _ends(stored(found, "lost-edges"))
    near = sifted(nodes.select("id"), "id", field_of(found, "id"))
    return found.join(near, "id", "left_anti").select("source", "type", "target").distinct()


def typed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select("id", "type")
    return edges.select("source", "type", "target").join(kinds.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(kinds.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")


def bad_relations(nodes: DataFrame, edges: DataFrame, read: Reader | None = None) -> DataFrame:
    """Edges whose relation is unknown or doesn't allow the types of their ends.

    All edges are first judged by hashes of their ends: equal ids have equal
    hashes, so no bad edge is missed.  The edges to a target of a bad one are
    read again, `read` being a cheaper way to those that a field leaves, and
    judged by the ids themselves.
    """
    read = read or (lambda role, field: sifted(edges, role, field))
    kinds = nodes.filter(F.col("id").isNotNull()).select(F.xxhash64("id").alias("_id"), _code("type", NODE_TYPES).alias("_kind"))
    rows = edges.filter("source IS NOT NULL AND target IS NOT NULL").select(F.xxhash64("source").alias("_source"), F.xxhash64("target").alias("_target"), _code("type", RELATION_NAMES).alias("_relation"))
    from_kind = rows.join(kinds, F.col("_source") == F.col("_id")).select("_target", "_relation", F.col("_kind").alias("_from"))
    both = from_kind.join(kinds, F.col("_target") == F.col("_id"))
    allowed = [10_000 * (RELATION_NAMES.index(r) + 1) + 100 * (NODE_TYPES.index(s) + 1) + NODE_TYPES.index(t) + 1 for r, s, t in RELATIONS]
    bad = both.filter(~(F.col("_relation").cast("int") * 10_000 + F.col("_from").cast("int") * 100 + F.col("_kind")).isin(*allowed)).select("_target").distinct()
    found = stored(read("target", _field(stored(bad, "bad-targets"), "_target")).select("source", "type", "target"), "bad-edges")
    near = sifted(nodes.select("id", "type"), "id", field_of(_ends(found), "id"))
    return typed(near, found).join(F.broadcast(_relations(edges)), ["type", "source_type", "target_type"], "left_anti")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "type").agg(F.count("*").alias("n")).filter("n > 1")


def revision_owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(revision, commit, parents, repositories, repository, uri) of all revisions; the few edges to them are stored first."""
    revisions = nodes.filter("type = 'Revision'").select(F.col("id").alias("revision"), prop(F.col("properties"), "commit").alias("commit"))
    # only edges to revisions are of interest, and of the nodes only their sources
    links = stored(among(edges, "target", revisions, "revision").select(F.col("target").alias("revision"), "source").distinct(), "revision-links")
    sources = among(nodes, "id", links, "source")
    above = links.join(sources.select(F.col("id").alias("source"), F.col("type").alias("kind"), prop(F.col("properties"), "uri").alias("uri")), "source").distinct()
    return revisions.join(above, "revision", "left").groupBy("revision", "commit").agg(
        F.count("source").alias("parents"), F.count_if(F.col("kind") == "Repository").alias("repositories"), F.min("source").alias("repository"), F.min("uri").alias("uri")
    )


def bad_revisions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Revisions without exactly one predecessor, a Repository with a URI, or without a commit."""
    ok = (F.col("parents") == 1) & (F.col("repositories") == 1) & (F.coalesce("uri", F.lit("")) != "") & (F.coalesce("commit", F.lit("")) != "")
    return revision_owners(nodes, edges).filter(~ok).select("revision", "parents", "repositories")


def select_revision(nodes: DataFrame, edges: DataFrame, uri: str | None = None, commit: str | None = None) -> tuple[str, str, str, str]:
    """(uri, commit, repository id, revision id) of the one revision that the filters leave."""
    choices = revision_owners(nodes, edges)
    wanted = choices
    if uri is not None:
        wanted = wanted.filter(F.col("uri") == uri)
    if commit is not None:
        wanted = wanted.filter(F.col("commit") == commit)
    found = wanted.select("uri", "commit", "repository", "revision").limit(2).collect()
    if len(found) != 1:
        shown = [tuple(r) for r in choices.select("uri", "commit").distinct().orderBy("uri", "commit").limit(100).collect()]
        raise BadInput(f"Select one repository and revision; available: {shown}")
    return tuple(found[0])


def files_of(nodes: DataFrame, edges: DataFrame, revision: str) -> DataFrame:
    """The files of a revision, which contains nothing else in a valid graph."""
    below = sifted(edges.filter(F.col("source") == revision), "target", field_of(nodes.filter("type = 'File'"), "id"))
    return below.select(F.col("target").alias("file")).distinct()


def shared_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files with more than one predecessor."""
    above = among(edges, "target", files, "file").select(F.col("target").alias("file"), "source").distinct()
    return above.groupBy("file").agg(F.count("*").alias("parents")).filter("parents > 1")


def bad_files(nodes: DataFrame, files: DataFrame, uri: str, commit: str) -> DataFrame:
    """Selected files with an unsafe path or another provenance."""
    own = nodes.join(files.select(F.col("file").alias("id")), "id", "left_semi")
    p = F.col("properties")
    path = F.coalesce(prop(p, "path"), F.lit(""))
    same = prop(p, "provenance.source_id").eqNullSafe(F.lit(uri)) & prop(p, "provenance.snapshot_id").eqNullSafe(F.lit(commit))
    return own.filter(~safe_path(path) | ~same).select("id", path.alias("path"), same.alias("same_provenance"))


def owners(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node, file) of the files and what they contain or define."""
    below = among(edges, "source", files, "file").select(F.col("target").alias("node"), F.col("source").alias("file"))
    return files.select(F.col("file").alias("node"), "file").unionAll(below).distinct()


def shared_symbols(owned: DataFrame) -> DataFrame:
    return owned.groupBy("node").agg(F.count_distinct("file").alias("files")).filter("files > 1")


def stray_calls(edges: DataFrame, owned: DataFrame, read: Reader | None = None) -> DataFrame:
    """Call sites of owned callers that lie in another file or outside the selection; owned(node, file) may repeat rows.

    All calls are first judged by hashes of 64 bits.  Those to a call site of a
    stray one are compared by the ids themselves, with the owners of their
    ends; `read` is a cheaper way to the owned whose node a field leaves.
    """
    read = read or (lambda role, field: sifted(owned, role, field))
    calls = edges.filter("type = 'HAS_CALL_SITE'").select("source", "target")
    own = owned.filter(F.col("node").isNotNull()).select(F.xxhash64("node").alias("_node"), F.xxhash64("file").alias("_file"))
    rows = calls.filter(F.col("source").isNotNull()).select(F.xxhash64("source").alias("_source"), F.xxhash64("target").alias("_target"))
    called = rows.join(own, F.col("_source") == F.col("_node")).select("_target", F.col("_file").alias("_from"))
    strays = called.join(own, F.col("_target") == F.col("_node"), "left").filter(~F.col("_from").eqNullSafe(F.col("_file"))).select("_target").distinct()
    found = stored(sifted(calls, "target", _field(stored(strays, "stray-targets"), "_target")), "stray-calls")
    ends = found.select(F.explode(F.array("source", "target")).alias("node"))
    near = stored(read("node", field_of(ends, "node")).select("node", "file").distinct(), "stray-owners")
    caller = near.select(F.col("node").alias("source"), F.col("file").alias("source_file"))
    site = near.select(F.col("node").alias("target"), F.col("file").alias("target_file"))
    return found.join(caller, "source").join(site, "target", "left").filter(~F.col("source_file").eqNullSafe(F.col("target_file"))).select("source", "target")


def induced(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on the selected node ids."""
    ids = selected.select("node").distinct()
    field = field_of(ids, "node")
    kept = among(among(sifted(edges, "target", field), "source", ids, "node", field), "target", ids, "node", field)
    return among(nodes, "id", ids, "node", field), kept


def validate(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise for the first kind of violation in the whole graph."""
    fail_on(bad_nodes(nodes), "Invalid node", "id", "type", order="id")
    fail_on(duplicate_nodes(nodes), "Duplicate node", "id", order="id")
    fail_on(bad_edges(edges), "Invalid edge", "source", "type", "target", order="source")
    fail_on(dangling_edges(nodes, edges), "Dangling edge", "source", "target", order="source")
    fail_on(bad_relations(nodes, edges), "Invalid relationship", "type", "source", "target", order="source")
    fail_on(duplicate_edges(edges), "Duplicate relationship", "source", "target", "type", order="source")
    fail_on(bad_revisions(nodes, edges), "Each revision needs exactly one repository", "revision", order="revision")


def select_graph(nodes: DataFrame, edges: DataFrame, uri: str | None = None, commit: str | None = None) -> dict:
    """Validate and cut out one revision: uri, commit, nodes, edges and owners(node, file, path)."""
    validate(nodes, edges)
    uri, commit, repository, revision = select_revision(nodes, edges, uri, commit)
    files = files_of(nodes, edges, revision)
    fail_on(shared_files(edges, files), "File belongs to multiple revisions", "file", order="file")
    fail_on(bad_files(nodes, files, uri, commit), "Unsafe path or other provenance", "path", order="path")
    owned = owners(edges, files)
    fail_on(shared_symbols(owned), "Symbol belongs to multiple files", "node", order="node")
    fail_on(stray_calls(edges, owned), "Call site and caller must belong to the same file", "source", "target", order="source")
    ends = nodes.sparkSession.createDataFrame([(repository,), (revision,)], "node string")
    owned = owned.persist()
    kept, links = induced(nodes, edges, owned.select("node").unionAll(ends))
    kept, links = kept.persist(), links.persist()  # a session asks one graph many small questions
    paths = nodes.filter("type = 'File'").select(F.col("id").alias("file"), prop(F.col("properties"), "path").alias("path"))
    return {"uri": uri, "commit": commit, "nodes": kept, "edges": links, "owners": owned.join(paths, "file").persist()}
