import json

import pytest
from pyspark.sql import functions as F

from codegraph.operators import build, classify, extract, graph_query, projection, validate
from codegraph.operators.classify import BadInput
from codegraph.sources import snapshot

from . import fixtures


def test_classify_and_store(spark):
    odd = {".md": "x", "a.H": "x", "b.h": "x", "c.c": "x", "d.txt": "", "e.png": "\0"}
    rows = {r["path"]: r for r in classify.classify(fixtures.files(spark, sources=odd)).collect()}
    assert {p: r["model_type"] for p, r in rows.items()} == {".md": None, "a.H": None, "b.h": "code", "c.c": "code", "d.txt": "document", "e.png": None}
    assert rows["b.h"]["language"] == "C++" and rows["c.c"]["language"] == "C"
    assert classify.summary(fixtures.files(spark, sources=odd)).first()[:] == (3, 3)
    assert classify.stored(fixtures.files(spark, sources=odd)).count() == 3
    with pytest.raises(BadInput):
        classify.stored(fixtures.files(spark, sources={"x.txt": "a\0b"}))
    with pytest.raises(BadInput):
        classify.stored(fixtures.files(spark, commit=""))


def test_build_is_deterministic_and_dedupes(spark):
    records = extract.records(classify.stored(fixtures.files(spark)))
    nodes, edges = build.build_graph(records)
    again_nodes, again_edges = build.build_graph(records.unionAll(records).orderBy(F.rand(1)))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(nodes) == key(again_nodes) and key(edges) == key(again_edges)
    kinds = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}
    assert kinds == {"Repository": 1, "Revision": 1, "File": 5, "Function": 3, "CallSite": 1}
    assert edges.count() == 1 + 5 + 3 + 1 + 1
    validate.validate(nodes, edges)


def test_bad_records(spark):
    good = extract.records(classify.stored(fixtures.files(spark))).persist()
    code = good.filter("model_type = 'code'")
    for change in (
        {"artifact_id": F.lit("")},
        {"model_type": F.lit("image")},
        {"code": F.col("code").withField("schema_version", F.lit(1))},
        {"code": F.col("code").withField("calls", F.transform(F.col("code")["calls"], lambda c: c.withField("caller_id", F.lit("nobody")))), "only": "src/report.cpp"},
        {"code": F.col("code").withField("functions", F.transform(F.col("code")["functions"], lambda c: c.withField("span", c["span"].withField("start_byte", F.lit(-1).cast("long")))))},
        {"file": F.col("file").withField("provenance", F.struct(F.lit("").alias("source_id"), F.lit("c").alias("snapshot_id")))},
    ):
        rows = code.filter(F.col("file.path") == change.pop("only", "src/report.cpp"))
        with pytest.raises(BadInput):
            build.build_graph(rows.withColumns(change))
    other = good.withColumn("artifact_id", F.lit("another"))
    with pytest.raises(BadInput, match="Conflicting"):
        build.build_graph(good.unionAll(other))


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda g: g.update(schema_version=True), "schema_version"),
        (lambda g: g.update(extra=1), "fields"),
        (lambda g: g["nodes"].append(g["nodes"][0]), "Duplicate node"),
        (lambda g: g["nodes"][0].update(more=1), "invalid node"),
        (lambda g: g["nodes"][0].update(type="Widget"), "Invalid node"),
        (lambda g: g["edges"].append(g["edges"][0]), "Duplicate relationship"),
        (lambda g: g["edges"][4].update(target="gone"), "Dangling"),
        (lambda g: g["edges"][4].update(type="CALLS"), "Invalid relationship"),
        (lambda g: g["edges"].pop(0), "one repository"),
        (lambda g: g["nodes"][2]["properties"]["provenance"].update(snapshot_id="z"), "provenance"),
        (lambda g: g["nodes"][2]["properties"].update(path="../x"), "Unsafe"),
        (lambda g: (g["nodes"].append({"id": "f2", "type": "File", "properties": {"path": "b.cpp", "provenance": {"source_id": "u", "snapshot_id": "c"}}}), g["edges"].append({"source": "rev", "type": "CONTAINS", "target": "f2", "properties": {}}), g["edges"].append({"source": "f2", "type": "DEFINES", "target": "fn", "properties": {}})), "multiple files"),
    ],
)
def test_mutated_graphs(spark, tmp_path, change, message):
    doc = fixtures.base_graph()
    change(doc)
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    with pytest.raises(BadInput, match=message):
        validate.select_graph(*snapshot.graph_file(spark, str(path)))


def test_selection_and_queries(spark, tmp_path):
    path = str(tmp_path / "graph.json")
    fixtures.write_graph(path)
    graph = validate.select_graph(*snapshot.graph_file(spark, path), "u", "c")
    assert graph_query.status(graph).first()["nodes"] == 5
    with pytest.raises(BadInput):
        validate.select_graph(*snapshot.graph_file(spark, path), "u", "other")
    near = graph_query.neighborhood(graph, "rev", graph_query.relation_set(None), "both", 3, 100)
    assert [(e["source"], e["target"]) for e in near["edges"].collect()] == [("repo", "rev"), ("rev", "f"), ("f", "call"), ("f", "fn"), ("fn", "call")]
    assert [r["id"] for r in near["nodes"].collect()] == ["call", "f", "fn", "repo", "rev"] and not near["truncated"]
    cut = graph_query.neighborhood(graph, "rev", graph_query.relation_set(None), "out", 3, 2)
    assert cut["truncated"] and cut["edges"].count() == 2
    exact = graph_query.neighborhood(graph, "rev", graph_query.relation_set(None), "out", 1, 1)
    assert not exact["truncated"]
    found = graph_query.shortest_path(graph, "repo", "call", ["HAS_REVISION", "CONTAINS"], 3)
    assert found["found"] and [e["target"] for e in found["edges"].collect()] == ["rev", "f", "call"]
    assert not graph_query.shortest_path(graph, "repo", "call", ["HAS_REVISION", "CONTAINS"], 2)["found"]
    assert graph_query.shortest_path(graph, "f", "f", ["CONTAINS"], 1)["found"]
    assert graph_query.shortest_path(graph, "repo", "call", ["HAS_REVISION", "CONTAINS"], 9, max_visited=2)["truncated"]
    # what is found before the target is expanded first, and may use up the visits
    hub = spark.createDataFrame([("s", i) for i in ("a", "t")] + [("a", i) for i in "xyz"], "source string, target string").selectExpr("source", "'CONTAINS' type", "target", "'{}' properties")
    ends = spark.createDataFrame([(i,) for i in "satxyz"], "id string").selectExpr("id", "'File' type", "'{}' properties")
    wide = graph | {"nodes": ends, "edges": hub, "owners": graph["owners"].limit(0)}
    seen = [graph_query.shortest_path(wide, "s", "t", ["CONTAINS"], hops, most) for hops, most in ((1, 3), (2, 6), (2, 5), (2, 3))]
    assert [(p["found"], p["truncated"]) for p in seen] == [(True, False), (True, False), (False, True), (False, True)] and seen[2]["visited"] == 5
    assert [tuple(r) for r in graph_query.levels(wide, "s", ["CONTAINS"], "out", 5).orderBy("hops", "node").collect()] == [("s", 0), ("a", 1), ("t", 1), ("x", 2), ("y", 2), ("z", 2)]
    with pytest.raises(BadInput):
        graph_query.neighborhood(graph, "nobody", ["CONTAINS"])
    with pytest.raises(NotImplementedError):
        graph_query.relation_set(["CALLS"])
    with pytest.raises(BadInput):
        graph_query.relation_set([], required=True)


def test_find_symbols(spark):
    graph = validate.select_graph(*fixtures.graph(spark))
    both = graph_query.find_symbols(graph, "level")
    assert both["ambiguous"] and not both["truncated"]
    rows = both["matches"].collect()
    assert [r["score"] for r in rows[:2]] == [1000, 1000] and all(r["type"] != "CallSite" for r in rows)
    one = graph_query.find_symbols(graph, "level gauge", "gauge.cpp")
    assert {r["type"] for r in one["matches"].collect()} == {"File", "Function"} and not one["ambiguous"]
    assert graph_query.find_symbols(graph, "moon::level")["matches"].first()["score"] == 1000
    assert graph_query.find_symbols(graph, "level", limit=1)["truncated"]
    assert graph_query.find_symbols(graph, "int int print_tide")["matches"].first()["score"] == 3
    assert graph_query.find_symbols(graph, "zzz")["matches"].count() == 0


def test_projection(spark):
    code = extract.extract("int f(int a) { return g(a); } int f(double a) { return g(a); }")
    rows = [(7, 2, "u", "r", "a.cpp", "a.cpp", code)]
    from codegraph.schemas import CODE_MODEL

    tasks = spark.createDataFrame(rows, f"task_id long, generation long, source_uri string, revision string, path string, name string, code {CODE_MODEL.simpleString()}")
    nodes, edges = projection.projection_nodes(tasks), projection.projection_edges(tasks)
    functions = [r["id"] for r in nodes.filter("label = 'Function'").collect()]
    assert len(functions) == 2 and all(i.startswith("7:2::") for i in functions)
    assert nodes.filter("label = 'CallSite'").count() == 2 and edges.filter("type = 'CALLS'").count() == 0
    assert edges.filter("type = 'HAS_CALL_SITE'").count() == 2
    twice = tasks.unionAll(tasks)
    assert projection.projection_nodes(twice).count() == nodes.count() and projection.projection_edges(twice).count() == edges.count()
    old = tasks.withColumn("code", F.col("code").withField("schema_version", F.lit(1)))
    calls = projection.projection_edges(old).filter("type = 'CALLS'").collect()
    assert [(c["source"], c["target"]) for c in calls] == [("7:2::f", "7:2::g")]
    assert [r["id"] for r in projection.stub_callees(old).collect()] == ["7:2::g"]
    assert projection.broken_uniqueness(nodes).count() == 0


def test_export_order_of_all(spark):
    import json

    from codegraph.plans import corpus, queries

    d = "/root/testdata/sf0.001"
    nodes, edges = corpus.hierarchy(spark, d)
    want = sorted((tuple(r) for r in edges.select("source", "type", "target").collect()), key=lambda e: json.dumps(e, separators=(",", ":")))
    got = sorted(map(tuple, queries.QUERIES["export_order_edges"](spark, d).collect()))
    assert got == [(i, *e) for i, e in enumerate(want, 1)] and {e[1] for e in want} == {"HAS_REVISION", "CONTAINS", "DEFINES", "HAS_CALL_SITE"}
    got = sorted(map(tuple, queries.QUERIES["export_order_nodes"](spark, d).collect()))
    assert got == [(i, *n) for i, n in enumerate(sorted(tuple(r) for r in nodes.select("id", "type").collect()), 1)]
    found = queries.QUERIES["export_order_edges"](spark, d)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert build.placed(edges.limit(0).orderBy("source")).count() == 0


def test_neighborhood_queries_have_no_limit(spark, monkeypatch):
    from codegraph.plans import corpus, queries

    n = 2500
    functions = spark.range(n).select(F.concat(F.lit("o:"), "id").alias("id"), F.lit("Function").alias("type"), F.lit("{}").alias("properties"))
    calls = spark.range(n).select(F.concat(F.lit("l:"), "id").alias("id"), F.lit("CallSite").alias("type"), F.lit("{}").alias("properties"))
    nodes = spark.createDataFrame([("c:1", "File", "{}"), ("n:1", "Revision", "{}")], "id string, type string, properties string").unionAll(functions).unionAll(calls)
    edge = lambda source, kind, target: spark.range(n).select(source.alias("source"), F.lit(kind).alias("type"), target.alias("target"), F.lit("{}").alias("properties"))
    own, site = F.concat(F.lit("o:"), "id"), F.concat(F.lit("l:"), "id")
    edges = edge(F.lit("c:1"), "DEFINES", own).unionAll(edge(own, "HAS_CALL_SITE", site)).unionAll(edge(F.lit("n:1"), "CONTAINS", F.lit("c:1")).limit(1))
    owners = spark.createDataFrame([], "node string, file string, path string")
    monkeypatch.setattr(corpus, "graph_of", lambda spark, d: {"nodes": nodes, "edges": edges, "owners": owners})
    found = [queries.QUERIES[f"neighborhood_d{depth}"](spark, "").collect() for depth in (1, 2, 3)]
    assert [len(f) for f in found] == [len({r["id"] for r in f}) for f in found] == [n + 1, 2 * n + 1, 2 * n + 1]


def test_shortest_path_searches_all(spark, monkeypatch):
    """more nodes than MAX_VISITED beside the path; the first discovered of equal paths."""
    from codegraph.plans import corpus, queries

    n = graph_query.MAX_VISITED + 500
    wide = spark.range(n).select(F.lit("n:7").alias("source"), F.lit("CONTAINS").alias("type"), F.concat(F.lit("c:"), F.col("id") + 100_000).alias("target"), F.lit("{}").alias("properties"))
    edges = wide.unionAll(spark.createDataFrame([("r:2", "HAS_REVISION", "n:7", "{}")], wide.schema))
    nodes = wide.selectExpr("target id", "'File' type", "'{}' properties").unionAll(spark.createDataFrame([("r:2", "Repository", "{}"), ("n:7", "Revision", "{}")], "id string, type string, properties string"))
    graph = {"nodes": nodes, "edges": edges, "owners": spark.createDataFrame([], "node string, file string, path string")}
    last = f"c:{100_000 + n - 1}"
    found = graph_query.shortest_path(graph, "r:2", last, ["HAS_REVISION", "CONTAINS"], 6)
    assert found["found"] and [e["target"] for e in found["edges"].collect()] == ["n:7", last]
    assert graph_query.shortest_path(graph, "r:2", last, ["HAS_REVISION", "CONTAINS"], 6, graph_query.MAX_VISITED)["truncated"]
    lost = graph_query.shortest_path(graph, "n:7", "r:2", ["CONTAINS"], 6)
    assert (lost["found"], lost["truncated"], lost["visited"]) == (False, False, n + 1)
    assert graph_query.shortest_path(graph, last, last, ["CONTAINS"], 6)["edges"].count() == 0
    monkeypatch.setattr(corpus, "graph_of", lambda spark, d: graph)
    assert queries.QUERIES["shortest_path_edges"](spark, "").collect()[0][:] == ("r:2", "HAS_REVISION", "n:7", "CONTAINS", "c:100000")
    both = spark.createDataFrame([("s", "CONTAINS", x, "{}") for x in "cab"] + [(x, t, "t", "{}") for x in "abc" if x != "a" for t in ("DEFINES", "CONTAINS")] + [("a", "DEFINES", "z", "{}")], wide.schema)
    ends = spark.createDataFrame([(i,) for i in "sabctz"], "id string").selectExpr("id", "'File' type", "'{}' properties")
    small = {"nodes": ends, "edges": both, "owners": graph["owners"]}
    paths = [[tuple(e) for e in graph_query.shortest_path(small, "s", "t", ["CONTAINS", "DEFINES"], 4, most)["edges"].select("source", "type", "target").collect()] for most in (None, 5000)]
    assert paths[0] == paths[1] == [("s", "CONTAINS", "b"), ("b", "CONTAINS", "t")]


def test_levels_end_their_plans(spark):
    """the plan of a hop doesn't hold those of the hops before."""
    chain = spark.range(6).selectExpr("concat('n', id) source", "'CONTAINS' type", "concat('n', id + 1) target", "'{}' properties")
    nodes = spark.range(7).selectExpr("concat('n', id) id", "'File' type", "'{}' properties")
    plan = lambda depth: len(graph_query.levels({"nodes": nodes, "edges": chain}, "n0", ["CONTAINS"], "out", depth)._jdf.queryExecution().analyzed().toString())
    sizes = [plan(depth) for depth in (2, 3, 4)]
    assert sizes[2] - sizes[1] < 1.5 * (sizes[1] - sizes[0]) and "Range" not in graph_query.levels({"nodes": nodes, "edges": chain}, "n0", ["CONTAINS"], "out", 4)._jdf.queryExecution().analyzed().toString()


def test_semi_joins_sift_before_they_shuffle(spark):
    """What can't match is dropped below unions and joins, and all that matches stays."""
    ids = spark.range(0, 3000, 3).selectExpr("concat('x', id) node")
    rows = spark.range(3000).selectExpr("concat('x', id) k").unionAll(spark.createDataFrame([(None,)], "k string"))
    assert sorted(r[0] for r in validate.among(rows, "k", ids, "node").collect()) == sorted(r[0] for r in ids.collect())
    assert validate.sifted(rows, "k", validate.field_of(ids, "node")).count() < 1100
    from codegraph.plans import corpus

    _, edges = corpus.hierarchy(spark, "/root/testdata/sf0.001")
    plan = validate.among(edges, "target", ids, "node")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.rindex("_bits")


def test_cosine_of_blocks(spark):
    """compared by blocks in numpy, with ties by id."""
    import numpy as np

    from codegraph.operators import chunks

    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8)).round(3)
    v = np.concatenate([v, v[:20], v[:3]])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>")
    found = chunks.cosine_top(rows, rows.filter("vec_id % 5 = 0"), 4)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    w = v.astype(np.float32).astype(float)
    w = w / np.linalg.norm(w, axis=1)[:, None]
    want = [(q, i, n) for q in range(0, len(v), 5) for n, i in enumerate(sorted(range(len(v)), key=lambda i: (-round(float(w[q] @ w[i]), 6), i))[:4], 1)]
    assert sorted(tuple(r) for r in found.select("query_id", "vec_id", "rank").collect()) == sorted(want)


def test_distinct_records_shuffle_read_fields_only(spark):
    """structs survive field by field, nulls included, and fields nobody reads stay behind."""
    from codegraph.plans import queries

    d = "/root/testdata/sf0.001"
    once = build.distinct_records(queries._versioned(spark, d).unionAll(queries._versioned(spark, d)))[0]
    assert set(r["artifact_id"] for r in once.select("artifact_id").collect()) == set(r["artifact_id"] for r in queries._versioned(spark, d).select("artifact_id").collect())
    assert once.filter("code IS NOT NULL OR file.language IS NOT NULL OR file.provenance.source_id <> 'u'").count() == 0
    plan = queries.QUERIES["record_dedupe"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "text/plain" not in plan.split("RepartitionByExpression")[0] and "file_id" not in plan


def test_projected_models_are_extracted_once(spark):
    """the parts of a projection read stored models."""
    from codegraph.plans import queries

    for name in ("projection_edges", "projection_nodes", "projection_legacy_calls"):
        assert "MapInArrow" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

def test_selected_graph_reads_its_files_only(spark):
    """Orders and lines of other files are dropped as numbers, before the join."""
    from codegraph.plans import corpus

    d = "/root/testdata/sf0.01"
    files = corpus.table(spark, d, "customer").filter("c_nationkey = 7").selectExpr("concat('c:', c_custkey) file")
    _, few = corpus.hierarchy(spark, d, files)
    assert few.count() < 0.1 * corpus.hierarchy(spark, d)[1].count() and all(any(x in f for f in few.inputFiles()) for x in ("graph-orders", "graph-lines"))
    own = lambda edges: sorted(map(tuple, edges.join(files, edges["source"] == files["file"]).select("source", "type", "target").collect()))
    assert own(few) == own(corpus.hierarchy(spark, d)[1]) != []
    field = validate.field_of(spark.createDataFrame([("n:7",)], "id string"), "id")
    _, below = corpus.hierarchy(spark, d, ends={"source": field})
    assert {r["source"] for r in below.collect()} == {"n:7"}
    assert "_bits" in below._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]


def test_dangling_edges_shuffle_hashes(spark):
    """the edges found by hashes are read again; nulls and both ends count, equal edges once."""
    ids = spark.range(2000).selectExpr("concat('n', id) id", "'File' type", "'{}' properties").unionAll(spark.createDataFrame([(None, "File", "{}")], "id string, type string, properties string"))
    edges = spark.range(2000).selectExpr("concat('n', id) source", "'CONTAINS' type", "concat('n', 1999 - id) target", "'{}' properties")
    for kept in ([], [("n1", "CONTAINS", "x"), ("n1", "CONTAINS", "x")], [("x", "CONTAINS", "n1"), ("x", "CALLS", "y")], [("n1", "CONTAINS", None), (None, None, "n1")]):
        more = spark.createDataFrame([(*e, "{}") for e in kept], "source string, type string, target string, properties string")
        found = validate.dangling_edges(ids, edges.unionAll(more))
        assert set(map(tuple, found.collect())) == set(kept) and found.count() == len(set(kept))
        assert any("lost-edges" in f for f in found.inputFiles())


def test_bad_relations_shuffle_hashes(spark):
    """the edges judged bad by hashes are read again and judged by ids; repeated nodes repeat rows, ends without a node drop out."""
    kinds = [("r", "Repository"), ("v", "Revision"), ("f", "File"), ("g", "File"), ("m", "Function"), ("s", "CallSite"), ("w", "Widget"), ("w", "Widget"), ("z", None)]
    nodes = spark.createDataFrame([(*k, "{}") for k in kinds], "id string, type string, properties string")
    good = [("r", "HAS_REVISION", "v"), ("v", "CONTAINS", "f"), ("f", "CONTAINS", "s"), ("f", "DEFINES", "m"), ("m", "HAS_CALL_SITE", "s")]
    bad = [("v", "CONTAINS", "s"), ("f", "CONTAINS", "g"), ("m", "CALLS", "m"), ("f", None, "m"), ("f", "DEFINES", "z")]
    edges = spark.createDataFrame([(*e, "{}") for e in [*good, *bad, ("f", "DEFINES", "w"), ("f", "CALLS", "gone"), (None, "CALLS", "m")]], "source string, type string, target string, properties string")
    found = validate.bad_relations(nodes, edges)
    assert sorted(map(str, map(tuple, found.select("source", "type", "target").collect()))) == sorted(map(str, [*bad, ("f", "DEFINES", "w"), ("f", "DEFINES", "w")]))
    assert any("bad-edges" in f for f in found.inputFiles())


def test_stray_calls_shuffle_hashes(spark):
    """calls judged stray by hashes are compared by ids; owners may be repeated, a call site may have none."""
    owned = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "g"), ("s", "f"), ("s", "f"), ("t", "g")], "node string, file string")
    calls = [("a", "s"), ("a", "t"), ("a", "t"), ("b", "t"), ("b", "gone"), ("b", None), ("nobody", "s")]
    edges = spark.createDataFrame([(s, "HAS_CALL_SITE", t, "{}") for s, t in calls] + [("a", "CALLS", "t", "{}")], "source string, type string, target string, properties string")
    found = validate.stray_calls(edges, owned)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", "t"), ("a", "t"), ("b", "gone"), ("b", None)]))
    assert any("stray-calls" in f for f in found.inputFiles())


def test_export_key_is_made_once(spark):
    """the sort compares a column, not an expression that every comparison makes anew."""
    edges = spark.createDataFrame([('a"', "CALLS", "b", "{}"), ("a", "CALLS", "b", "{}"), ("a!", "CALLS", "b", "{}")], "source string, type string, target string, properties string")
    _, found = build.ordered(edges.selectExpr("source id", "type", "properties"), edges)
    assert [r["source"] for r in found.collect()] == ["a!", "a", 'a"'] and found.columns == edges.columns
    sort = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in line]
    assert sort and "to_json" not in sort[0]


def _joins(df) -> set:
    import re

    return set(re.findall(r"(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", df._jdf.queryExecution().executedPlan().toString()))


def test_fields_of_hashes_let_few_others_pass(spark):
    """with one bit for an id, a share that grows with the ids passes, so what is left grows with their square."""
    ids = spark.range(300_000).selectExpr("concat('a', id) id")
    field = validate.field_of(ids, "id")
    assert validate.sifted(ids, "id", field).count() == 300_000
    assert validate.sifted(spark.range(300_000).selectExpr("concat('b', id) id"), "id", field).count() < 30


def test_selected_graph_of_odd_tables(spark, tmp_path):
    """the graph made of the files' tables is the induced subgraph of the whole graph, and what is near has no row twice."""
    from codegraph.plans import corpus, queries

    src, d = "/root/testdata/sf0.001", str(tmp_path)
    t = {name: corpus.table(spark, src, name) for name in ("region", "nation", "customer", "orders", "lineitem")}
    c = sorted(r[0] for r in t["customer"].filter("c_nationkey = 7").collect())
    other = t["customer"].filter("c_nationkey <> 7").first()[0]
    start = int(min(str(x) for x in c))  # the first file by id, from which the neighborhoods go
    k = sorted(r["o_orderkey"] for r in t["orders"].filter(F.col("o_custkey") == start).collect())
    change = lambda df, where, **cols: df.filter(where).withColumns({a: b.cast(df.schema[a].dataType) for a, b in cols.items()})
    first = F.col("o_orderkey") == k[0]
    t["orders"] = t["orders"].unionAll(change(t["orders"], first, o_custkey=F.lit(other))).unionAll(change(t["orders"], first, o_custkey=F.lit(c[-1]))).unionAll(t["orders"].filter(F.col("o_orderkey") == k[-1]))
    t["orders"] = t["orders"].unionAll(change(t["orders"], first, o_orderkey=F.lit(None))).unionAll(change(t["orders"], first, o_orderkey=F.lit(900_002), o_custkey=F.lit(999_999)))
    line = F.col("l_orderkey") == k[0]
    t["lineitem"] = t["lineitem"].unionAll(t["lineitem"].filter(line)).unionAll(change(t["lineitem"], line, l_orderkey=F.lit(900_003))).unionAll(change(t["lineitem"], line, l_orderkey=F.lit(900_002)))
    t["customer"] = t["customer"].unionAll(t["customer"].filter(F.col("c_custkey") == c[0]).withColumn("c_nationkey", F.lit(8).cast(t["customer"].schema["c_nationkey"].dataType)))
    for name, df in t.items():
        df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    nodes, edges = corpus.hierarchy(spark, d)
    files = spark.createDataFrame([(f"c:{x}",) for x in c], "file string")
    ends = spark.createDataFrame([("n:7",), ("r:2",)], "node string")
    want = validate.induced(nodes, edges, validate.owners(edges, files).select("node").unionAll(ends))
    graph = corpus.graph_of(spark, d)
    rows = lambda df: sorted(map(tuple, df.drop("properties").collect()))
    assert rows(graph["nodes"]) == rows(want[0]) and rows(graph["edges"]) == rows(want[1])
    assert rows(graph["owners"].select("node", "file")) == rows(validate.owners(edges, files).filter("node IS NOT NULL"))
    assert graph["nodes"].filter(F.col("id") == f"o:{k[0]}").count() == 3
    near = rows(queries.QUERIES["neighborhood_d1"](spark, d))
    assert len(near) == len(set(near)) > 1


def test_both_sides_of_edges_are_sifted(spark):
    """to edges with few targets, orders aren't shuffled whole, nor lines to those with few sources."""
    from codegraph.plans import corpus

    d = "/root/testdata/sf0.001"
    _, edges = corpus.hierarchy(spark, d)
    some = edges.filter("type = 'CONTAINS' AND source LIKE 'c:%'").orderBy("target").limit(20).persist()
    for role, where, name in (("target", "o_orderkey", "met-lines"), ("source", "l_orderkey", "met-orders")):
        _, few = corpus.hierarchy(spark, d, ends={role: validate.field_of(some, role)})
        joined = few._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
        assert f"xxhash64({where}" in joined and any(name in f for f in few.inputFiles())
        ids = some.select(F.col(role).alias("id"))
        exact = lambda e: sorted(map(tuple, e.join(ids, e[role] == ids["id"], "left_semi").collect()))
        assert exact(few) == exact(edges) != []


def test_small_frontiers_meet_edges_by_broadcast(spark, monkeypatch):
    """the edges of a graph aren't shuffled to meet a frontier of one node, nor all owners to describe few nodes."""
    edges = spark.range(3000).selectExpr("concat('n', id % 50) source", "'CONTAINS' type", "concat('m', id) target", "'{}' properties")
    nodes = edges.selectExpr("target id", "'File' type", "'{}' properties").unionAll(spark.range(50).selectExpr("concat('n', id)", "'File'", "'{}'"))
    graph = {"nodes": nodes, "edges": edges, "owners": edges.selectExpr("target node", "source file", "source path")}
    met, steps = [], graph_query.steps
    monkeypatch.setattr(graph_query, "steps", lambda *a: met.append(steps(*a)) or met[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        near = graph_query.reach(graph, "n7", ["CONTAINS"], "out", 1)
        found = graph_query.neighborhood(graph, "n7", ["CONTAINS"], "both", 2, 100)
        assert all(join.startswith("Broadcast") for m in met for join in _joins(m)) and all(_joins(m) for m in met) and len(met) == 3
        assert near.count() == found["nodes"].count() == 61 and found["edges"].count() == 60 and not found["truncated"]
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Project") and plan.split("\n")[1].startswith("+- Join LeftOuter") and plan.count("Join LeftSemi") == 3  # both parts of the nodes, and the owners
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
