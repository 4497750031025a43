import json
import os

import pytest

from codegraph import agent, cli, indexing
from codegraph.inspector import Budgets, Checkout, Inspector
from codegraph.operators import classify, extract, validate
from codegraph.operators.classify import BadInput
from codegraph.sources import sinks, snapshot
from codegraph.streaming import tasks

from . import fixtures


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("checkout"))
    commit = fixtures.make_checkout(root)
    return root, commit, validate.select_graph(*fixtures.graph(spark, commit))


def make(spark, place, graph=True, **budgets):
    b = Budgets(**budgets)
    return Inspector(spark, Checkout(spark, place[0], b), place[2] if graph else None, b)


def test_tools(spark, place):
    i = make(spark, place)
    status = i.execute("repository_status", {})
    assert status["data"]["revision_matches"] and not status["data"]["dirty"] and status["data"]["graph"]["files"] == 5
    found = i.execute("find_symbols", {"query": "print_tide"})
    assert found["status"] == "ok" and found["evidence_ids"] and found["data"]["matches"][0]["score"] == 1000
    node = found["data"]["matches"][0]["id"]
    assert found["data"]["evidence_map"][found["evidence_ids"][0]] == {"node_id": node, "path": "src/report.cpp"}
    assert i.evidence.records[found["evidence_ids"][0]]["start_line"] == 3
    assert i.execute("find_symbols", {"query": "level"})["status"] == "ambiguous" and i.execute("find_symbols", {"query": "neap"})["status"] == "not_found"
    source = i.execute("read_symbol_source", {"node_id": node})
    assert source["data"]["content"].startswith("double print_tide") and (source["data"]["start_line"], source["data"]["end_line"]) == (3, 6)
    near = i.execute("get_neighbors", {"node_id": node})
    assert [e["type"] for e in near["data"]["edges"]] == ["HAS_CALL_SITE"] and len(near["data"]["nodes"]) == 2 and len(near["evidence_ids"]) == 3
    repo = json.dumps([fixtures.URI])
    assert i.execute("find_path", {"source_id": repo, "target_id": node, "relations": ["HAS_REVISION", "CONTAINS", "DEFINES"]})["status"] == "ok"
    assert i.execute("find_path", {"source_id": node, "target_id": repo, "relations": ["HAS_REVISION"]})["status"] == "not_found"
    assert i.execute("find_path", {"source_id": repo, "target_id": node, "relations": ["CALLS"]})["status"] == "unsupported"
    assert i.execute("describe_symbol", {"node_id": "nobody"})["status"] == "error"
    assert i.execute("describe_symbol", {"node_id": node})["data"]["nodes"][0]["path"] == "src/report.cpp"
    assert i.execute("read_file", {"path": "src/report.cpp", "start_line": 4, "end_line": 4})["data"]["content"].strip() == "double now = level(hour);"
    lines = i.execute("search_source", {"query": "LEVEL", "limit": 50})["data"]["matches"]
    assert (lines[0]["path"], lines[0]["start_line"], len(lines)) == ("docs/TIDES.md", 2, 5)
    for bad in ({"path": "../x"}, {"path": ".git/config"}, {"path": "src/report.cpp", "start_line": 200}, {"path": "src/report.cpp", "start_line": True}, {"nope": 1}, {}):
        assert i.execute("read_file", bad)["status"] == "error"
    for bad in ({"node_id": node, "depth": 4}, {"node_id": node, "direction": "up"}, {"node_id": " "}):
        assert i.execute("get_neighbors", bad)["status"] == "error"
    again = i.execute("find_symbols", {"query": "print_tide"})
    assert again["evidence_ids"] == found["evidence_ids"]


def test_source_only_and_budget(spark, place):
    i = make(spark, place, graph=False)
    assert sorted(i.available()) == ["read_file", "repository_status", "search_source"]
    assert i.execute("find_symbols", {"query": "x"})["status"] == "error"
    small = make(spark, place, max_result_chars=300)
    out = small.execute("read_file", {"path": "src/report.cpp"})
    assert out["status"] == "error" and out["truncated"] and not small.delivered and small.evidence.records
    with pytest.raises(BadInput):
        Budgets(max_rounds=0)

    class Fewer(Inspector):
        tools = Inspector.tools | {"read_file": None}

    assert "read_file" not in Fewer(spark, i.checkout).available()


def test_stale(spark, tmp_path):
    root = str(tmp_path / "r")
    os.mkdir(root)
    commit = fixtures.make_checkout(root)
    graph = validate.select_graph(*fixtures.graph(spark, commit))
    with open(os.path.join(root, "src/report.cpp"), "a") as f:
        f.write("// more\n")
    i = Inspector(spark, Checkout(spark, root, Budgets()), graph)
    node = i.execute("find_symbols", {"query": "print_tide"})["data"]["matches"][0]["id"]
    assert i.execute("read_symbol_source", {"node_id": node})["status"] == "stale"


def test_agent_loop(spark, place):
    i = make(spark, place)
    model = agent.ScriptedModel([{"calls": [("search_source", {"query": "level"})], "input_tokens": 5, "output_tokens": 1}, {"text": "see [ev-1], not [ev-99]", "input_tokens": 6, "output_tokens": 2}])
    report = agent.ask(i, model, "who calls level?")
    assert report["completion"] == "answered" and report["citation_audit"]["invalid_citations"] == ["ev-99"] and len(report["tool_events"]) == 1
    assert report["references"][0].startswith("[ev-1] docs/TIDES.md:2-2 (") and sorted(report["evidence"]) == list(report["evidence"]) == sorted(i.delivered)
    forever = agent.ask(make(spark, place, max_rounds=2, max_calls_per_round=1), agent.ScriptedModel([{"calls": [("repository_status", {})] * 2}] * 2), "?")
    assert forever["completion"] == "tool_limit" and [e["result"]["status"] for e in forever["tool_events"]] == ["ok", "error"] * 2
    small = make(spark, place, max_result_chars=300)
    lost = agent.ask(small, agent.ScriptedModel([{"calls": [("read_file", {"path": "src/report.cpp"})]}, {"text": "[ev-1]"}]), "?")
    assert lost["evidence"] == {} and lost["citation_audit"]["invalid_citations"] == ["ev-1"]
    with pytest.raises(BadInput):
        agent.ask(i, model, "  ")


def test_chat_model():
    asked = []

    def post(url, body):
        asked.append(body)
        return {"message": {"content": "", "tool_calls": [{"function": {"name": "read_file", "arguments": {"path": "x"}}}]}, "prompt_eval_count": 3, "eval_count": 4}

    out = agent.ChatModel("http://localhost/chat", "m", post).reply([{"role": "tool", "name": "t", "content": {"a": 1}}], ["read_file"])
    assert out == {"text": "", "calls": [("read_file", {"path": "x"})], "input_tokens": 3, "output_tokens": 4} and asked[0]["messages"][0]["content"] == '{"a": 1}'
    with pytest.raises(BadInput):
        agent.ChatModel("u", "m", lambda url, body: {}).reply([], [])


def test_ask_and_compare_commands(spark, tmp_path):
    lines: list = []
    folder = str(tmp_path / "demo")
    assert cli.run(["demo", folder], spark, out=lines.append) == 0 and cli.run(["demo", folder], spark) == 1
    place = [f"{folder}/repository", "--graph", f"{folder}/graph.json"]
    tasks = str(tmp_path / "tasks.json")
    json.dump([{"id": "t", "question": "who calls level?", "answer_contains": ["print_tide"], "expected_evidence_paths": ["src/report.cpp"]}], open(tasks, "w"))

    class Reader:
        def reply(self, messages, tools):
            return {"text": "print_tide [ev-1]"} if len(messages) > 1 else {"calls": [("read_file", {"path": "src/report.cpp"})]}

    model = ["--model-url", "http://localhost", "--model", "m"]
    assert cli.run(["compare", *place, tasks, *model], spark, out=lines.append, model=Reader()) == 0
    found = json.loads(lines[-1])
    assert [(r["mode"], r["checks_passed"]) for r in found["evaluation"]] == [("source-only", True), ("graph", True)]
    assert cli.run(["ask", *place, *model, "--interactive"], spark, out=lines.append, model=Reader(), lines=["one?\n", "two?\n", "\n", "three?\n"]) == 0
    assert [json.loads(x)["question"] for x in lines[-2:]] == ["one?", "two?"]
    assert cli.run(["ask", *place, *model, "--question", "x", "--interactive"], spark) == 2 and cli.run(["ask", *place, *model], spark) == 2
    assert cli.run(["inspect", *place, "read_file", "{}"], spark, out=lines.append) == 1
    json.dump([{"id": "t", "question": " "}], open(tasks, "w"))
    assert cli.run(["compare", *place, tasks, *model], spark, model=Reader()) == 1


def test_index_worker(spark, tmp_path):
    root, out, lines = str(tmp_path / "tables"), str(tmp_path / "out"), []
    kept = classify.stored(fixtures.files(spark)).persist()
    indexing.store(spark, root, kept.withColumnRenamed("id", "artifact_id"), extract.records(kept))
    tasks = lambda: sinks.published(spark, root)["tasks"]
    assert {tuple(r) for r in tasks().groupBy("target", "status").count().collect()} == {("vector", "pending", 5), ("graph", "pending", 5)}
    bad = lambda texts: [[float("nan")] for _ in texts]
    assert cli.run(["index", "vector", root, out], spark, out=lines.append, embed=bad) == 1 and lines[-1] == "vector: 0 completed, 5 failed"
    assert tasks().filter("status = 'failed' AND last_error LIKE '%vector%' AND claim_token IS NULL").count() == 5
    assert cli.run(["index", "vector", root, out], spark, out=lines.append, embed=bad) == 0  # not due yet
    assert cli.run(["index", "graph", root, out], spark, out=lines.append) == 0 and lines[-1] == "graph: 5 completed, 0 failed"
    graph = sinks.published(spark, out + "/graph")
    assert graph["nodes"].filter("label = 'Function'").count() == 3
    # unchanged artifacts enqueue nothing, changed ones start over with the next generation
    indexing.store(spark, root, kept.withColumnRenamed("id", "artifact_id"), extract.records(kept))
    assert tasks().filter("status = 'completed'").count() == 5
    more = classify.stored(fixtures.files(spark, sources=fixtures.SOURCES | {"docs/TIDES.md": "# Other\n"})).persist()
    indexing.store(spark, root, more.withColumnRenamed("id", "artifact_id"), extract.records(more))
    assert [(r["target"], r["generation"], r["status"]) for r in tasks().filter("generation > 1").orderBy("target").collect()] == [("graph", 2, "pending"), ("vector", 2, "pending")]
    # vectors: idempotent by id, one dimension
    config = indexing.IndexConfig()
    table = indexing.VectorTable(spark, out, config.collection)
    write = indexing.vector_writer(table, config, lambda texts: [[1.0, float(len(t))] for t in texts])
    rows = spark.createDataFrame([(7, 1, "a", "u", "r", "p", "x" * 1300)], "task_id long, generation long, artifact_id string, source_uri string, revision string, path string, content string")
    for _ in range(2):
        write(rows, lambda: None)
    assert table.read().count() == 2 and [r["n"] for r in table.read().selectExpr("size(vector) n").collect()] == [2, 2]
    with pytest.raises(BadInput):
        table.bootstrap(3)
    for wrong in ({"collection": "a b"}, {"model": ""}, {"url": "http://x\r\nHost: y"}, {"user": "a:b"}):
        with pytest.raises(BadInput):
            indexing.IndexConfig(**wrong)
    assert indexing.IndexConfig(user="ann", password="tide").authorization() == "Basic YW5uOnRpZGU="
    for status, body in ((500, b""), (200, b'{"errors": [1]}'), (200, b"[]")):
        with pytest.raises(BadInput):
            indexing.checked_response(status, body)
    assert indexing.checked_response(200, b"") == {}


SHA = "a" * 40


def canned(url, headers):
    answers = {
        "/repos/o/n": {"default_branch": "feat/x"},
        "/repos/o/n/commits/feat%2Fx": {"sha": SHA, "commit": {"tree": {"sha": "b" * 40}}},
        f"/repos/o/n/git/trees/{'b' * 40}?recursive=1": {"truncated": False, "tree": [
            {"path": "a.md", "type": "blob", "mode": "100644", "size": 3, "sha": "1"}, {"path": "b.png", "type": "blob", "mode": "100644", "size": 3, "sha": "2"},
            {"path": "l.md", "type": "blob", "mode": "120000", "size": 3, "sha": "3"}, {"path": "m", "type": "commit", "mode": "160000", "sha": "4"}]},
    }
    path = url.removeprefix(snapshot.API)
    if path.endswith("/git/blobs/1"):
        return 200, "héé".encode()
    return (200, json.dumps(answers[path]).encode()) if path in answers else (404, b"{}")


def test_snapshot(spark, tmp_path):
    rows = {r["path"]: r for r in snapshot.github_files(spark, "https://github.com/o/n.git", transport=canned).collect()}
    assert {p: r["content"] for p, r in rows.items()} == {"a.md": "héé", "b.png": ""} and rows["a.md"]["revision"] == SHA
    for bad in ("http://github.com/o/n", "https://github.com/o/..", "https://github.com/o", "https://example.org/o/n"):
        with pytest.raises(BadInput):
            snapshot.parse_repository(bad)
    with pytest.raises(BadInput, match="404"):
        snapshot.GithubClient(canned).tree("https://github.com/o/other")
    lines: list = []
    assert cli.run(["ingest", "github", "https://github.com/o/n"], spark, canned, lines.append) == 0 and lines[-1] == "stored 1, skipped 1"
    folder = str(tmp_path / "out")
    assert cli.run(["ingest", "github", "https://github.com/o/n", "--local", folder], spark, canned, lines.append) == 0 and os.listdir(folder) == ["1.json"]
    assert cli.run(["ingest", "github", "https://github.com/o/n", "--local", folder], spark, canned, lines.append) == 1
    assert cli.run(["ingest", "local-file", "x"], spark, canned, lines.append) == 1
    assert cli.run(["ingest", "nope", "x"], spark, canned, lines.append) == 2
    graph = str(tmp_path / "g.json")
    assert cli.run(["graph-export", folder, graph], spark) == 0 and json.load(open(graph))["schema_version"] == 1
    assert cli.run(["graph-export", folder, graph], spark) == 1
    root = str(tmp_path / "tables")
    os.mkdir(root)
    assert cli.run(["ingest", "github", "https://github.com/o/n", "--tables", root], spark, canned, lines.append) == 0
    assert sinks.published(spark, root)["artifacts"].count() == 1


def test_registry(spark):
    r = snapshot.SourceRegistry()
    r.register("x", lambda s, q: None)
    for call in (lambda: r.register("x", lambda s, q: None), lambda: r.register("y", None), lambda: r.create(spark, snapshot.Request("x", "")), lambda: r.create(spark, snapshot.Request("z", "u")), lambda: r.create(spark, snapshot.Request("x", "u"))):
        with pytest.raises(BadInput):
            call()


def test_streaming(spark, tmp_path):
    files, out = str(tmp_path / "in"), str(tmp_path / "out")
    fixtures.files(spark).write.parquet(files)
    q = tasks.arriving_chunks(tasks.arriving_files(spark, files)).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("chunks").count() == 5
    events = spark.createDataFrame([(1, "a", 1, 1.0), (1, "a", 2, 2.0), (2, "a", 3, 3.0)], "user_id long, event_type string, event_id long, value double")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    tasks.latest_state(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out + "/v0").collect())) == [(1, "a", 2, 2.0), (2, "a", 3, 3.0)]
