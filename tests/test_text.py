import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codegraph.functions import columns as C
from codegraph.operators import chunks, evidence, queue, source_query
from codegraph.operators.classify import BadInput

TEXTS = ["", "a", "a\n", "a\r\nb", "a\rb\n\nc", "x\x0by\x0cz\x1cw\x85v u t", "\n\n", "é\r\n"]


def test_lines(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, content string")
    got = {r["i"]: (r["l"], r["k"]) for r in df.select("i", C.lines_of(F.col("content")).alias("l"), source_query.lines_with_ends(F.col("content")).alias("k")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (t.splitlines(), t.splitlines(keepends=True)), repr(t)


def test_read_range(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4"), ("b", ""), ("c", "x")], "path string, content string")
    got = {r["path"]: (r["content"], r["end_line"], r["total_lines"]) for r in source_query.read_range(files, 2, 3).collect()}
    assert got == {"a": ("2\n3\n", 3, 4), "b": (None, 0, 0), "c": (None, 1, 1)}
    assert source_query.read_range(files.filter("path = 'b'"), 1, 9).first()["content"] == ""
    with pytest.raises(BadInput):
        source_query.read_range(files, 121)


def test_search_order_and_budgets(spark):
    files = spark.createDataFrame([("b/x.txt", "Straße\nno"), ("a.txt", "STRASSE"), ("z.txt", "strasse\n" * 3), ("bin.txt", "\0strasse")], "path string, content string")
    out = source_query.search(files, "straSSe", limit=10)
    assert [(r["path"], r["line"]) for r in out["matches"]] == [("a.txt", 1), ("z.txt", 1), ("z.txt", 2), ("z.txt", 3), ("b/x.txt", 1)]
    assert not out["truncated"] and out["files_skipped"] == 1
    assert source_query.search(files, "strasse", limit=2)["truncated"]
    assert not source_query.search(files, "strasse", limit=5)["truncated"]
    cut = source_query.search(files, "strasse", limit=10, max_files=2)
    assert cut["truncated"] and [r["path"] for r in cut["matches"]] == ["a.txt"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé€😀\n", max_size=60), min_size=1, max_size=6), st.integers(4, 9))
def test_chunks(spark, texts, most):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got: dict = {}
    for r in sorted(chunks.chunks(df, most=most, keep=["i"]).collect(), key=lambda r: (r["i"], r["chunk"])):
        got.setdefault(r["i"], []).append((r["byte_start"], r["byte_end"], r["text"]))
    native = {r["i"]: r["b"] for r in df.select("i", chunks.chunk_bounds(F.col("content"), most).alias("b")).collect()}
    for i, t in enumerate(texts):
        raw, start, want = t.encode(), 0, []
        while start < len(raw):
            end = min(start + most, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            want.append((start, end, raw[start:end].decode()))
            start = end
        assert got.get(i, []) == want
        assert native[i] == [0, *(e for _, e, _ in want)]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(C.percent_encode(F.lit("a b/~é*"))) == "a%20b%2F~%C3%A9%2A"
    assert one(C.point_id(F.lit(255), F.lit(1), F.lit(2))) == "00000000-0000-00ff-0000-000100000002"
    assert one(C.identity(F.lit("a"), F.lit('b"'), F.lit(None))) == '["a","b\\"",""]'
    assert [one(C.qualify(F.lit(s), F.lit(n))) for s, n in (("", "f"), ("a", "f"), ("a", "::f"), ("a", "a::f"))] == ["f", "a::f", "f", "a::f"]
    assert [one(C.extension(F.lit(p))) for p in (".md", "a/b.tar.gz", "a.b/c", "x.")] == ["", ".gz", "", "."]
    assert [one(C.safe_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", ".git/x", "", "a..b")] == [True, False, False, False, False, True]


def test_evidence(spark):
    rows = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("s", 3, "x"), ("t", 1, "y")], "session_id string, seq int, identity string")
    assert sorted((r["session_id"], r["identity"], r["evidence_id"]) for r in evidence.interned(rows).collect()) == [("s", "x", "ev-1"), ("s", "y", "ev-2"), ("t", "y", "ev-1")]
    answers = spark.createDataFrame([(1, "see [ev-2] [ev-1][ev-2] [ev-x]"), (2, "nothing"), (3, "[ev-9]")], "i int, answer string")
    known = F.array(F.lit("ev-1"), F.lit("ev-2"))
    got = {r["i"]: (r["citations"], r["invalid_citations"], r["citations_valid"]) for r in evidence.audited(answers, known, F.array(F.lit("ev-2"), F.lit("ev-1"))).collect()}
    assert got == {1: (["ev-2", "ev-1"], [], True), 2: ([], [], False), 3: (["ev-9"], ["ev-9"], False)}
    record = spark.sql("SELECT named_struct('evidence_id', 'ev-1', 'path', 'a.cpp', 'node_id', '', 'start_line', 3, 'end_line', 4, 'revision', 'r', 'sha256', 'abcdefabcdefabcdef') AS r")
    assert record.select(evidence.reference(F.col("r"))).first()[0] == "[ev-1] a.cpp:3-4 (r working-tree sha256=abcdefabcdef)"
    with pytest.raises(BadInput):
        evidence.check_tasks(spark.createDataFrame([("a", "q", ["x"], ["p"]), ("a", "q", ["x"], ["p"])], "id string, question string, answer_contains array<string>, expected_evidence_paths array<string>"))


def test_task_log(spark):
    now = lambda s: F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:{s:02d}:00'")
    schema = "id long, artifact_id string, target string, payload string, generation long, status string, attempts int, claim_token long, lease_until timestamp_ntz, available_at timestamp_ntz, last_error string"
    empty = spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([("a", "graph", "1"), ("b", "graph", "1")], "artifact_id string, target string, payload string")
    state = queue.enqueued(empty, wanted, now(0)).withColumn("id", F.ascii("artifact_id").cast("long")).withColumn("last_error", F.lit(None).cast("string"))
    first = queue.claimed(queue.next_claims(state, now(1)), now(1), 5)
    assert [(r["id"], r["status"], r["attempts"], r["claim_token"]) for r in first.collect()] == [(97, "running", 1, 5)]
    running = first.select(*state.columns).unionByName(state.filter("id = 98"))
    ask = lambda token, action: spark.createDataFrame([(97, token, action, "boom" * 900)], "id long, claim_token long, action string, error string")
    row = lambda s: s.filter("id = 97").first()
    assert row(queue.transitions(running, ask(4, "complete"), now(2)))["status"] == "running"  # a stale token
    assert row(queue.transitions(running, ask(5, "complete"), now(2)))["status"] == "completed"
    assert row(queue.transitions(running, ask(5, "complete"), now(30)))["status"] == "running"  # the lease ran out
    failed = row(queue.transitions(running, ask(5, "fail"), now(2)))
    assert failed["status"] == "failed" and len(failed["last_error"]) == 2000 and str(failed["available_at"]) == "2024-01-01 00:03:00"
    assert queue.claimable(running, now(30)).filter("id = 97").count() == 1
    done = queue.transitions(running, ask(5, "complete"), now(2))
    same = queue.enqueued(done, wanted, now(9)).filter("artifact_id = 'a'").first()
    assert (same["status"], same["generation"]) == ("completed", 1)
    changed = queue.enqueued(done, wanted.withColumn("payload", F.lit("2")), now(9)).filter("artifact_id = 'a'").first()
    assert (changed["status"], changed["generation"], changed["attempts"]) == ("pending", 2, 0)
    with pytest.raises(BadInput):
        queue.check_seconds(0)


def test_walk_by_ranges(spark):
    """no task sees a whole walk, and totals, numbers and stops are those of one."""
    from pyspark.sql import functions as F

    from codegraph.operators import source_query

    rows = [("a" if i % 3 else "b", f"d{i % 5}/f{i:03}", "x" * (i % 7) + ("\0" if i % 11 == 0 else "")) for i in range(300)]
    files = spark.createDataFrame(rows, "lang string, path string, content string")
    walk = source_query.walked(files, 60, 100, partition=("lang",))
    assert walk.select(F.spark_partition_id()).distinct().count() > 0 and "content" not in walk.columns
    got = {r["path"]: (r["file_number"], r["bytes"], r["searched"]) for r in walk.collect()}
    for lang in "ab":
        total, stopped = 0, False
        for n, (_, path, content) in enumerate(sorted((r for r in rows if r[0] == lang), key=lambda r: r[1]), 1):
            readable = "\0" not in content
            total += len(content) if readable else 0
            stopped = stopped or n > 60 or total > 100
            assert got[path] == (n, total, readable and not stopped)
