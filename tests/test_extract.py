from codegraph.operators.extract import extract

SAMPLE = """#include <string>
#include "greeter.hpp"
// void fake() { call(); }
/* int also_fake() { nope(); } */
class Greeter {
public:
    void greet(const std::string& name) { print(name); }
    int later() const;
};
struct Point { int x; };
struct Forward;
static int compute(int a) { return helper(a); }
int main() {
    const char* s = "fake_in_string()";
    Greeter g;
    g.greet(s);
    return compute(2);
}
"""


def test_sample():
    m = extract(SAMPLE)
    assert [(i["target"], i["line"]) for i in m["includes"]] == [("string", 1), ("greeter.hpp", 2)]
    assert [c["name"] for c in m["classes"]] == ["Greeter", "Point"]
    assert [(f["qualified_name"], f["return_type"]) for f in m["functions"]] == [("Greeter::greet", "void"), ("compute", "static int"), ("main", "int")]
    assert [(c["caller"], c["callee"], c["expression"]) for c in m["calls"]] == [("Greeter::greet", "print", "print"), ("compute", "helper", "helper"), ("main", "greet", "g.greet"), ("main", "compute", "compute")]
    assert m["parse_status"] == "complete"
    for c in m["calls"]:
        s = c["span"]
        assert SAMPLE.encode()[s["start_byte"] : s["end_byte"]].endswith(b")")
        assert c["id"] == f"call:{s['start_byte']}:{s['end_byte']}"


def test_namespaces_overloads_lambdas():
    m = extract("namespace n { int f(int a) { return a; } int f(double d) { auto l = [&](int q) { return inner(q); }; return l(1); } int g() { return n::f(1); } }")
    assert [f["qualified_name"] for f in m["functions"]] == ["n::f", "n::f", "n::f::<lambda:68>", "n::g"]
    assert len({f["id"] for f in m["functions"]}) == 4
    callers = {c["callee"]: c["caller"] for c in m["calls"]}
    assert callers == {"inner": "n::f::<lambda:68>", "l": "n::f", "f": "n::g"}


def test_odd_inputs():
    assert extract("int broken( {")["parse_status"] == "partial"
    assert extract("")["parse_status"] == "complete"
    m = extract("int f(void) { return g(); }", "C")
    assert m["parser"]["grammar"] == "c" and [c["caller"] for c in m["calls"]] == ["f"]
    assert extract('auto s = R"x(int no() { nope(); })x";')["functions"] == []


def test_files_are_dealt_over_tasks(spark):
    """One table of one partition is extracted by many tasks, each file once, without a join."""
    from codegraph.operators import classify, extract as operator

    files = spark.range(400).coalesce(1).selectExpr("'u' source_uri", "'r' revision", "concat('f', id, '.cpp') path", "concat('int f', id, '() { return 1; }') content")
    models = operator.code_models(classify.artifacts(files))
    assert "Join" not in models._jdf.queryExecution().executedPlan().toString()
    assert models.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r["file"]["path"], r["code"]["functions"][0]["name"]) for r in models.collect()) == sorted((f"f{i}.cpp", f"f{i}") for i in range(400))
