"""The reference-surface queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import chunks, classify, evidence, extract, graph_query, projection, queue, source_query, validate
from ..schemas import CODE_MODEL
from ..sources import snapshot
from ..storage import stored
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
L = "long"
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def query(sql: str | None = None, *, prelude: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (f"WITH RECURSIVE {prelude}\n" if prelude else "") + sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return corpus.table(spark, d, name)


def n(c: str = "*") -> F.Column:
    return F.count(c).cast(L)


# -- sources, classification, limits -------------------------------------------------------

_CLASS_SQL = """CASE WHEN ext IN ('.cpp', '.h') THEN 'C++' WHEN ext = '.c' THEN 'C' END AS language,
 CASE WHEN ext IN ('.cpp', '.h', '.c') THEN 'code' WHEN ext IN ('.md', '.txt') THEN 'document' END AS model_type,
 CASE WHEN ext IN ('.cpp', '.h', '.c', '.txt') THEN 'text/plain' WHEN ext = '.md' THEN 'text/markdown' END AS mime_type"""
_EXT = corpus.FILES_SQL + ", named AS (SELECT *, regexp_extract(path, '[^/]+(\\.[^./]*)$', 1) AS ext FROM files)"


@query(f"SELECT path, {_CLASS_SQL} FROM named", prelude=_EXT)
def classify_files(spark, d):
    return classify.classify(corpus.files(spark, d)).select("path", "language", "model_type", "mime_type")


@query("SELECT count(*) FILTER (ext <> '.png') AS stored, count(*) FILTER (ext = '.png') AS skipped FROM named", prelude=_EXT)
def skip_counts(spark, d):
    return classify.summary(corpus.files(spark, d))


@query(f"SELECT source_uri, language, CAST(count(*) AS BIGINT) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM (SELECT *, {_CLASS_SQL} FROM named) WHERE model_type IS NOT NULL GROUP BY ALL", prelude=_EXT)
def language_by_source(spark, d):
    kept = classify.classify(corpus.files(spark, d)).filter("model_type IS NOT NULL")
    return kept.groupBy("source_uri", "language").agg(n().alias("files"), F.sum(F.octet_length("content").cast(L)).alias("bytes"))


@query("SELECT CAST(to_json([source_uri, revision, path]) AS VARCHAR) AS id, string_split(path, '/')[2] AS name, CAST(strlen(content) AS BIGINT) AS size_bytes FROM named WHERE ext <> '.png'", prelude=_EXT)
def artifact_ids(spark, d):
    return classify.artifacts(corpus.files(spark, d)).filter("model_type IS NOT NULL").select("id", "name", "size_bytes")


@query("SELECT source_uri, revision, CAST(max(strlen(content)) AS BIGINT) AS largest, CAST(sum(strlen(content)) AS BIGINT) AS total, max(strlen(content)) <= 20000 AND sum(strlen(content)) <= 40000 AS ok FROM files GROUP BY ALL", prelude=corpus.FILES_SQL)
def file_limits_check(spark, d):
    return classify.over_limits(corpus.files(spark, d), 20_000, 40_000)


@query("SELECT CAST(to_json([source_uri, revision, path]) AS VARCHAR) AS artifact_id, '' AS title, content AS text, CAST(0 AS BIGINT) AS start_page FROM named WHERE ext IN ('.md', '.txt')", prelude=_EXT)
def document_sections(spark, d):
    models = classify.document_models(classify.artifacts(corpus.files(spark, d)).filter("model_type IS NOT NULL"))
    return models.select("artifact_id", F.inline("sections")).select("artifact_id", "title", "text", "start_page")


@query("""SELECT path, '[' || CASE WHEN ext IN ('.md', '.txt') THEN 'document' ELSE 'code' END || '] ' || path || ' (' || strlen(content) || ' bytes)' || chr(10) || content AS output FROM named WHERE ext <> '.png'""", prelude=_EXT)
def print_sink(spark, d):
    return classify.printable(classify.artifacts(corpus.files(spark, d)).filter("model_type IS NOT NULL"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host,
 array_to_string(list_transform(regexp_extract_all(hex(encode(url)), '..'), lambda x: CASE WHEN regexp_matches(chr(CAST(('0x' || x) AS INTEGER)), '^[A-Za-z0-9._~-]$') THEN chr(CAST(('0x' || x) AS INTEGER)) ELSE '%' || x END), '') AS encoded FROM pages""")
def percent_encode(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#:]*)", 1).alias("host"), C.percent_encode(F.col("url")).alias("encoded"))


_ADDRESS = "'https://github.com/' || replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '.', CASE WHEN page_id % 5 = 0 THEN '.' ELSE '-' END) || '/p' || page_id || CASE page_id % 4 WHEN 0 THEN '.git' WHEN 1 THEN '/' WHEN 2 THEN '/tree' ELSE '' END"


@query(f"""SELECT page_id, CASE WHEN ok THEN string_split(address, '/')[4] || ' p' || page_id END AS repository FROM (SELECT page_id, {_ADDRESS} AS address, page_id % 5 <> 0 AND page_id % 4 <> 2 AS ok FROM pages)""")
def url_grammar(spark, d):
    """Repository addresses made of page addresses, through the parser of sources."""

    @F.pandas_udf("string")
    def parsed(addresses: pd.Series) -> pd.Series:
        def one(address: str) -> str | None:
            try:
                return " ".join(snapshot.parse_repository(address))
            except classify.BadInput:
                return None

        return addresses.map(one)

    host = F.regexp_extract("url", "^https?://([^/?#:]*)", 1)
    owner = F.when(F.col("page_id") % 5 == 0, host).otherwise(F.replace(host, F.lit("."), F.lit("-")))
    k = F.col("page_id") % 4
    tail = F.when(k == 0, ".git").when(k == 1, "/").when(k == 2, "/tree").otherwise("")
    address = F.concat(F.lit("https://github.com/"), owner, F.lit("/p"), F.col("page_id").cast("string"), tail)
    return t(spark, d, "pages").select("page_id", parsed(address).alias("repository"))


@query("""SELECT doc_id, path, NOT (path LIKE '/%' OR list_contains(string_split(path, '/'), '..') OR list_contains(string_split(path, '/'), '.git')) AS safe FROM
 (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN 'a/../' || path ELSE '.git/' || path END AS path FROM files)""", prelude=corpus.FILES_SQL)
def safe_paths(spark, d):
    p = F.col("path")
    odd = F.when(F.col("doc_id") % 4 == 0, p).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/"), p)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("a/../"), p)).otherwise(F.concat(F.lit(".git/"), p))
    return corpus.files(spark, d).select("doc_id", odd.alias("path")).withColumn("safe", C.safe_path(F.col("path")))


# -- extraction and projection --------------------------------------------------------------


def _models(spark: SparkSession, d: str) -> DataFrame:
    kept = classify.artifacts(corpus.code_files(spark, d)).filter("model_type IS NOT NULL")
    return extract.code_models(kept).select(F.col("file.provenance.source_id").alias("source_uri"), F.col("file.provenance.snapshot_id").alias("revision"), "file.path", "file.name", "code")


def _items(spark: SparkSession, d: str, array: str) -> DataFrame:
    return _models(spark, d).select("revision", "path", F.explode(f"code.{array}").alias("x"))


_SPAN = "CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(start_byte AS BIGINT) AS start_byte, CAST(end_byte AS BIGINT) AS end_byte"


@query(f"SELECT revision, path, qualified_name, name, 'function:' || start_byte || ':' || end_byte AS id, 'int' AS return_type, {_SPAN} FROM functions", prelude=corpus.CODE_SQL)
def extract_functions(spark, d):
    return _items(spark, d, "functions").select("revision", "path", "x.qualified_name", "x.name", "x.id", "x.return_type", "x.span.start_line", "x.span.end_line", "x.span.start_byte", "x.span.end_byte")


@query("SELECT revision, path, caller, callee, CAST(line AS BIGINT) AS line, 'call:' || start_byte || ':' || end_byte AS id, 'unresolved' AS resolution_status FROM calls", prelude=corpus.CODE_SQL)
def extract_calls(spark, d):
    return _items(spark, d, "calls").select("revision", "path", "x.caller", "x.callee", "x.line", "x.id", "x.resolution_status")


@query("SELECT revision, path, 'Account_' || k AS name, revision || '::Account_' || k AS qualified_name, CAST(4 AS BIGINT) AS start_line, CAST(class_at AS BIGINT) AS start_byte FROM placed", prelude=corpus.CODE_SQL)
def extract_classes(spark, d):
    return _items(spark, d, "classes").select("revision", "path", "x.name", "x.qualified_name", "x.span.start_line", "x.span.start_byte")


@query("SELECT revision, path, header AS target, CAST(1 AS BIGINT) AS line FROM placed UNION ALL SELECT revision, path, 'vector', 2 FROM placed", prelude=corpus.CODE_SQL)
def extract_includes(spark, d):
    return _items(spark, d, "includes").select("revision", "path", "x.target", F.col("x.line").cast(L).alias("line"))


def _projected(spark: SparkSession, d: str) -> DataFrame:
    """Tasks over the models, which are extracted once and stored with the fields that projections read."""
    number = F.regexp_extract("path", "([0-9]+)", 1).cast(L)
    pick = lambda array, *fields: F.transform(F.col("code")[array], lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    code = F.struct(F.col("code")["schema_version"].alias("schema_version"), pick("classes", "id", "name").alias("classes"), pick("functions", "id", "name", "qualified_name").alias("functions"), pick("calls", "id", "caller", "caller_id", "callee", "line").alias("calls"))
    return stored(_models(spark, d).withColumn("code", code), "models").select(number.alias("task_id"), F.lit(1).cast(L).alias("generation"), "source_uri", "revision", "path", "name", "code")


_PROJECTED = corpus.CODE_SQL + """, named AS (SELECT *, regexp_extract(path, '([0-9]+)', 1) || ':1' AS file_id FROM placed),
 fns AS (SELECT f.*, file_id, file_id || '::function:' || start_byte || ':' || end_byte AS id FROM functions f JOIN named USING (path)),
 sites AS (SELECT c.*, fns.file_id, fns.file_id || '::call:' || c.start_byte || ':' || c.end_byte AS id, fns.id AS owner FROM calls c JOIN fns USING (path) WHERE c.caller = fns.qualified_name)"""
_REVISION = "CAST(to_json(['https://example.org/accounts', revision]) AS VARCHAR)"


@query(f"""SELECT 'https://example.org/accounts' AS id, 'Repository' AS label, 'https://example.org/accounts' AS name WHERE (SELECT count(*) FROM named) > 0 UNION ALL SELECT DISTINCT {_REVISION}, 'Revision', revision FROM named UNION ALL SELECT file_id, 'File', path FROM named
 UNION ALL SELECT id, 'Function', name FROM fns UNION ALL SELECT id, 'CallSite', callee FROM sites""", prelude=_PROJECTED)
def projection_nodes(spark, d):
    return projection.projection_nodes(_projected(spark, d)).filter("label <> 'Class'")


@query(f"""SELECT DISTINCT 'https://example.org/accounts' AS source, 'HAS_REVISION' AS type, {_REVISION} AS target FROM named UNION ALL SELECT {_REVISION}, 'CONTAINS', file_id FROM named
 UNION ALL SELECT file_id, 'DEFINES', id FROM fns UNION ALL SELECT file_id, 'CONTAINS', id FROM sites UNION ALL SELECT owner, 'HAS_CALL_SITE', id FROM sites""", prelude=_PROJECTED)
def projection_edges(spark, d):
    return projection.projection_edges(_projected(spark, d)).filter("NOT target LIKE '%::class:%'").select("source", "type", "target")


@query("""SELECT split_part(file_id, ':', 1) || ':1::' || caller AS source, 'CALLS' AS type, split_part(file_id, ':', 1) || ':1::' || callee AS target, CAST(line AS BIGINT) AS line FROM sites""", prelude=_PROJECTED)
def projection_legacy_calls(spark, d):
    old = _projected(spark, d).withColumn("code", F.col("code").withField("schema_version", F.lit(1)))
    return projection.projection_edges(old).filter("type = 'CALLS'").select("source", "type", "target", "line")


# -- graph building -------------------------------------------------------------------------

_CORPUS_NODES = corpus.LINES_SQL + """, fid AS (SELECT *, CAST(to_json([source_uri, revision, path, CASE WHEN doc_id % 6 < 3 THEN 'code' ELSE 'document' END, CASE WHEN doc_id % 6 < 3 THEN '1' ELSE '' END]) AS VARCHAR) AS file_id FROM files WHERE doc_id % 6 < 5),
 lf AS (SELECT c.*, f.file_id, string_split(body, ' ') AS w, start_byte || ':' || (start_byte + strlen(body)) AS local FROM code_lines c JOIN fid f USING (doc_id) WHERE body <> ''),
 gnodes AS (
  SELECT DISTINCT CAST(to_json([source_uri]) AS VARCHAR) AS id, 'Repository' AS type FROM fid UNION ALL SELECT DISTINCT CAST(to_json([source_uri, revision]) AS VARCHAR), 'Revision' FROM fid
  UNION ALL SELECT file_id, 'File' FROM fid
  UNION ALL SELECT CAST(to_json(['function', file_id, 'function:' || local]) AS VARCHAR), 'Function' FROM lf
  UNION ALL SELECT CAST(to_json(['callsite', file_id, 'call:' || local]) AS VARCHAR), 'CallSite' FROM lf WHERE len(w) > 1),
 gedges AS (
  SELECT DISTINCT CAST(to_json([source_uri]) AS VARCHAR) AS source, 'HAS_REVISION' AS type, CAST(to_json([source_uri, revision]) AS VARCHAR) AS target FROM fid
  UNION ALL SELECT DISTINCT CAST(to_json([source_uri, revision]) AS VARCHAR), 'CONTAINS', file_id FROM fid
  UNION ALL SELECT file_id, 'DEFINES', CAST(to_json(['function', file_id, 'function:' || local]) AS VARCHAR) FROM lf
  UNION ALL SELECT file_id, 'CONTAINS', CAST(to_json(['callsite', file_id, 'call:' || local]) AS VARCHAR) FROM lf WHERE len(w) > 1
  UNION ALL SELECT CAST(to_json(['function', file_id, 'function:' || local]) AS VARCHAR), 'HAS_CALL_SITE', CAST(to_json(['callsite', file_id, 'call:' || local]) AS VARCHAR) FROM lf WHERE len(w) > 1)"""


def corpus_records(spark: SparkSession, d: str) -> DataFrame:
    """Model records of the corpus: one function a line, its second word as a call."""
    kept = classify.artifacts(corpus.files(spark, d)).filter("model_type IS NOT NULL")
    own = corpus.lines(spark, d).filter("body <> ''")
    words, local = F.split("body", " "), F.concat_ws(":", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"))
    span = F.struct("start_byte", "end_byte", F.col("line").cast(L).alias("start_line"), F.col("line").cast(L).alias("end_line"))
    fid = F.concat(F.lit("function:"), local)
    function = F.struct(fid.alias("id"), words[0].alias("name"), words[0].alias("qualified_name"), F.left("body", F.lit(60)).alias("signature"), F.lit("").alias("return_type"), F.lit("").alias("owner_id"), F.lit("function").alias("kind"), F.col("line").cast(L).alias("start_line"), F.col("line").cast(L).alias("end_line"), span.alias("span"))
    call = F.when(F.size(words) > 1, F.struct(F.concat(F.lit("call:"), local).alias("id"), words[0].alias("caller"), fid.alias("caller_id"), F.get(words, F.lit(1)).alias("callee"), F.lit("").alias("owner_id"), F.get(words, F.lit(1)).alias("expression"), F.col("line").cast(L).alias("line"), F.lit("unresolved").alias("resolution_status"), span.alias("span")))
    syntax = own.groupBy("path").agg(F.collect_list(function).alias("functions"), F.collect_list(call).alias("calls"))
    none = "array<struct<id:string,name:string,qualified_name:string,owner_id:string,kind:string,start_line:bigint,end_line:bigint,span:struct<start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint>>>"
    parser = F.struct(F.lit("lines").alias("name"), F.lit("1").alias("runtime_version"), F.lit("lines").alias("grammar"), F.lit("1").alias("grammar_version"), F.lit("1").alias("extractor_version"))
    joined = kept.join(syntax, "path", "left")
    types = dict(syntax.dtypes)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(types[c]))
    code = F.struct(F.lit(2).alias("schema_version"), parser.alias("parser"), F.lit("complete").alias("parse_status"), F.array().cast(none).alias("classes"), empty("functions").alias("functions"), empty("calls").alias("calls"), F.array().cast("array<struct<kind:string,message:string>>").alias("diagnostics"))
    section = F.array(F.struct(F.lit("").alias("title"), F.col("content").alias("text"), F.lit(0).cast(L).alias("start_page"), F.lit(0).cast(L).alias("end_page")))
    is_code = F.col("model_type") == "code"
    return joined.select(F.col("id").alias("artifact_id"), "model_type", classify.file_struct().alias("file"), F.when(is_code, code).alias("code"), F.when(~is_code, section).alias("sections"))


@query("SELECT id, type FROM gnodes", prelude=_CORPUS_NODES)
def graph_nodes(spark, d):
    from ..operators import build

    return build.graph_nodes(build.distinct_records(corpus_records(spark, d))[0]).select("id", "type")


@query("SELECT source, type, target FROM gedges", prelude=_CORPUS_NODES)
def graph_edges(spark, d):
    from ..operators import build

    return build.graph_edges(build.distinct_records(corpus_records(spark, d))[0]).select("source", "type", "target")


@query("SELECT 'node' AS what, type, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, CAST(count(*) AS BIGINT) FROM edges GROUP BY type", prelude=corpus.HIERARCHY_SQL)
def graph_counts_by_type(spark, d):
    nodes, edges = corpus.hierarchy(spark, d)
    one = lambda df, what: df.groupBy("type").agg(n().alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return one(nodes, "node").unionAll(one(edges, "edge"))


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    """Document records of lineitem: a file for every order and line, its text the part and supplier; rows repeat some with other texts."""
    section = F.array(F.struct(F.lit("").alias("title"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("text"), F.lit(0).cast(L).alias("start_page"), F.lit(0).cast(L).alias("end_page")))
    rows = t(spark, d, "lineitem").select(F.lit("u").alias("source_uri"), F.lit("r").alias("revision"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"), section.alias("sections"))
    file = F.struct("path", F.lit("").alias("name"), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("language"), F.lit(0).cast(L).alias("size_bytes"), F.struct(F.col("source_uri").alias("source_id"), F.col("revision").alias("snapshot_id")).alias("provenance"))
    return rows.select(F.col("path").alias("artifact_id"), F.lit("document").alias("model_type"), file.alias("file"), F.lit(None).cast(CODE_MODEL).alias("code"), "sections")


@query("SELECT CAST(to_json(['u', 'r', l_orderkey || '/' || l_linenumber, 'document', '']) AS VARCHAR) AS file_id, CAST(count(DISTINCT (l_partkey, l_suppkey)) AS BIGINT) AS versions FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def node_conflicts(spark, d):
    from ..operators import build

    return build.distinct_records(_versioned(spark, d))[1].select("file_id", F.col("versions").cast(L).alias("versions"))


@query("SELECT l_orderkey || '/' || l_linenumber AS path, l_partkey || '/' || l_suppkey AS text FROM lineitem GROUP BY ALL")
def record_dedupe(spark, d):
    from ..operators import build

    once = build.distinct_records(_versioned(spark, d).unionAll(_versioned(spark, d)))[0]
    return once.select("file.path", F.col("sections")[0]["text"].alias("text"))


@query("SELECT row_number() OVER (ORDER BY to_json([source, type, target])) AS place, source, type, target FROM edges", prelude=corpus.HIERARCHY_SQL)
def export_order_edges(spark, d):
    from ..operators import build

    return build.placed(build.ordered(*corpus.hierarchy(spark, d))[1].drop("properties")).select("place", "source", "type", "target")


@query("SELECT row_number() OVER (ORDER BY id) AS place, id, type FROM nodes", prelude=corpus.HIERARCHY_SQL)
def export_order_nodes(spark, d):
    from ..operators import build

    return build.placed(build.ordered(*corpus.hierarchy(spark, d))[0]).select("place", "id", "type")


# -- graph validation -----------------------------------------------------------------------


@query("SELECT id, CAST(count(*) AS BIGINT) AS n FROM bad_nodes GROUP BY id HAVING count(*) > 1", prelude=corpus.CORRUPTED_SQL)
def duplicate_nodes(spark, d):
    return validate.duplicate_nodes(corpus.corrupted(spark, d)[0])


@query("SELECT id, type FROM bad_nodes WHERE type = 'Widget'", prelude=corpus.CORRUPTED_SQL)
def bad_node_types(spark, d):
    return validate.bad_nodes(corpus.corrupted(spark, d)[0])


@query("SELECT DISTINCT source, type, target FROM bad_edges WHERE source NOT IN (SELECT id FROM bad_nodes) OR target NOT IN (SELECT id FROM bad_nodes)", prelude=corpus.CORRUPTED_SQL)
def dangling_edges(spark, d):
    return validate.dangling_edges(*corpus.corrupted(spark, d), lambda role, field: corpus.corrupted(spark, d, {role: field})[1])


_ALLOWED = "(VALUES ('HAS_REVISION', 'Repository', 'Revision'), ('CONTAINS', 'Revision', 'File'), ('CONTAINS', 'File', 'CallSite'), ('DEFINES', 'File', 'Function'), ('DEFINES', 'File', 'Class'), ('HAS_CALL_SITE', 'Function', 'CallSite'))"


@query(f"""SELECT e.type, s.type AS source_type, g.type AS target_type, e.source, e.target FROM bad_edges e JOIN nodes s ON e.source = s.id JOIN nodes g ON e.target = g.id
 WHERE (e.type, s.type, g.type) NOT IN (SELECT * FROM {_ALLOWED} a(x, y, z))""", prelude=corpus.CORRUPTED_SQL)
def bad_relation_types(spark, d):
    return validate.bad_relations(corpus.hierarchy(spark, d)[0], corpus.corrupted(spark, d)[1], lambda role, field: corpus.corrupted(spark, d, {role: field})[1])


@query("SELECT source, target, type, CAST(count(*) AS BIGINT) AS n FROM bad_edges GROUP BY ALL HAVING count(*) > 1", prelude=corpus.CORRUPTED_SQL)
def duplicate_edges(spark, d):
    return validate.duplicate_edges(corpus.corrupted(spark, d)[1])


@query("SELECT e.target AS revision, CAST(count(DISTINCT e.source) AS BIGINT) AS parents, CAST(count(DISTINCT e.source) FILTER (s.type = 'Repository') AS BIGINT) AS repositories FROM bad_edges e JOIN nodes s ON e.source = s.id WHERE e.target LIKE 'n:%' GROUP BY e.target HAVING count(DISTINCT e.source) <> 1", prelude=corpus.CORRUPTED_SQL)
def bad_revisions(spark, d):
    return validate.bad_revisions(corpus.hierarchy(spark, d)[0], corpus.corrupted(spark, d)[1])


@query("SELECT target AS file, CAST(count(DISTINCT source) AS BIGINT) AS parents FROM bad_edges WHERE target LIKE 'c:%' GROUP BY target HAVING count(DISTINCT source) > 1", prelude=corpus.CORRUPTED_SQL)
def multi_parent_files(spark, d):
    nodes, edges = corpus.hierarchy(spark, d)[0], corpus.corrupted(spark, d)[1]
    return validate.shared_files(edges, nodes.filter("type = 'File'").select(F.col("id").alias("file")))


@query("""SELECT 'c:' || c_custkey AS id, c_mktsegment || '/' || c_custkey || '.cpp' AS path, false AS same_provenance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_7'""")
def provenance_mismatch(spark, d):
    nodes, _ = corpus.hierarchy(spark, d)
    return validate.bad_files(nodes, nodes.filter("type = 'File'").select(F.col("id").alias("file")), "ASIA", "NATION_7")


_OWNED = corpus.HIERARCHY_SQL + """, owned AS (SELECT DISTINCT target AS node, source AS file FROM edges WHERE source LIKE 'c:%')"""


@query("""SELECT e.source, e.target FROM (SELECT source, type, target FROM edges UNION ALL SELECT 'o:' || ((o_orderkey + 1) % 1000), 'HAS_CALL_SITE', site FROM items JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 61 = 0) e
 JOIN owned s ON e.source = s.node LEFT JOIN owned g ON e.target = g.node WHERE e.type = 'HAS_CALL_SITE' AND s.file IS DISTINCT FROM g.file""", prelude=_OWNED)
def cross_file_calls(spark, d):
    _, edges = corpus.hierarchy(spark, d)
    items = t(spark, d, "lineitem").withColumn("site", corpus._site_id()).join(t(spark, d, "orders").filter("o_orderkey % 61 = 0"), F.col("l_orderkey") == F.col("o_orderkey"))
    stray = items.select(F.concat(F.lit("o:"), ((F.col("o_orderkey") + 1) % 1000).cast("string")).alias("source"), F.lit("HAS_CALL_SITE").alias("type"), F.col("site").alias("target"), F.lit("{}").alias("properties"))
    owned = lambda links: links.filter(F.col("source").startswith("c:")).select(F.col("target").alias("node"), F.col("source").alias("file"))
    return validate.stray_calls(edges.unionAll(stray), owned(edges), lambda _, field: owned(corpus.hierarchy(spark, d, ends={"target": field})[1]))


@query("SELECT n_name AS commit, r_name AS uri, 'r:' || r_regionkey AS repository, 'n:' || n_nationkey AS revision FROM nation JOIN region ON n_regionkey = r_regionkey")
def select_revision(spark, d):
    nodes, edges = corpus.hierarchy(spark, d)
    return validate.revision_owners(nodes, edges).select("commit", "uri", "repository", "revision")


_PICK = _OWNED + """, picked AS (SELECT 'c:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'),
 chosen AS (SELECT id FROM picked UNION SELECT node FROM owned WHERE file IN (SELECT id FROM picked) UNION SELECT 'n:7' UNION SELECT 'r:2'),
 sub_nodes AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM chosen)),
 sub_edges AS (SELECT * FROM edges WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen))"""


@query("SELECT source, type, target FROM sub_edges", prelude=_PICK)
def induced_subgraph(spark, d):
    return corpus.graph_of(spark, d)["edges"].select("source", "type", "target")


# -- graph queries --------------------------------------------------------------------------


@query("""SELECT 'r:' || r_regionkey AS id, 'Repository' AS type, NULL AS path FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = 'NATION_7' UNION ALL SELECT 'n:' || n_nationkey, 'Revision', NULL FROM nation WHERE n_name = 'NATION_7'
 UNION ALL SELECT 'c:' || c_custkey, 'File', path FROM own UNION ALL SELECT 'o:' || o_orderkey, 'Function', path FROM bought UNION ALL SELECT site, 'CallSite', path FROM items JOIN bought ON l_orderkey = o_orderkey""", prelude="""own AS MATERIALIZED (SELECT c_custkey, c_mktsegment || '/' || c_custkey || '.cpp' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'),
 bought AS MATERIALIZED (SELECT o_orderkey, path FROM orders JOIN own ON o_custkey = c_custkey),
 """ + corpus.HIERARCHY_SQL.split(",\nnodes AS (")[0])
def describe_symbol(spark, d):
    return graph_query.describe(corpus.graph_of(spark, d)).select("id", "type", "path")


@query("""SELECT CAST((SELECT count(*) FROM sub_nodes) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM sub_edges) AS BIGINT) AS edges, CAST((SELECT count(DISTINCT label) FROM sub_nodes WHERE type = 'File') AS BIGINT) AS files,
 coalesce((SELECT array_to_string(list_sort(list(DISTINCT label)), ',') FROM sub_nodes WHERE status = 'partial'), '') AS partial_files""", prelude=_PICK)
def graph_status(spark, d):
    return graph_query.status(corpus.graph_of(spark, d)).select("nodes", "edges", "files", F.concat_ws(",", "partial_files").alias("partial_files"))


@query("SELECT o.node, o.file, f.label AS path FROM owned o JOIN nodes f ON o.file = f.id", prelude=_OWNED)
def symbol_owner(spark, d):
    nodes, edges = corpus.hierarchy(spark, d)
    owned = validate.owners(edges, nodes.filter("type = 'File'").select(F.col("id").alias("file"))).filter("node <> file")
    return owned.join(nodes.filter("type = 'File'").select(F.col("id").alias("file"), validate.prop(F.col("properties"), "path").alias("path")), "file").select("node", "file", "path")


def _score_sql(q: str, terms: list[str], where: str = "true") -> str:
    hay = "lower(name || ' ' || qualified_name || ' ' || signature || ' ' || own_path)"
    score = " + ".join(f"CASE WHEN contains({hay}, '{x}') THEN 1 ELSE 0 END" for x in terms)
    return f"SELECT id, type, CASE WHEN id = '{q}' OR name = '{q}' OR qualified_name = '{q}' THEN 1000 ELSE {score} END AS score FROM symbols WHERE {where}"


def _scores(spark, d, q, path=""):
    return graph_query.symbol_scores(corpus.symbols(spark, d), q, path, exact_fold=False).select("id", "type", "score")


@query(f"SELECT * FROM ({_score_sql('the in the', ['the', 'in', 'the'])}) WHERE score > 0", prelude=corpus.SYMBOLS_SQL)
def find_symbols_terms(spark, d):
    return _scores(spark, d, "the in the")


@query(f"SELECT * FROM ({_score_sql('and the one', ['and', 'the', 'one'])}) WHERE score > 0", prelude=corpus.SYMBOLS_SQL)
def find_symbols_folded(spark, d):
    """With full case folding, which these terms can't tell from lower case."""
    return graph_query.symbol_scores(corpus.symbols(spark, d), "and the one").select("id", "type", "score")


@query(f"SELECT * FROM ({_score_sql('The', ['the'])}) WHERE score = 1000", prelude=corpus.SYMBOLS_SQL)
def find_symbols_exact(spark, d):
    return _scores(spark, d, "The").filter("score = 1000")


@query("SELECT * FROM (" + _score_sql("of", ["of"], "contains(path, 'en/1')") + ") WHERE score > 0", prelude=corpus.SYMBOLS_SQL)
def find_symbols_path_filter(spark, d):
    return _scores(spark, d, "of", "en/1")


@query(f"SELECT id, type, score FROM ({_score_sql('ing the and', ['ing', 'the', 'and'])}) WHERE score > 0 ORDER BY score DESC, id LIMIT 30", prelude=corpus.SYMBOLS_SQL)
def top_k_symbols(spark, d):
    return _scores(spark, d, "ing the and").orderBy(F.desc("score"), "id").limit(30)


@query("SELECT name, CAST(count(*) AS BIGINT) AS n FROM symbols WHERE name <> '' GROUP BY name HAVING count(*) > 1", prelude=corpus.SYMBOLS_SQL)
def ambiguous_names(spark, d):
    return graph_query.name_index(corpus.symbols(spark, d)).filter("n > 1")


def _hops(direction: str) -> Query:
    def run(spark, d):
        _, edges = corpus.hierarchy(spark, d)
        return graph_query.steps(edges, edges.select(F.col("source").alias("node")).filter(F.col("node").startswith("c:")).distinct(), ["DEFINES", "CONTAINS"], direction).select("node", "neighbor", "source", "target", "type")

    return run


_FROM_C = "(SELECT DISTINCT source AS node FROM edges WHERE source LIKE 'c:%') f JOIN edges e ON"
for _dir, _sql in (
    ("out", f"SELECT node, target AS neighbor, source, target, type FROM {_FROM_C} e.source = f.node WHERE type IN ('DEFINES', 'CONTAINS')"),
    ("in", f"SELECT node, source AS neighbor, source, target, type FROM {_FROM_C} e.target = f.node WHERE type IN ('DEFINES', 'CONTAINS')"),
):
    QUERIES[f"one_hop_{_dir}"] = _hops(_dir)
    ORACLE[f"one_hop_{_dir}"] = f"WITH {corpus.HIERARCHY_SQL} {_sql}"
QUERIES["one_hop_both"] = _hops("both")
ORACLE["one_hop_both"] = " UNION ALL ".join([f"(WITH {corpus.HIERARCHY_SQL} SELECT node, target AS neighbor, source, target, type FROM {_FROM_C} e.source = f.node WHERE type IN ('DEFINES', 'CONTAINS'))", f"(WITH {corpus.HIERARCHY_SQL} SELECT node, source AS neighbor, source, target, type FROM {_FROM_C} e.target = f.node WHERE type IN ('DEFINES', 'CONTAINS'))"])


def _near(depth: int) -> Query:
    def run(spark, d):
        graph = corpus.graph_of(spark, d)
        start = graph["nodes"].filter("type = 'File'").agg(F.min("id")).first()[0]
        return graph_query.reach(graph, start, graph_query.relation_set(None), "out", depth).select("id", "type").distinct()

    return run


for _depth in (1, 2, 3):
    QUERIES[f"neighborhood_d{_depth}"] = _near(_depth)
    ORACLE[f"neighborhood_d{_depth}"] = f"""WITH RECURSIVE {_PICK}, reach AS (
 SELECT min(id) AS id, 0 AS depth FROM picked UNION SELECT e.target, depth + 1 FROM reach JOIN sub_edges e ON e.source = reach.id WHERE depth < {_depth})
 SELECT DISTINCT r.id, type FROM reach r JOIN sub_nodes s ON r.id = s.id"""


@query("""SELECT row_number() OVER (ORDER BY source, target, type) AS place, source, target, type FROM sub_edges WHERE source = 'n:7' OR target = 'n:7' ORDER BY 2, 3, 4 LIMIT 10""", prelude=_PICK)
def neighborhood_truncated(spark, d):
    found = graph_query.neighborhood(corpus.graph_of(spark, d), "n:7", graph_query.relation_set(None), "both", 1, 10)
    return found["edges"].select(F.row_number().over(Window.orderBy("source", "target", "type")).cast(L).alias("place"), "source", "target", "type")


@query(f"""SELECT id, min(depth) AS hops FROM (SELECT * FROM (WITH RECURSIVE {_PICK}, reach AS (SELECT 'r:2' AS id, 0 AS depth UNION SELECT e.target, depth + 1 FROM reach JOIN sub_edges e ON e.source = reach.id WHERE depth < 6) SELECT id, CAST(depth AS BIGINT) AS depth FROM reach)) GROUP BY id""")
def path_lengths(spark, d):
    found = graph_query.levels(corpus.graph_of(spark, d), "r:2", graph_query.relation_set(None), "out", 4)
    return found.select(F.col("node").alias("id"), "hops")


@query("""SELECT 'r:' || n_regionkey AS a, 'HAS_REVISION' AS via_1, 'n:' || n_nationkey AS b, 'CONTAINS' AS via_2, min('c:' || c_custkey) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY ALL""")
def shortest_path_edges(spark, d):
    graph = corpus.graph_of(spark, d)
    target = graph["nodes"].filter("type = 'File'").agg(F.min("id")).first()[0]
    found = graph_query.shortest_path(graph, "r:2", target, ["HAS_REVISION", "CONTAINS"], 6)
    rows = [(e["source"], e["type"], e["target"]) for e in found["edges"].collect()]
    return spark.createDataFrame([(*rows[0], *rows[1][1:])], "a string, via_1 string, b string, via_2 string, c string")


@query("SELECT false AS found, false AS truncated, CAST(1 AS BIGINT) AS visited")
def path_not_found(spark, d):
    graph = corpus.graph_of(spark, d)
    target = graph["nodes"].filter("type = 'File'").agg(F.min("id")).first()[0]
    found = graph_query.shortest_path(graph, target, "r:2", ["HAS_REVISION"], 6)
    return spark.createDataFrame([(found["found"], found["truncated"], found["visited"])], "found boolean, truncated boolean, visited long")


# -- source queries -------------------------------------------------------------------------


@query("""SELECT path, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) || CASE WHEN len(string_split(content, chr(10))) > 4 THEN chr(10) ELSE '' END AS content, CAST(least(4, len(string_split(content, chr(10)))) AS BIGINT) AS end_line, CAST(len(string_split(content, chr(10))) AS BIGINT) AS total_lines, sha256(content) AS sha256
 FROM files WHERE len(string_split(content, chr(10))) > 1 AND NOT ends_with(content, chr(10))""", prelude=corpus.FILES_SQL)
def read_line_range(spark, d):
    found = source_query.read_range(corpus.files(spark, d).filter(~F.col("content").endswith("\n")), 2, 4)
    return found.filter("total_lines > 1").select("path", "content", F.col("end_line").cast(L).alias("end_line"), F.col("total_lines").cast(L).alias("total_lines"), "sha256")


@query("SELECT doc_id, line, body AS source, CAST(line AS BIGINT) AS start_line FROM code_lines WHERE body <> ''", prelude=corpus.LINES_SQL)
def symbol_source_slice(spark, d):
    spans = corpus.lines(spark, d).filter("body <> ''").select("doc_id", "line", "start_byte", "end_byte").join(corpus.files(spark, d).select("doc_id", "path", "content"), "doc_id")
    return source_query.span_source(spans).select("doc_id", F.col("line").cast(L).alias("line"), "source", F.col("start_line").cast(L).alias("start_line"))


@query("SELECT path, CAST(line AS BIGINT) AS line, left(body, 1000) AS content, length(body) > 1000 AS excerpt_truncated FROM (SELECT path, unnest(string_split(content, chr(10))) AS body, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files) WHERE contains(lower(body), 'thing')", prelude=corpus.FILES_SQL)
def search_source(spark, d):
    return source_query.matches(corpus.files(spark, d), "THING").select("path", F.col("line").cast(L).alias("line"), "content", "excerpt_truncated")


@query("SELECT path, CAST(count(*) AS BIGINT) AS n FROM (SELECT path, unnest(string_split(content, chr(10))) AS body FROM files) WHERE contains(lower(body), 'the') GROUP BY path", prelude=corpus.FILES_SQL)
def search_per_file_counts(spark, d):
    return source_query.matches(corpus.files(spark, d), "the").groupBy("path").agg(n().alias("n"))


@query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, CAST(length(html) - length(replace(html, '/', '')) AS BIGINT) AS slashes FROM pages")
def file_hashes(spark, d):
    h = F.col("html")
    return t(spark, d, "pages").select("page_id", F.sha2(F.encode(h, "UTF-8"), 256).alias("sha256"), F.octet_length(h).cast(L).alias("bytes"), (F.length(h) - F.length(F.replace(h, F.lit("/"), F.lit("")))).cast(L).alias("slashes"))


@query("""SELECT lang, doc_id, CAST(sum(strlen(text)) OVER w AS BIGINT) AS bytes, CAST(row_number() OVER w AS BIGINT) AS file_number, sum(strlen(text)) OVER w <= 100000 AND row_number() OVER w <= 40 AS searched
 FROM documents WINDOW w AS (PARTITION BY lang ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0') ROWS UNBOUNDED PRECEDING)""")
def running_total_budget(spark, d):
    docs = t(spark, d, "documents").select("lang", "doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    walk = source_query.walked(docs, 40, 100_000, partition=("lang",))
    return walk.select("lang", "doc_id", F.col("bytes").cast(L).alias("bytes"), F.col("file_number").cast(L).alias("file_number"), "searched")


@query("""SELECT page_id, row_number() OVER (ORDER BY CASE WHEN depth = 1 THEN 0 ELSE 1 END, CASE WHEN depth = 1 THEN leaf ELSE top END, leaf, page_id) AS place FROM
 (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS depth, 'd' || (page_id % 7) AS top, 'f' || page_id AS leaf FROM pages)""")
def walk_order(spark, d):
    leaf, top = F.concat(F.lit("f"), F.col("page_id").cast("string")), F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"))
    paths = t(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, leaf).otherwise(F.concat(top, F.lit("/"), leaf)).alias("path"))
    return paths.select("page_id", F.row_number().over(Window.orderBy(C.walk_key(F.col("path")), "page_id")).cast(L).alias("place"))


# -- chunks and vectors ---------------------------------------------------------------------

_CHUNKS = """cut AS (
  SELECT doc_id, encode(text) AS raw, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, raw, chunk + 1, b,
    CASE WHEN b + 1200 >= octet_length(raw) THEN octet_length(raw)
         WHEN hex(raw[b + 1201:b + 1201]) NOT BETWEEN '80' AND 'BF' THEN b + 1200
         WHEN hex(raw[b + 1200:b + 1200]) NOT BETWEEN '80' AND 'BF' THEN b + 1199
         WHEN hex(raw[b + 1199:b + 1199]) NOT BETWEEN '80' AND 'BF' THEN b + 1198
         ELSE b + 1197 END
  FROM cut WHERE b < octet_length(raw)),
pieces AS (SELECT doc_id, chunk - 1 AS chunk, a AS byte_start, b AS byte_end, decode(raw[a + 1:b]) AS text FROM cut WHERE chunk > 0)"""


@query("SELECT doc_id, chunk, byte_start, byte_end, text FROM pieces", prelude=_CHUNKS)
def chunk_utf8(spark, d):
    return chunks.chunks(t(spark, d, "documents").select("doc_id", F.col("text").alias("content")), keep=["doc_id"])


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks, CAST(max(byte_end) AS BIGINT) AS bytes FROM pieces GROUP BY doc_id", prelude=_CHUNKS)
def chunk_counts(spark, d):
    cut = chunks.chunks(t(spark, d, "documents").select("doc_id", F.col("text").alias("content")), keep=["doc_id"])
    return cut.groupBy("doc_id").agg(n().alias("chunks"), F.max("byte_end").alias("bytes"))


@query("""SELECT id[1:8] || '-' || id[9:12] || '-' || id[13:16] || '-' || id[17:20] || '-' || id[21:32] AS id, doc_id AS task_id, chunk, byte_start, byte_end, path FROM
 (SELECT p.*, path, printf('%016x', doc_id) || printf('%08x', doc_id % 3 + 1) || printf('%08x', chunk) AS id FROM pieces p JOIN files USING (doc_id))""", prelude=corpus.FILES_SQL + ", " + _CHUNKS)
def chunk_points(spark, d):
    tasks = corpus.files(spark, d).select(F.col("doc_id").alias("task_id"), (F.col("doc_id") % 3 + 1).alias("generation"), C.identity(F.col("source_uri"), F.col("revision"), F.col("path")).alias("artifact_id"), "source_uri", "revision", "path", "content")
    return chunks.points(tasks, "none").select("id", "task_id", "chunk", "byte_start", "byte_end", "path")


@query("SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(min(len(embedding)) AS BIGINT) AS least, CAST(max(len(embedding)) AS BIGINT) AS most, CAST(count(*) FILTER (len(embedding) <> 64 OR vec_id % 9 = 0) AS BIGINT) AS bad FROM embeddings")
def embedding_checks(spark, d):
    v = t(spark, d, "embeddings")
    nan = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    spoilt = v.select(F.when(F.col("vec_id") % 9 == 0, nan).otherwise(F.col("embedding")).alias("embedding"))
    bad = chunks.bad_vectors(spoilt, "embedding", 64).agg(n().alias("bad"))
    return v.agg(n().alias("vectors"), F.min(F.size("embedding")).cast(L).alias("least"), F.max(F.size("embedding")).cast(L).alias("most")).join(bad, F.lit(True))


@query("""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def cosine_topk(spark, d):
    v = t(spark, d, "embeddings")
    return chunks.cosine_top(v, v.filter("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.col("rank").cast(L).alias("rank"))


# -- upserts and the task log ---------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_wins_upsert(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return queue.upserted(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS artifact_id, event_type AS target, CASE WHEN arg_max(value, event_id) FILTER (event_id % 2 = 0) IS DISTINCT FROM arg_max(value, event_id) FILTER (event_id % 2 = 1) THEN 2 ELSE 1 END::BIGINT AS generation
 FROM events GROUP BY ALL HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 = 1) > 0""")
def changed_payloads(spark, d):
    """The latest even event of a key as its state, the latest odd one as what is wanted: a changed value is a new generation."""
    keys = [F.col("user_id").cast("string").alias("artifact_id"), F.col("event_type").alias("target")]
    side = lambda odd: queue.latest(t(spark, d, "events").filter(F.col("event_id") % 2 == odd).select(*keys, F.col("value").alias("payload"), "event_id"), ["artifact_id", "target"], "event_id").drop("event_id")
    state = side(0).select("*", F.lit(1).cast(L).alias("generation"), F.lit("completed").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast(L).alias("claim_token"), F.lit(None).cast("timestamp_ntz").alias("lease_until"), _now().alias("available_at"))
    after = queue.enqueued(state, side(1), _now())
    both = side(0).select("artifact_id", "target").join(side(1).select("artifact_id", "target"), ["artifact_id", "target"])
    return after.join(both, ["artifact_id", "target"]).select("artifact_id", "target", "generation")


@query("SELECT CAST(doc_id AS VARCHAR) AS artifact_id, target FROM documents, (VALUES ('vector'), ('graph')) v(target)")
def task_fanout(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"))
    return queue.fan_out(docs, docs.withColumn("model", F.lit("{}"))).select("artifact_id", "target")


_TASKS = f"""tasks AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS artifact_id, CASE WHEN event_id % 2 = 0 THEN 'vector' ELSE 'graph' END AS target,
  CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts,
  CASE WHEN event_type = 'view' THEN event_id * 10 END AS claim_token, CASE WHEN event_type = 'view' THEN ts + INTERVAL 300 SECOND END AS lease_until, ts AS available_at FROM events),
 due AS (SELECT * FROM tasks WHERE (status IN ('pending', 'failed') AND available_at <= {NOW}) OR (status = 'running' AND lease_until <= {NOW}))"""


def tasks_of(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    running = kind == "view"
    return t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("artifact_id"), F.when(F.col("event_id") % 2 == 0, "vector").otherwise("graph").alias("target"),
        F.when(kind == "click", "pending").when(running, "running").when(kind == "error", "failed").otherwise("completed").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(running, F.col("event_id") * 10).alias("claim_token"), F.when(running, F.col("ts") + F.make_dt_interval(secs=F.lit(300))).alias("lease_until"), F.col("ts").alias("available_at"), F.lit(None).cast("string").alias("last_error"),
    )


def _now() -> F.Column:
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query("SELECT id, target, status FROM due", prelude=_TASKS)
def claimable_tasks(spark, d):
    return queue.claimable(tasks_of(spark, d), _now()).select("id", "target", "status")


@query("SELECT id, target, turn FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY available_at, id) AS turn FROM due) WHERE turn <= 100", prelude=_TASKS)
def next_claims(spark, d):
    return queue.next_claims(tasks_of(spark, d), _now(), 100).select("id", "target", F.col("turn").cast(L).alias("turn"))


@query(f"SELECT id, CAST(attempts + 1 AS INTEGER) AS attempts, 1000 + row_number() OVER (ORDER BY target, available_at, id) - 1 AS claim_token, {NOW} + INTERVAL 300 SECOND AS lease_until FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY available_at, id) AS turn FROM due) WHERE turn <= 10", prelude=_TASKS)
def claimed_tasks(spark, d):
    return queue.claimed(queue.next_claims(tasks_of(spark, d), _now(), 10), _now(), 1000).select("id", "attempts", F.col("claim_token").cast(L).alias("claim_token"), "lease_until")


@query(f"SELECT id FROM tasks WHERE status = 'running' AND lease_until <= {NOW}", prelude=_TASKS)
def lease_expired(spark, d):
    return queue.claimable(tasks_of(spark, d), _now()).filter("status = 'running'").select("id")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Workers that report on every task with the token they hold: a third of them a stale one."""
    token = F.col("event_id") * 10 + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    action = F.when(F.col("event_id") % 5 == 0, "renew").when(F.col("event_id") % 5 < 3, "complete").otherwise("fail")
    return t(spark, d, "events").select(F.col("event_id").alias("id"), token.alias("claim_token"), action.alias("action"), F.lit("broken").alias("error"))


_EARLY = "TIMESTAMP '2024-01-02 00:00:00'"


@query(f"SELECT id, coalesce(id % 3 <> 0 AND status = 'running' AND lease_until > {_EARLY}, false) AS ok FROM tasks", prelude=_TASKS)
def complete_guard(spark, d):
    return queue.held(tasks_of(spark, d), _requests(spark, d), F.expr(_EARLY.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id", "ok")


@query(f"""SELECT id, CASE WHEN NOT ok OR id % 5 = 0 THEN status WHEN id % 5 < 3 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN ok AND id % 5 >= 3 THEN {_EARLY} + INTERVAL 60 SECOND ELSE available_at END AS available_at,
 CASE WHEN ok AND id % 5 <> 0 THEN NULL ELSE claim_token END AS claim_token, CASE WHEN ok AND id % 5 >= 3 THEN 'broken' END AS last_error,
 CASE WHEN ok AND id % 5 <> 0 THEN NULL WHEN ok THEN {_EARLY} + INTERVAL 300 SECOND ELSE lease_until END AS lease_until
 FROM (SELECT *, coalesce(id % 3 <> 0 AND status = 'running' AND lease_until > {_EARLY}, false) AS ok FROM tasks)""", prelude=_TASKS)
def fail_retry_state(spark, d):
    after = queue.transitions(tasks_of(spark, d), _requests(spark, d), F.expr(_EARLY.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return after.select("id", "status", "available_at", "claim_token", "last_error", "lease_until")


@query("""SELECT CAST(doc_id AS VARCHAR) AS artifact_id, 'graph' AS target, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS generation, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS status FROM documents""")
def enqueue_generations(spark, d):
    docs = t(spark, d, "documents")
    key = F.col("doc_id").cast("string").alias("artifact_id")
    state = docs.filter("doc_id % 2 = 1 OR doc_id % 3 = 0").select(key, F.lit("graph").alias("target"), F.col("lang").alias("payload"), F.lit(1).cast(L).alias("generation"), F.lit("completed").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast(L).alias("claim_token"), F.lit(None).cast("timestamp_ntz").alias("lease_until"), _now().alias("available_at"))
    wanted = docs.select(key, F.lit("graph").alias("target"), F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang")).alias("payload"))
    return queue.enqueued(state, wanted, _now()).select("artifact_id", "target", "generation", "status")


@query(f"""SELECT 'place' AS rule, source || '/' || lang || '/' || sha256(text) AS key FROM documents GROUP BY source, lang, text HAVING count(*) > 1
 UNION ALL SELECT 'task', artifact_id || '/' || target FROM tasks GROUP BY artifact_id, target HAVING count(*) > 1
 UNION ALL SELECT 'orphan', artifact_id || '/' || target FROM tasks WHERE artifact_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
 UNION ALL SELECT 'state', artifact_id || '/' || target FROM tasks WHERE id % 7 = 0""", prelude=_TASKS)
def constraint_checks(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("source").alias("source_uri"), F.col("lang").alias("revision"), F.sha2(F.encode("text", "UTF-8"), 256).alias("path"))
    odd = tasks_of(spark, d).withColumn("status", F.when(F.col("id") % 7 == 0, "lost").otherwise(F.col("status")))
    return queue.broken_constraints(rows, odd)


# -- evidence and evaluation ----------------------------------------------------------------

_SAID = """said AS (SELECT conv_id, turn, role, text, 'see [ev-' || (turn + 1) || '] and [ev-' || (conv_id % 4) || '], [ev-' || (turn + 1) || '] ' || left(text, 20) AS answer, role || ':' || md5(text) AS identity FROM conversations)"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    turn, conv = (F.col("turn") + 1).cast("string"), (F.col("conv_id") % 4).cast("string")
    answer = F.concat(F.lit("see [ev-"), turn, F.lit("] and [ev-"), conv, F.lit("], [ev-"), turn, F.lit("] "), F.left("text", F.lit(20)))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", "text", answer.alias("answer"), F.concat("role", F.lit(":"), F.md5(F.encode("text", "UTF-8"))).alias("identity"))


_CITED = "list_filter(['ev-' || (turn + 1), 'ev-' || (conv_id % 4)], lambda x, i: i = 1 OR turn + 1 <> conv_id % 4)"


@query(f"SELECT conv_id, turn, array_to_string({_CITED}, ',') AS citations FROM said", prelude=_SAID)
def citation_extract(spark, d):
    return _said(spark, d).select("conv_id", "turn", F.concat_ws(",", evidence.citations(F.col("answer"))).alias("citations"))


@query("""SELECT conv_id, identity, min(turn) AS turn, 'ev-' || row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS evidence_id FROM said GROUP BY conv_id, identity""", prelude=_SAID)
def evidence_ids(spark, d):
    return evidence.interned(_said(spark, d), "conv_id", "identity", "turn").select("conv_id", "identity", "turn", "evidence_id")


@query("""SELECT conv_id, array_to_string(list_sort(list(DISTINCT 'ev-' || (turn + 1))), ',') AS delivered FROM said WHERE length(text) <= 400 GROUP BY conv_id""", prelude=_SAID)
def delivered_set(spark, d):
    events = _said(spark, d).filter(F.length("text") <= 400).select("conv_id", F.array(F.concat(F.lit("ev-"), (F.col("turn") + 1).cast("string"))).alias("ids"))
    return evidence.delivered(events, "conv_id", "ids").select("conv_id", F.concat_ws(",", "delivered").alias("delivered"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter({_CITED}, lambda x: x NOT IN ('ev-1', 'ev-2')), ',') AS invalid, len(list_filter({_CITED}, lambda x: x NOT IN ('ev-1', 'ev-2'))) = 0 AS valid FROM said", prelude=_SAID)
def citation_audit(spark, d):
    known = F.array(*map(F.lit, ("ev-1", "ev-2", "ev-3")))
    sent = F.array(*map(F.lit, ("ev-1", "ev-2", "ev-9")))
    return evidence.audited(_said(spark, d), known, sent).select("conv_id", "turn", F.concat_ws(",", "invalid_citations").alias("invalid"), F.col("citations_valid").alias("valid"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3 AS admitted FROM conversations""")
def tool_call_budget(spark, d):
    calls = t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.lit(0).alias("round"), F.col("turn").alias("call"))
    return evidence.within_budget(calls, per_round=3).select(F.col("session_id").alias("conv_id"), F.col("call").alias("turn"), "admitted")


@query("SELECT conv_id, turn, array_to_string(list_filter(['the', 'Und', 'ZZZ'], lambda x: NOT contains(lower(text), lower(x))), ',') AS missing FROM conversations")
def missing_terms(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", evidence.missing_terms(F.col("text"), F.array(*map(F.lit, ("the", "Und", "ZZZ"))))).alias("missing"))


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (length(text) < 30) = 0 THEN CAST(sum(length(text)) AS BIGINT) END AS tokens FROM conversations GROUP BY conv_id""")
def token_totals(spark, d):
    counts = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.when(F.length("text") >= 30, F.length("text").cast(L)).alias("n"))).alias("c"))
    return counts.select("conv_id", evidence.whole_sum(F.transform("c", lambda x: x["n"])).alias("tokens"))


@query("""SELECT conv_id AS task_id, array_to_string(list_filter(['the', 'und'], lambda x: NOT contains(lower(answer), x)), ',') AS missing, CAST(tool_calls AS BIGINT) AS tool_calls, CAST(tool_errors AS BIGINT) AS tool_errors, len(list_filter(['the', 'und'], lambda x: NOT contains(lower(answer), x))) = 0 AND tool_calls > 1 AS checks_passed
 FROM (SELECT conv_id, arg_max(text, turn) AS answer, count(*) AS tool_calls, count(*) FILTER (length(text) > 500) AS tool_errors FROM conversations GROUP BY conv_id)""")
def evaluate_reports(spark, d):
    runs = t(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.collect_list(F.when(F.length("text") > 500, "error").otherwise("ok")).alias("statuses"))
    none = F.array().cast("array<string>")
    counts = F.array().cast("array<bigint>")
    reports = runs.select(F.col("conv_id").alias("task_id"), F.lit("graph").alias("mode"), F.lit("answered").alias("completion"), "answer", F.array(F.lit("the"), F.lit("und")).alias("terms"), none.alias("expected_paths"), none.alias("cited_paths"), (F.size("statuses") > 1).alias("citations_valid"), "statuses", counts.alias("input_tokens"), counts.alias("output_tokens"))
    return evidence.evaluated(reports).select("task_id", F.concat_ws(",", "missing_answer_terms").alias("missing"), F.col("tool_calls").cast(L).alias("tool_calls"), F.col("tool_errors").cast(L).alias("tool_errors"), "checks_passed")


@query("SELECT item_id, mode FROM benchmark, (VALUES ('source-only'), ('graph')) m(mode)")
def compare_matrix(spark, d):
    return evidence.comparison(t(spark, d, "benchmark").select("item_id")).select("item_id", "mode")
