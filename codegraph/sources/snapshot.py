"""Sources of files: a registry, repository snapshots over a transport, local checkouts.

The GitHub source is a Spark Python data source: planning lists the tree (one
small request on the driver), partitions are slices of it, and the executors
fetch blobs.  The transport is a picklable callable (url, headers) ->
(status, body), so tests inject canned answers; the default one uses urllib
with the limits below.
"""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import EXCLUDED_DIRECTORIES
from ..operators.classify import MAX_FILE_BYTES, MAX_SNAPSHOT_BYTES, BadInput
from ..schemas import EXTENSIONS

FILES = "source_uri string, revision string, path string, content string"
API = "https://api.github.com"
MAX_BODY_BYTES, TIMEOUT_SECONDS = 16 << 20, 60
# What a status of the service means.
STATUS_HINTS = {401: "check the access token", 403: "access denied or rate limit reached", 429: "access denied or rate limit reached", 404: "repository or revision not found", 409: "repository is empty"}
SOURCE_TYPES = ("github", "local-file", "database")
Transport = Callable[[str, dict], tuple[int, bytes]]


@dataclass
class Request:
    type: str
    uri: str
    options: dict = field(default_factory=dict)


class SourceRegistry:
    """Source type -> creator(spark, request) of a files DataFrame."""

    def __init__(self) -> None:
        self._creators: dict[str, Callable[[SparkSession, Request], DataFrame]] = {}

    def register(self, kind: str, creator: Callable[[SparkSession, Request], DataFrame] | None) -> None:
        if creator is None:
            raise BadInput("a source needs a creator")
        if kind in self._creators:
            raise BadInput(f"source {kind} is registered already")
        self._creators[kind] = creator

    def create(self, spark: SparkSession, request: Request) -> DataFrame:
        if not request.uri:
            raise BadInput("a source needs a URI")
        if request.type not in self._creators:
            raise BadInput(f"unknown source: {request.type}")
        made = self._creators[request.type](spark, request)
        if made is None:
            raise BadInput(f"source {request.type} gave nothing")
        return made


def source_type(name: str) -> str:
    if name not in SOURCE_TYPES:
        raise BadInput(f"unknown source type: {name}")
    return name


def default_registry(transport: Transport | None = None) -> SourceRegistry:
    """github works; the other two are known but not implemented."""

    def missing(spark: SparkSession, request: Request) -> DataFrame:
        raise NotImplementedError(f"{request.type} sources are not implemented yet")

    registry = SourceRegistry()
    registry.register("github", lambda spark, r: github_files(spark, r.uri, r.options.get("ref"), transport))
    registry.register("local-file", missing)
    registry.register("database", missing)
    return registry


def parse_repository(uri: str) -> tuple[str, str]:
    """(owner, name) of a repository URL."""
    m = re.fullmatch(r"https://github\.com/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+)/?", uri)
    if not m:
        raise BadInput("expected https://github.com/<owner>/<repository>")
    name = m[2][:-4] if m[2].endswith(".git") and len(m[2]) > 4 else m[2]
    if name in (".", ".."):
        raise BadInput("invalid repository name")
    return m[1], name


def default_transport(url: str, headers: dict) -> tuple[int, bytes]:
    """One HTTPS request without redirects, within size and time limits."""
    import http.client

    parts = urllib.parse.urlsplit(url)
    connection = http.client.HTTPSConnection(parts.netloc, timeout=TIMEOUT_SECONDS)
    try:
        connection.request("GET", parts.path + (f"?{parts.query}" if parts.query else ""), headers=headers)
        answer = connection.getresponse()
        body = answer.read(MAX_BODY_BYTES + 1)
    finally:
        connection.close()
    if len(body) > MAX_BODY_BYTES:
        raise BadInput("response over 16 MiB")
    return answer.status, body


def supported_path(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return bool(stem) and dot + ext in EXTENSIONS


class GithubClient:
    """The four requests of a snapshot: repository, commit, tree, blob."""

    def __init__(self, transport: Transport | None = None, token: str = "") -> None:
        if re.search(r"[\r\n\0]", token):
            raise BadInput("invalid access token")
        self.transport = transport or default_transport
        self.headers = {"User-Agent": "codegraph", "Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def get(self, path: str, accept: str | None = None) -> bytes:
        status, body = self.transport(API + path, self.headers | ({"Accept": accept} if accept else {}))
        if status != 200:
            hint = STATUS_HINTS.get(status, "unexpected redirect" if 300 <= status < 400 else "request failed")
            raise BadInput(f"HTTP {status}: {hint}")
        return body

    def json(self, path: str) -> dict:
        body = self.get(path)
        try:
            found = json.loads(body)
        except ValueError as error:
            raise BadInput("the service answered without JSON") from error
        if not isinstance(found, dict):
            raise BadInput("the service answered with an unexpected form")
        return found

    def tree(self, uri: str, ref: str | None = None) -> tuple[str, str, list[dict]]:
        """(repository path, commit, file entries) of a snapshot."""
        owner, name = parse_repository(uri)
        base = f"/repos/{owner}/{name}"
        ref = ref or self.json(base).get("default_branch")
        if not ref:
            raise BadInput("the repository has no default branch")
        commit = self.json(f"{base}/commits/{urllib.parse.quote(ref, safe='-._~')}")
        sha, root = commit.get("sha", ""), commit.get("commit", {}).get("tree", {}).get("sha", "")
        for value in (sha, root):
            if not re.fullmatch("[0-9a-fA-F]{40}", str(value)):
                raise BadInput("the service answered with an invalid object id")
        listing = self.json(f"{base}/git/trees/{root}?recursive=1")
        if listing.get("truncated") is not False:
            raise BadInput("the tree is too large to list whole")
        entries = [e for e in listing.get("tree", []) if e.get("type") == "blob" and e.get("mode") in ("100644", "100755")]
        total = 0
        for e in entries:
            size = e.get("size") or 0
            if supported_path(e["path"]):
                total += size
                if size > MAX_FILE_BYTES:
                    raise BadInput(f"file over 8 MiB: {e['path']}")
        if total > MAX_SNAPSHOT_BYTES:
            raise BadInput("snapshot over 64 MiB")
        return base, sha, entries

    def blob(self, base: str, sha: str) -> str:
        raw = self.get(f"{base}/git/blobs/{sha}", "application/vnd.github.raw+json")
        if len(raw) > MAX_FILE_BYTES:
            raise BadInput("file over 8 MiB")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as error:
            raise BadInput("file is not UTF-8") from error


class _Slice(InputPartition):
    def __init__(self, base: str, revision: str, entries: list[tuple[str, str]]) -> None:
        self.base, self.revision, self.entries = base, revision, entries


class _Reader(DataSourceReader):
    def __init__(self, uri: str, ref: str | None, transport: Transport | None, token: str, per_slice: int) -> None:
        self.uri, self.ref, self.transport, self.token, self.per_slice = uri, ref, transport, token, per_slice

    def partitions(self) -> list[_Slice]:
        base, revision, entries = GithubClient(self.transport, self.token).tree(self.uri, self.ref)
        pairs = [(e["path"], e["sha"]) for e in entries]
        return [_Slice(base, revision, pairs[i : i + self.per_slice]) for i in range(0, len(pairs), self.per_slice)] or [_Slice(base, revision, [])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        """Unsupported paths stay as rows without content, to be counted as skipped."""
        client, fetched = GithubClient(self.transport, self.token), 0
        for path, sha in partition.entries:
            content = client.blob(partition.base, sha) if supported_path(path) else ""
            fetched += len(content.encode())
            if fetched > MAX_SNAPSHOT_BYTES:  # whatever sizes the tree declared
                raise BadInput("snapshot over 64 MiB")
            yield self.uri, partition.revision, path, content


def github_source(transport: Transport | None = None, token: str = "") -> type[DataSource]:
    """A data source class bound to a transport; register it with spark.dataSource.register."""

    class GithubSnapshot(DataSource):
        @classmethod
        def name(cls) -> str:
            return "github_snapshot"

        def schema(self) -> str:
            return FILES

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options["uri"], self.options.get("ref"), transport, token, int(self.options.get("filesPerPartition", "50")))

    return GithubSnapshot


def github_files(spark: SparkSession, uri: str, ref: str | None = None, transport: Transport | None = None, token: str = "") -> DataFrame:
    parse_repository(uri)
    spark.dataSource.register(github_source(transport, token))
    reader = spark.read.format("github_snapshot").option("uri", uri)
    return (reader.option("ref", ref) if ref else reader).load()


def checkout_files(spark: SparkSession, root: str, source_uri: str = "", revision: str = "") -> DataFrame:
    """Files below a folder as rows, without the excluded directories; unreadable text keeps null content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), base, -1)
    rows = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("content_bytes"))
    parts = F.split("path", "/")
    kept = rows.filter(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED_DIRECTORIES))))
    text = F.when(F.is_valid_utf8(F.col("content_bytes").cast("string")), F.col("content_bytes").cast("string"))
    return kept.select(F.lit(source_uri).alias("source_uri"), F.lit(revision).alias("revision"), "path", text.alias("content"), "size_bytes", "content_bytes")


def model_records(spark: SparkSession, folder: str) -> DataFrame:
    """The .json model records of a folder, not of its subfolders, numbered by path."""
    from pyspark.sql import Window

    from ..schemas import MODEL_RECORD

    rows = spark.read.schema(MODEL_RECORD).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("record", F.row_number().over(Window.orderBy(F.col("_metadata.file_path"))))


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph.json after the checks of its form."""
    raw = spark.read.text(path, wholetext=True)
    top = raw.select(F.json_object_keys("value").alias("keys"), F.get_json_object("value", "$.schema_version").alias("version"), F.get_json_object("value", "$.nodes").alias("nodes"), F.get_json_object("value", "$.edges").alias("edges"))
    head = top.select("keys", "version", F.left("nodes", F.lit(1)).alias("n"), F.left("edges", F.lit(1)).alias("e")).first()
    if head is None or head["keys"] is None or head["version"] != "1":
        raise BadInput("expected graph schema_version 1")
    if sorted(head["keys"]) != ["edges", "nodes", "schema_version"]:
        raise BadInput("unexpected graph fields")
    if head["n"] != "[" or head["e"] != "[":
        raise BadInput("nodes and edges must be arrays")
    items = lambda c: top.select(F.explode(F.from_json(c, "array<string>")).alias("item"))
    get = lambda k: F.get_json_object("item", f"$.{k}").alias(k)
    for column, keys, label in (("nodes", ["id", "properties", "type"], "node"), ("edges", ["properties", "source", "target", "type"], "edge")):
        wrong = items(column).filter(~F.coalesce(F.array_sort(F.json_object_keys("item")) == F.array(*map(F.lit, keys)), F.lit(False)))
        if wrong.limit(1).collect():
            raise BadInput(f"invalid {label} record")
    return items("nodes").select(get("id"), get("type"), get("properties")), items("edges").select(get("source"), get("type"), get("target"), get("properties"))
