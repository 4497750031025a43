"""The worker that carries index tasks out, and the stores it writes to.

Tables of one run are published together (see sources.sinks), so artifacts,
models and tasks are always those of one version.  A worker claims a batch of
due tasks of a target, writes them as one DataFrame, renewing its leases
between steps, and completes them; on an error it fails the batch and stops
with that target.  Writes are keyed, so a task that is carried out twice
changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks, projection, queue
from .operators.classify import BadInput, fail_on
from .sources import sinks

#: Tasks of a target that one run takes on.
TASKS_PER_RUN = 100
TASK = "id long, artifact_id string, target string, payload string, generation long, status string, attempts int, claim_token long, lease_until timestamp_ntz, available_at timestamp_ntz, last_error string"
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_.\-]{0,127}")


@dataclass(frozen=True)
class IndexConfig:
    """Names and addresses of an index; checked, as they go into paths and headers."""

    collection: str = "code_chunks"
    model: str = "embedder"
    url: str = ""
    user: str = ""
    password: str = ""

    def __post_init__(self) -> None:
        for name in ("collection", "model"):
            if not _IDENTIFIER.fullmatch(getattr(self, name)):
                raise BadInput(f"{name} is no identifier")
        if any(ord(c) < 32 or ord(c) == 127 for value in (self.url, self.user, self.password) for c in value):
            raise BadInput("addresses and credentials hold no control characters")
        if ":" in self.user:
            raise BadInput("a user name holds no colon")

    def authorization(self) -> str:
        """The header value of basic credentials."""
        import base64

        return "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()


def checked_response(status: int, body: bytes) -> dict:
    """The object of a backend's answer; other statuses than 2xx and answers that name errors raise."""
    if not 200 <= status < 300:
        raise BadInput(f"the backend answered {status}")
    found = json.loads(body or b"{}")
    if not isinstance(found, dict) or found.get("errors"):
        raise BadInput("the backend answered with errors")
    return found


class VectorTable:
    """Points with vectors, keyed by point id, in a folder; one dimension, cosine metric."""

    def __init__(self, spark: SparkSession, root: str, collection: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/{collection}"

    def bootstrap(self, dimension: int) -> None:
        """Create the collection, or check that the one that exists is of this kind."""
        want = {"dimension": dimension, "metric": "cosine"}
        found = sinks.read_text(self.spark, f"{self.path}/collection.json")
        if found is None:
            sinks.write_text(self.spark, f"{self.path}/collection.json", json.dumps(want))
        elif json.loads(found) != want:
            raise BadInput(f"the collection is {found}, not of dimension {dimension}")

    def upsert(self, points: DataFrame) -> None:
        """Add points (id, chunk, …, vector); equal ids replace earlier ones when read."""
        first = points.select(F.size("vector").alias("n")).limit(1).collect()
        if not first:
            return
        fail_on(chunks.bad_vectors(points, dimension=first[0]["n"]), "A vector is empty, not finite or of another dimension", "id")
        fail_on(points.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "More than one vector for a chunk", "id")
        self.bootstrap(first[0]["n"])
        points.withColumn("written", F.lit(sinks.next_number(self.spark, f"{self.path}/points"))).write.mode("append").partitionBy("written").parquet(f"{self.path}/points")

    def read(self) -> DataFrame:
        points = self.spark.read.parquet(f"{self.path}/points")
        return queue.latest(points, ["id"], "written").drop("written")


def vector_writer(table: VectorTable, config: IndexConfig, embed: Callable[[list[str]], list[list[float]]]):
    """Writes tasks (task_id, generation, artifact_id, source_uri, revision, path, content) as points."""

    def write(tasks: DataFrame, renew: Callable[[], None]) -> None:
        pieces = chunks.points(tasks, config.model)
        renew()
        table.upsert(chunks.embedded(pieces, embed).persist())

    return write


def graph_writer(spark: SparkSession, root: str):
    """Merges the projection of tasks (…, name, code) into the tables nodes and edges of a folder."""

    def write(tasks: DataFrame, renew: Callable[[], None]) -> None:
        old = sinks.published(spark, root) if sinks.is_published(spark, root) else {}
        new = {"nodes": projection.projection_nodes(tasks), "edges": projection.projection_edges(tasks)}
        nodes = new["nodes"].unionByName(old["nodes"]) if old else new["nodes"]
        merged = {"nodes": nodes.groupBy("id", "label").agg(F.max("name").alias("name")), "edges": (new["edges"].unionByName(old["edges"]) if old else new["edges"]).distinct()}
        renew()
        fail_on(projection.broken_uniqueness(merged["nodes"]), "Two nodes of a label share an id", "id")
        sinks.publish(spark, merged, root)

    return write


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables of an index, unless it has some."""
    if not sinks.is_published(spark, root):
        from .schemas import MODEL_RECORD

        artifacts = spark.createDataFrame([], "artifact_id string, source_uri string, revision string, path string, content string, model_type string")
        sinks.publish(spark, {"artifacts": artifacts, "models": spark.createDataFrame([], MODEL_RECORD), "tasks": spark.createDataFrame([], TASK)}, root)


def store(spark: SparkSession, root: str, artifacts: DataFrame, models: DataFrame, now: Column | None = None) -> None:
    """Upsert artifacts and models and enqueue both targets of what changed, in one version."""
    create_tables(spark, root)
    old, now = sinks.published(spark, root), F.lit(now) if now is not None else F.current_timestamp().cast("timestamp_ntz")
    columns = old["artifacts"].columns
    merge = lambda name, new, key: queue.upserted(old[name].withColumn("_v", F.lit(0)), new.withColumn("_v", F.lit(1)), [key], "_v").drop("_v")
    merged = {"artifacts": merge("artifacts", artifacts.select(columns), "artifact_id"), "models": merge("models", models.select(old["models"].columns), "artifact_id")}
    payload = models.select("artifact_id", F.sha2(F.to_json(F.struct(*[c for c in models.columns if c != "artifact_id"])), 256).alias("payload"))
    wanted = queue.fan_out(artifacts.select("artifact_id"), payload).select("artifact_id", "target", "payload")
    state = queue.enqueued(old["tasks"], wanted, now)
    kept = old["tasks"].select("artifact_id", "target", F.col("id").alias("_id"), F.col("last_error").alias("_e"), F.col("generation").alias("_g"))
    state = state.join(kept, ["artifact_id", "target"], "left")
    number = F.xxhash64("artifact_id", "target").bitwiseAND(F.lit((1 << 62) - 1))
    tasks = state.withColumn("id", F.coalesce("_id", number)).withColumn("last_error", F.when(F.col("_g") == F.col("generation"), F.col("_e")))
    sinks.publish(spark, merged | {"tasks": tasks.select(old["tasks"].columns)}, root)


def run_worker(spark: SparkSession, root: str, target: str, write: Callable[[DataFrame, Callable[[], None]], None], most: int = TASKS_PER_RUN, lease: int = queue.LEASE_SECONDS) -> dict:
    """One run for a target: claim, write, complete; on an error fail the claims and stop."""
    if target not in queue.TARGETS:
        raise BadInput(f"unknown target {target}")
    queue.check_seconds(lease)
    now = F.current_timestamp().cast("timestamp_ntz")
    tables = sinks.published(spark, root)
    due = queue.next_claims(tables["tasks"].filter(F.col("target") == target), now, most).drop("turn")
    first = (tables["tasks"].agg(F.max("claim_token")).first()[0] or 0) + 1
    mine = spark.createDataFrame(queue.claimed(due, now, first, lease).collect(), tables["tasks"].schema)  # at most `most` rows
    held = mine.select("id", "claim_token")

    def publish(tasks: DataFrame) -> None:
        current = sinks.published(spark, root)
        sinks.publish(spark, {"artifacts": current["artifacts"], "models": current["models"], "tasks": tasks}, root)

    def step(action: str, error: str | None = None) -> None:
        asked = held.withColumn("action", F.lit(action)).withColumn("error", F.lit(error).cast("string"))
        publish(queue.transitions(sinks.published(spark, root)["tasks"], asked, now, lease))

    count = mine.count()
    if not count:
        return {"target": target, "completed": 0, "failed": 0}
    publish(tables["tasks"].join(mine, "id", "left_anti").unionByName(mine))
    places = tables["artifacts"].select("artifact_id", "source_uri", "revision", "path", "content")
    models = tables["models"].select("artifact_id", "code")
    work = mine.select(F.col("id").alias("task_id"), "generation", "artifact_id").join(places, "artifact_id").join(models, "artifact_id", "left").withColumn("name", F.element_at(F.split("path", "/"), -1))
    try:
        write(work, lambda: step("renew"))
    except Exception as error:  # whatever went wrong is the tasks' error
        step("fail", str(error))
        return {"target": target, "completed": 0, "failed": count}
    step("complete")
    return {"target": target, "completed": count, "failed": 0}
