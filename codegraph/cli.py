"""Command lines: ingest and export graphs, inspect a checkout, ask and compare, run index tasks."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from . import agent, demo, indexing
from .inspector import Budgets, Checkout, Inspector
from .operators import build, extract, queue, validate
from .operators.classify import BadInput, stored, summary
from .sources import sinks, snapshot


def session() -> SparkSession:
    return SparkSession.builder.appName("codegraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codegraph")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="store the files of a source")
    ingest.add_argument("type", choices=snapshot.SOURCE_TYPES)
    ingest.add_argument("uri")
    ingest.add_argument("--ref")
    where = ingest.add_mutually_exclusive_group()
    where.add_argument("--local", metavar="FOLDER", help="numbered JSON files")
    where.add_argument("--tables", metavar="FOLDER", help="published tables, with index tasks for what changed")
    export = sub.add_parser("graph-export", help="build graph.json from model records")
    export.add_argument("records")
    export.add_argument("graph")
    demo = sub.add_parser("demo", help="write a small repository and its graph")
    demo.add_argument("folder")
    index = sub.add_parser("index", help="carry out index tasks of published tables")
    index.add_argument("target", choices=(*queue.TARGETS, "all"))
    index.add_argument("tables")
    index.add_argument("output", help="the folder of the vector collection and the graph tables")
    index.add_argument("--collection", default=indexing.IndexConfig.collection)
    index.add_argument("--model", default=indexing.IndexConfig.model)
    for name, text in (("inspect", "run one tool on a checkout"), ("ask", "let a model answer questions with the tools"), ("compare", "answer tasks with and without a graph")):
        c = sub.add_parser(name, help=text)
        c.add_argument("root")
        if name == "inspect":
            c.add_argument("tool")
            c.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
        else:
            c.add_argument("--model-url", required=True)
            c.add_argument("--model", required=True)
        if name == "ask":
            which = c.add_mutually_exclusive_group(required=True)
            which.add_argument("--question")
            which.add_argument("--interactive", action="store_true", help="one question a line, until an empty one")
        if name == "compare":
            c.add_argument("tasks", help="a JSON file: a list of objects with id and question")
        c.add_argument("--graph", required=name == "compare")
        c.add_argument("--revision")
        c.add_argument("--source-uri")
        c.add_argument("--report", help="a file to write, never overwritten")
        for f in fields(Budgets):
            c.add_argument("--" + f.name.replace("_", "-"), type=int, default=f.default)
    return p


def _ingest(args, spark, given) -> int:
    source = snapshot.Request(args.type, args.uri, {"ref": args.ref} if args.ref else {})
    files = snapshot.default_registry(given["transport"]).create(spark, source).persist()
    kept = stored(files)
    counts = summary(files).first()
    if args.local:
        sinks.write_records(extract.records(kept), args.local)
    elif args.tables:
        indexing.store(spark, args.tables, kept.withColumnRenamed("id", "artifact_id"), extract.records(kept))
    else:
        sinks.print_artifacts(kept, given["out"])
    given["out"](f"stored {counts['stored']}, skipped {counts['skipped']}")
    return 0


def _export(args, spark, given) -> int:
    build.export_graph(*build.build_graph(snapshot.model_records(spark, args.records)), args.graph)
    return 0


def _demo(args, spark, given) -> int:
    given["out"](demo.write_demo(spark, args.folder))
    return 0


def _index(args, spark, given) -> int:
    config = indexing.IndexConfig(args.collection, args.model)
    writers = {"graph": lambda: indexing.graph_writer(spark, f"{args.output}/graph")}
    if given["embed"]:
        writers["vector"] = lambda: indexing.vector_writer(indexing.VectorTable(spark, args.output, config.collection), config, given["embed"])
    failed = 0
    for target in queue.TARGETS if args.target == "all" else (args.target,):
        if target not in writers:
            raise BadInput("no embedder is given, so vectors can't be written")
        done = indexing.run_worker(spark, args.tables, target, writers[target]())
        given["out"](f"{target}: {done['completed']} completed, {done['failed']} failed")
        failed += done["failed"]
    return 1 if failed else 0


def _view(args, spark, mode: str = "graph") -> Inspector:
    budgets = Budgets(**{f.name: getattr(args, f.name) for f in fields(Budgets)})
    graph = validate.select_graph(*snapshot.graph_file(spark, args.graph), args.source_uri, args.revision) if args.graph and mode == "graph" else None
    return Inspector(spark, Checkout(spark, args.root, budgets), graph, budgets)


def _told(args, result, out) -> None:
    if args.report:
        sinks.write_report(result, args.report)
    out(json.dumps(result, ensure_ascii=False))


def _inspect(args, spark, given) -> int:
    result = _view(args, spark).execute(args.tool, json.loads(args.arguments))
    _told(args, result, given["out"])
    return 1 if result["status"] == "error" else 0


def _ask(args, spark, given) -> int:
    model = given["model"] or agent.ChatModel(args.model_url, args.model)
    questions = iter(given["lines"]) if args.interactive else iter([args.question])
    for question in questions:
        if not question.strip():
            break
        _told(args, agent.ask(_view(args, spark), model, question.strip(), args.model), given["out"])
    return 0


def _compare(args, spark, given) -> int:
    tasks = agent.read_tasks(spark, args.tasks)
    reports = agent.compare(tasks, lambda mode: _view(args, spark, mode), lambda task, mode: given["model"] or agent.ChatModel(args.model_url, args.model))
    _told(args, {"reports": reports, "evaluation": agent.evaluate(spark, tasks, reports)}, given["out"])
    return 0


COMMANDS = {"ingest": _ingest, "graph-export": _export, "demo": _demo, "index": _index, "inspect": _inspect, "ask": _ask, "compare": _compare}


def run(argv: list[str], spark: SparkSession | None = None, transport: snapshot.Transport | None = None, out=print, model=None, embed=None, lines=sys.stdin) -> int:
    """0: done, 1: failed, 2: wrong usage.  Transport, model, embedder and lines of input may be given."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 2 if stop.code else 0
    try:
        return COMMANDS[args.command](args, spark or session(), {"transport": transport, "out": out, "model": model, "embed": embed, "lines": lines})
    except (BadInput, NotImplementedError, OSError, ValueError) as error:
        print(f"codegraph: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
