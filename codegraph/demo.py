"""A demonstration: a new folder with a small git repository and the graph of its one revision."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import SparkSession

from .operators import build, classify, extract
from .operators.classify import BadInput

URI = "https://example.org/harbour/tides"
#: `level` is defined twice, at large and in a namespace; `print_tide` calls it on line 4.
SOURCES = {
    "include/gauge.hpp": "double level(int hour);\n",
    "src/gauge.cpp": '#include "../include/gauge.hpp"\n\ndouble level(int hour) { return 1.5 * hour; }\n',
    "src/report.cpp": '#include "../include/gauge.hpp"\n\ndouble print_tide(int hour) {\n    double now = level(hour);\n    return now;\n}\n',
    "src/model/moon.cpp": "namespace moon {\ndouble level(int hour) { return 0.25 * hour + 3; }\n}\n",
    "docs/TIDES.md": "# Tides\nEvery hour has a level.\n",
}


def make_checkout(root: str, sources: dict[str, str] | None = None) -> str:
    """Sources in a fresh repository at an existing folder; returns the commit."""
    for name, text in (sources or SOURCES).items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)

    def git(*words: str) -> str:
        return subprocess.run(["git", "-C", root, "-c", "user.name=pilot", "-c", "user.email=pilot@example.org", *words], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    git("add", "-A")
    git("commit", "-q", "-m", "tide table")
    return git("rev-parse", "HEAD")


def source_files(spark: SparkSession, commit: str, uri: str = URI, sources: dict[str, str] | None = None):
    rows = [(uri, commit, p, t) for p, t in (sources or SOURCES).items()]
    return spark.createDataFrame(rows, "source_uri string, revision string, path string, content string")


def write_demo(spark: SparkSession, root: str) -> str:
    """repository/ and graph.json in a folder that must not exist yet; returns the commit."""
    try:
        os.makedirs(os.path.join(root, "repository"))
    except FileExistsError as error:
        raise BadInput(f"{root} exists") from error
    commit = make_checkout(os.path.join(root, "repository"))
    nodes, edges = build.build_graph(extract.records(classify.stored(source_files(spark, commit))))
    build.export_graph(nodes, edges, os.path.join(root, "graph.json"))
    return commit
