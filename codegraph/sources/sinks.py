"""Sinks: printed text, numbered JSON files, staged tables, reports that are never overwritten."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.classify import BadInput, printable


def print_artifacts(kept: DataFrame, write=print) -> int:
    """Print artifacts one by one, streamed from the executors."""
    count = 0
    for row in printable(kept).orderBy("path").toLocalIterator():
        write(row["output"])
        count += 1
    return count


def write_records(records: DataFrame, folder: str) -> int:
    """1.json, 2.json, … in a folder that must not exist yet."""
    try:
        os.makedirs(folder)
    except FileExistsError as error:
        raise BadInput(f"{folder} exists") from error
    count = 0
    for row in records.orderBy("file.path").toJSON().toLocalIterator():
        count += 1
        with open(os.path.join(folder, f"{count}.json"), "x", encoding="utf-8") as out:
            json.dump(json.loads(row), out, ensure_ascii=False, sort_keys=True)
    return count


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM's for any scheme that Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None where there is none."""
    fs, file = _files(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(file) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and put in place by one rename; an older one is replaced."""
    fs, file = _files(spark, path)
    _, aside = _files(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, file, how)


def next_number(spark: SparkSession, path: str) -> int:
    """One more than the largest number of the folders name=number at a path."""
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return 1
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return 1 + max((int(n.split("=")[1]) for n in names if "=" in n), default=0)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """All tables of one run or none: written to a staging folder, then named by one manifest.

    Readers follow the manifest, so a failure before its rename leaves the
    last published version in place.  Any file system that Spark writes to will do.
    """
    version, root = uuid.uuid4().hex, root.rstrip("/")
    fs, staged = _files(spark, f"{root}/{version}")
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
        write_text(spark, f"{root}/manifest.json", json.dumps({"version": version, "tables": sorted(tables)}))
    except BaseException:
        fs.delete(staged, True)
        raise
    return version


def is_published(spark: SparkSession, root: str) -> bool:
    fs, manifest = _files(spark, f"{root.rstrip('/')}/manifest.json")
    return fs.exists(manifest)


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    root = root.rstrip("/")
    manifest = json.loads(read_text(spark, f"{root}/manifest.json") or "null")
    if manifest is None:
        raise BadInput(f"{root} has no published tables")
    return {name: spark.read.parquet(f"{root}/{manifest['version']}/{name}") for name in manifest["tables"]}


def write_report(report: dict, path: str) -> None:
    try:
        with open(path, "x", encoding="utf-8") as out:
            json.dump(report, out, indent=2, ensure_ascii=False)
            out.write("\n")
    except FileExistsError as error:
        raise BadInput(f"{path} exists") from error
