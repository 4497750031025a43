"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where the setting is absent, a local session (tests) gets a folder of its
    own; on a cluster that would lose rows, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths in the shared folder that this driver has made and not deleted.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _MADE:
        _MADE.remove(path)


def sweep(spark: SparkSession, but: str | None = None) -> None:
    """Delete everything that operators have stored so far, once their results are written elsewhere.

    Results are read lazily from some of these tables, so operators can't
    delete them themselves; whoever has consumed or written a result can.
    """
    for path in [p for p in _MADE if p != but]:
        remove(spark, path)
