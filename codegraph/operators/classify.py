"""Files to typed artifacts: classification, limits, document models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, extension, identity
from ..schemas import EXTENSIONS

MAX_FILE_BYTES, MAX_SNAPSHOT_BYTES = 8 << 20, 64 << 20


class BadInput(ValueError):
    """A row that the contract rejects; the message names the first one."""


def fail_on(rows: DataFrame, message: str, *columns: str, order: str | None = None) -> None:
    """Raise for the first of the violating rows, if there is any."""
    first = (rows.orderBy(order) if order else rows).select(*columns).limit(1).collect()
    if first:
        raise BadInput(f"{message}: {', '.join(str(v) for v in first[0])}")


def _by_extension(path: Column, field: int) -> Column:
    found = F.lit(None).cast("string")
    for ext, values in EXTENSIONS.items():
        found = F.when(extension(path) == ext, F.lit(values[field])).otherwise(found)
    return found


def supported(path: Column) -> Column:
    return extension(path).isin(list(EXTENSIONS))


def classify(files: DataFrame) -> DataFrame:
    """files(path, …) with name, mime_type, language, model_type (null: unsupported)."""
    p = F.col("path")
    return files.withColumns({"name": basename(p), "mime_type": _by_extension(p, 0), "language": _by_extension(p, 1), "model_type": _by_extension(p, 2)})


def artifacts(files: DataFrame) -> DataFrame:
    """files(source_uri, revision, path, content) as artifact rows with identity and size."""
    return classify(files).select(
        identity(F.col("source_uri"), F.col("revision"), F.col("path")).alias("id"), "name", "path", "mime_type", "language", "model_type",
        F.lit("utf8").alias("encoding"), "content", F.lit("").alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), "source_uri", "revision",
    )


def stored(files: DataFrame) -> DataFrame:
    """The supported artifacts; a NUL in one of them, or a missing revision, is an error."""
    found = artifacts(files)
    fail_on(found.filter(F.coalesce(F.col("revision"), F.lit("")) == ""), "Snapshot without a revision", "path")
    kept = found.filter(F.col("model_type").isNotNull())
    fail_on(kept.filter(F.col("content").contains("\0")), "Binary content", "path", order="path")
    return kept


def summary(files: DataFrame) -> DataFrame:
    """stored and skipped counts in one row."""
    return classify(files).agg(F.count_if(F.col("model_type").isNotNull()).alias("stored"), F.count_if(F.col("model_type").isNull()).alias("skipped"))


def over_limits(files: DataFrame, file_bytes: int = MAX_FILE_BYTES, snapshot_bytes: int = MAX_SNAPSHOT_BYTES) -> DataFrame:
    """Per snapshot: whether a file or the whole is over its limit."""
    size = F.octet_length("content").cast("long")
    return files.groupBy("source_uri", "revision").agg(F.max(size).alias("largest"), F.sum(size).alias("total")).withColumn("ok", (F.col("largest") <= file_bytes) & (F.col("total") <= snapshot_bytes))


def document_models(kept: DataFrame) -> DataFrame:
    """One section with the full text for every document artifact."""
    section = F.struct(F.lit("").alias("title"), F.col("content").alias("text"), F.lit(0).cast("long").alias("start_page"), F.lit(0).cast("long").alias("end_page"))
    return kept.filter("model_type = 'document'").select(F.col("id").alias("artifact_id"), "model_type", file_struct().alias("file"), F.array(section).alias("sections"))


def file_struct() -> Column:
    provenance = F.struct(F.col("source_uri").alias("source_id"), F.col("revision").alias("snapshot_id"))
    return F.struct("path", "name", "mime_type", "language", "size_bytes", provenance.alias("provenance"))


def printable(kept: DataFrame) -> DataFrame:
    """The print sink's text: a header line, then the source."""
    return kept.select("path", F.concat(F.format_string("[%s] %s (%d bytes)\n", "model_type", "path", "size_bytes"), "content").alias("output"))
