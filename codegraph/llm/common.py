"""Tables and shared storage for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import _MADE, drop, fresh_path, remove, shared_dir, stored, sweep  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most_bytes: int) -> bool:
    """Whether the values of df take at most so many bytes: 8 for a number, their length for texts and binaries.

    Counted over all rows, so what is broadcast behind it has a proven bound.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    other = [f for f in df.schema.fields if f.name not in wide]
    if any(not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType) for f in other):
        return False
    row = F.lit(8 * len(other))
    for name in wide:
        row = row + 16 + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most_bytes


def unused(columns: list[str], name: str) -> str:
    """A column name like `name` that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
