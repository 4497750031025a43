"""Token counts by a compiled finite-state tokenizer (operator 8).

Each task compiles the tokenizer lazily (see transducer.py) and counts whole
texts block by block; there is no shuffle and nothing but the counts is kept.

Defined cases: null and empty texts have no tokens; special strings inside a
text count as one token each, as the library's default has it; repeated rows
each get their count; a pre-token may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vectext as V
from .transducer import counter

LIMIT = 2048
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """df (or its columns `keep`) with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""

    def work(part: pa.RecordBatch) -> list:
        column = part.column(text)
        _, bounds = V.utf8(column)
        n = counter(tokenizer).count([x or "" for x in column.to_pylist()])
        return [np.diff(bounds), n, n > limit]

    return V.with_columns(df, text, FIELDS, work, keep)
