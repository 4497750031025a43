"""Connected components by alternating large-star and small-star steps.

Every step is two aggregations over the edge table with the result written to
the shared folder; labels never come to the driver, and no task holds a
component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node it reaches.

    edges: columns a and b.  Loops and repeated edges do no harm; no edges
    give an empty table.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        # large star: all larger neighbours point to the least neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself point to the least
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, stored(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(old)
        mark, last = _fingerprint(now), mark
        if mark == last:
            break
    named = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(named.unionAll(named.select(F.col("root").alias("node"), "root").distinct()), "components")
    drop(now)
    return out
