"""Repeated line runs, by suffix ranks over line-id sequences (operator 5).

A document is a sequence of \\n-split lines.  A run of lines is repeated if the
same lines, in one document, also start at an earlier place (documents by
doc_id, then line number).  Of every repeated run of `min_words` words or
more, the later copies are deleted: a line goes exactly if it lies in such a
run.

Distributed prefix doubling sorts the suffixes of all line sequences: the rank
of a block of 2h lines comes from the ranks of its halves, by a range sort of
the distinct pairs, so equal blocks have equal ranks and ranks follow suffix
order.  Blocks that occur once leave after every round, so rounds shrink fast,
and doubling ends when blocks are longer than the windows below.

A line lies in a repeated run of min_words words exactly if one of two windows
is repeated: the shortest of so many words from the run's first line on, or
the shortest that ends with the line.  So every line offers these two.  A
window of l lines, h <= l < 2h, is known by the ranks of the blocks of h lines
at its start and end: suffixes with equal ones share a prefix of l lines, an
LCP interval.  All but the first of an interval are later copies; their union
is the union of the maximal repeated runs.

Ranks and windows are narrow rows in stored tables; joins are on document and
line or on ranks, aggregated before the shuffle, so hot lines cost no task its
memory.

Defined cases: null text stays null and empty text stays empty; lines without
words never make a run by themselves; rows that repeat a doc_id with the same
text are one document and lose the same lines, with other texts they are
documents of their own, ordered by a hash of the text; a null doc_id comes
first; an empty table gives an empty result; lines are known by 128-bit hashes;
a document of very many or very long lines is a sequence like others; input
columns named n_lines or n_deleted are replaced, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .common import drop, stored, unused, within

MIN_WORDS = 50
_NEWLINE = 0x0A


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the first line of each text and the end."""
    breaks = np.flatnonzero(data == _NEWLINE)
    before = np.searchsorted(breaks, bounds)
    first = before + np.arange(len(bounds))
    n = int(first[-1])
    starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts[first[:-1]] = bounds[:-1]
    ends[first[1:] - 1] = bounds[1:]
    # break k of text t ends line k + t and starts the next
    at = np.arange(len(breaks)) + np.repeat(np.arange(len(bounds) - 1), np.diff(before))
    ends[at], starts[at + 1] = breaks, breaks + 1
    return starts, ends, first


def windows(words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the length of its window ahead and of its window behind, 0 if there is none."""
    upto = np.cumsum(words)
    before = upto - words
    line = np.arange(len(words))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = np.searchsorted(upto, before + min_words, "left")
    ahead = np.where(last < first[text + 1], last + 1 - line, 0)
    start = np.searchsorted(before, upto - min_words, "right") - 1
    behind = np.where(start >= first[text], line + 1 - start, 0)
    return ahead, behind


def _emit(min_words: int):
    """(doc, line, h1, h2, ahead, behind) of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.blocks(batch, "text"):
                data, bounds = V.utf8(part.column("text"))
                w = V.Words(data, bounds)
                starts, ends, first = line_bounds(data, bounds)
                words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
                ahead, behind = windows(words, first, min_words)
                text = np.repeat(np.arange(len(part)), np.diff(first))
                hashes = [V.byte_hashes(data, starts, ends, family).view(np.int64) for family in (0, 1)]
                line = np.arange(len(starts)) - first[text]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(text)), *map(pa.array, (line, *hashes, ahead, behind))], names=["doc", "line", "h1", "h2", "ahead", "behind"])

    return run


def _ranks(pairs: DataFrame) -> DataFrame:
    """(doc, line, rank) of the rows of (doc, line, h1, h2) whose pair occurs more than once.

    Ids of a range-sorted table rise with its order; the table is stored, so
    they never change under a lost executor.
    """
    several = stored(pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "suffix-pairs")
    order = stored(several.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").withColumn("rank", F.monotonically_increasing_id()), "suffix-order")
    ranks = stored(pairs.join(order.hint("merge"), ["h1", "h2"]).select("doc", "line", "rank"), "suffix-ranks")
    drop(several, order)
    return ranks


def _key(doc_id: str, text: str) -> Column:
    """What orders and tells documents: the doc_id, then a hash of the text."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("mark"))


def later_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, start, length): runs of lines that are later copies; they may overlap."""
    rows = docs.select(_key(doc_id, text).alias("doc"), F.col(text).alias("text"))
    lines = stored(rows.mapInArrow(_emit(min_words), f"doc {rows.schema['doc'].dataType.simpleString()}, line long, h1 long, h2 long, ahead long, behind long"), "lines")
    level, h = _ranks(lines.select("doc", "line", "h1", "h2").distinct()), 1
    ahead = lines.filter("ahead > 0").select("doc", F.col("line").alias("start"), F.col("ahead").alias("length"))
    behind = lines.filter("behind > 0").select("doc", (F.col("line") + 1 - F.col("behind")).alias("start"), F.col("behind").alias("length"))
    spans = ahead.unionAll(behind)
    found, stale = [], [lines]
    while True:
        # a window whose first block occurs once occurs once itself
        begins = level.select("doc", F.col("line").alias("start"), F.col("rank").alias("first"))
        spans = stored(spans.join(begins.hint("merge"), ["doc", "start"]).distinct(), "line-windows")
        stale.append(spans)
        tails = level.select("doc", F.col("line").alias("tail"), F.col("rank").alias("last"))
        keyed = spans.filter(F.col("length") < 2 * h).withColumn("tail", F.col("start") + F.col("length") - h)
        keyed = stored(keyed.join(tails, ["doc", "tail"]).select("doc", "start", "length", "first", "last"), "line-intervals")
        # heads are stored, so that both sides of the join are plain exchanges and adaptive execution can split a hot passage
        heads = keyed.groupBy("length", "first", "last").agg(F.min(F.struct("doc", "start")).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
        heads = stored(heads, "interval-heads")
        found.append(stored(keyed.join(heads, ["length", "first", "last"]).filter(F.struct("doc", "start") > F.col("head")).select("doc", "start", "length"), "later-copies"))
        longer = spans.filter(F.col("length") >= 2 * h).select("doc", "start", "length")
        stale += [keyed, heads, level]
        if within(longer, 0):
            break
        right = level.select("doc", (F.col("line") - h).alias("line"), F.col("rank").alias("h2"))
        pairs = stored(level.withColumnRenamed("rank", "h1").join(right, ["doc", "line"]), "suffix-halves")
        stale.append(pairs)
        level, spans, h = _ranks(pairs), longer, 2 * h
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    drop(*stale)
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, gone): the union of each document's spans as disjoint ranges of lines (start, end), ascending."""
    ends = spans.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    by_start = Window.partitionBy("doc").orderBy("start")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    islands = ends.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by_start))
    ranges = islands.groupBy("doc", "island").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("range"))
    return ranges.groupBy("doc").agg(F.sort_array(F.collect_list("range")).alias("gone"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies deleted from `text`, and n_lines and n_deleted.

    Columns of docs with these two names are replaced.
    """
    key, gone = unused(docs.columns, "key"), unused(docs.columns, "gone")
    found = _merged(later_copies(docs, text, doc_id, min_words)).select(F.col("doc").alias(key), F.col("gone").alias(gone))
    # a merge join at every size: what it shuffles follows the input, whatever the copies come to
    joined = docs.withColumn(key, _key(doc_id, text)).join(found.hint("merge"), key, "left")
    lines = F.split(F.col(text), "\n", -1)
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_gone = F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda n, g: n + g["end"] - g["start"]), F.lit(0).cast("long"))

    def between(i: Column, whole: Column, ranges: Column) -> Column:
        """The lines from the end of the range before number i to its start."""
        low = F.when(i == 0, F.lit(0).cast("long")).otherwise(ranges[i - 1]["end"])
        high = F.when(i == F.size(ranges), F.size(whole).cast("long")).otherwise(ranges[i]["start"])
        return F.slice(whole, (low + 1).cast("int"), (high - low).cast("int"))

    split, places = unused(docs.columns, "lines"), F.sequence(F.lit(0), F.size(gone))
    joined = joined.withColumn(split, F.when(F.col(gone).isNotNull(), lines))
    rest = F.array_join(F.flatten(F.transform(places, lambda i: between(i, F.col(split), F.col(gone)))), "\n")
    left = F.when(F.col(gone).isNull(), F.col(text)).otherwise(rest)
    columns = [left.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    return joined.select(*columns, n_lines.alias("n_lines"), n_gone.alias("n_deleted"))
