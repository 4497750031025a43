"""Benchmark decontamination by a prefix-filtered set join (operator 4).

An item is cut into windows of `window` consecutive words (an item of fewer
words is one window); a document holds an item if a window of it occurs there
as a run of words.  A window asks for all its words, so by prefix filtering
one word is a necessary prefix: the rarest, with words ordered by how many
items have them, then longest first (any fixed order gives the same result).
Documents are probed with these prefix words only; a candidate start must keep
the whole window inside the document (length and position bound), its rolling
hash must agree, and its words are then compared exactly.

The window index is broadcast if its bytes, which are counted first, are at
most `BROADCAST_BYTES`.  For a larger benchmark the prefix words and the window
hashes go out as two bit fields of fixed size; candidate windows that pass both
at their prefix word and inside their document are joined with the windows by
their exact words.  Both ways give the same rows.

Defined cases: null or empty texts have no words, hit nothing and are not
contaminated; items without words are never found; repeated items count by
item id; an item with a null id marks words but names no item; repeated
documents each get their row; empty tables give no rows or no hits; input
columns named n_words, n_hit or items are replaced, others may have any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import drop, stored, unused

WINDOW = 8
#: Bound of the broadcast index: the bytes of all words and item ids, and 200 a window.
BROADCAST_BYTES = 32 << 20
#: Bits of a bit field of the other way, as a power of two: 32 MB.
FIELD_BITS = 28

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def scan(data: np.ndarray, bounds: np.ndarray) -> V.Words:
    return V.Words(data, bounds, V.ALNUM_OR_HIGH, lower=True)


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id string, words array): the windows of all items, each once an item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.blocks(batch, "text"):
                w = scan(*V.utf8(part.column("text")))
                raw = w.data.tobytes()
                words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts, w.ends)]
                ids, grams = [], []
                for name, a, b in zip(part.column("item_id").to_pylist(), w.first[:-1], w.first[1:]):
                    own = {tuple(words[i : i + window]) for i in range(a, max(b - window, a) + 1)} if b > a else ()
                    for gram in own:
                        ids.append(name)
                        grams.append(list(gram[: b - a]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.list_(pa.string()))], names=["item_id", "words"])

    # the slice above may run over the end of a short item: it is cut to the item's own words
    return items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).mapInArrow(work, "item_id string, words array<string>")


class WindowIndex:
    """Prefix word -> windows with it; built once on the driver, probed by blocks."""

    def __init__(self, rows: list[tuple[str, list[str]]]) -> None:
        owners: dict[tuple[str, ...], list[str]] = {}
        for item, words in rows:
            owners.setdefault(tuple(words), []).append(item)
        spread = Counter(w for item, w in {(item, w) for item, words in rows for w in words})
        grams = sorted(owners)
        self.items = [sorted({name for name in owners[g] if name is not None}) for g in grams]
        self.raw = [[w.encode() for w in g] for g in grams]
        self.length = np.array([len(g) for g in grams], np.int64)
        self.offset = np.array([min(range(len(g)), key=lambda i: (spread[g[i]], -len(g[i]), i)) for g in grams], np.int64)
        data = " ".join(w for g in grams for w in g).encode()
        words = V.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), V.NON_SPACE)
        hashes = words.hashes()
        start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if grams else np.zeros(0, np.int64)
        self.hash = V.range_hashes(hashes, start, start + self.length)
        prefix = hashes[start + self.offset]
        self.order = np.argsort(prefix, kind="stable")
        self.prefix, self.at = np.unique(prefix[self.order], return_index=True)
        self.to = np.append(self.at[1:], len(prefix))

    def occurrences(self, w: V.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every occurrence of a window in a block."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(w.starts):
            return none, none
        hashes = w.hashes()
        near = np.searchsorted(self.prefix, hashes)
        near[near == len(self.prefix)] = 0
        place = np.flatnonzero(self.prefix[near] == hashes)
        entry = near[place]
        many = self.to[entry] - self.at[entry]
        place = np.repeat(place, many)
        within = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        window = self.order[np.repeat(self.at[entry], many) + within]
        first = place - self.offset[window]
        text = w.text_of_word()
        fits = (first >= w.first[text[place]]) & (first + self.length[window] <= w.first[text[place] + 1])
        first, window = first[fits], window[fits]
        same = V.range_hashes(hashes, first, first + self.length[window]) == self.hash[window] if len(first) else fits[:0]
        first, window = first[same], window[same]
        raw = w.data.tobytes()
        exact = np.array([all(raw[w.starts[i + k] : w.ends[i + k]] == word for k, word in enumerate(self.raw[g])) for i, g in zip(first, window)], bool)
        return first[exact], window[exact]


def _probe(docs: DataFrame, text: str, keep: list[str], index) -> DataFrame:
    def work(part: pa.RecordBatch) -> list:
        own: WindowIndex = index.value
        w = scan(*V.utf8(part.column(text)))
        first, window = own.occurrences(w)
        hit = V.covered(first, own.length[window], len(w.starts))
        found: list[set] = [set() for _ in range(len(part))]
        for t, g in {*zip(w.text_of_word()[first].tolist(), window.tolist())}:
            found[t].update(own.items[g])
        return [np.diff(w.first), V.sum_by_text(hit, w.first), [sorted(x) for x in found]]

    return V.with_columns(docs, text, FIELDS, work, keep)


class Bits:
    """A set of 64-bit hashes as a bit field of fixed size: never misses one, rarely has one too many."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - FIELD_BITS)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    @classmethod
    def of(cls, hashes: DataFrame) -> Bits:
        """From the one column `h`; at most 2 ** (FIELD_BITS - 6) words come to the driver."""
        slot = F.shiftrightunsigned("h", 64 - FIELD_BITS)
        found = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FIELD_BITS}) & 63 as int))")).alias("bits")).toArrow()
        words = np.zeros(1 << (FIELD_BITS - 6), np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words)


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each window and of its prefix word, as documents are hashed."""
    for batch in batches:
        for part in V.blocks(batch, "gram"):
            w = V.Words(*V.utf8(part.column("gram")), V.NON_SPACE)
            hashes = w.hashes()
            whole = V.range_hashes(hashes, w.first[:-1], w.first[1:])
            prefix = hashes[w.first[:-1] + part.column("offset").to_numpy()]
            yield pa.RecordBatch.from_arrays([part.column("gram"), pa.array(np.diff(w.first)), part.column("offset"), pa.array(whole.view(np.int64)), pa.array(prefix.view(np.int64))], names=["gram", "length", "offset", "h", "prefix"])


def _join(docs: DataFrame, text: str, keep: list[str], windows: DataFrame) -> DataFrame:
    """The way for a benchmark too large to broadcast: prefixes and hashes as bit fields, exact words by a join."""
    spark = docs.sparkSession
    grams = stored(windows.select(F.concat_ws(" ", "words").alias("gram"), "item_id"), "windows")
    words = grams.select("item_id", F.explode(F.split("gram", " ")).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("spread"))
    placed = grams.select("gram").distinct().select("gram", F.posexplode(F.split("gram", " ")).alias("offset", "word")).join(words, "word")
    rarity = F.struct("spread", -F.octet_length("word"), "offset")
    index = placed.groupBy("gram").agg(F.min_by("offset", rarity).cast("long").alias("offset"))
    index = stored(index.mapInArrow(_hash_windows, "gram string, length long, offset long, h long, prefix long"), "window-index")
    shapes = sorted((r[0], r[1]) for r in index.select("length", "offset").distinct().collect())  # at most window * window
    fields = spark.sparkContext.broadcast((Bits.of(index.select(F.col("prefix").alias("h"))), Bits.of(index.select("h"))))
    drop(index)

    hit = T.StructType([T.StructField("first", T.LongType()), T.StructField("length", T.LongType()), T.StructField("gram", T.StringType())])

    def work(part: pa.RecordBatch) -> list:
        prefix, whole = fields.value
        w = scan(*V.utf8(part.column(text)))
        hashes, text_of, raw = w.hashes(), w.text_of_word(), w.data.tobytes()
        place = np.flatnonzero(prefix(hashes))
        low, high = w.first[text_of[place]], w.first[text_of[place] + 1]
        found: list[list] = [[] for _ in range(len(part))]
        for n, offset in shapes:
            first = (place - offset)[(place - offset >= low) & (place - offset + n <= high)]
            for i in first[whole(V.range_hashes(hashes, first, first + n))].tolist():
                gram = b" ".join(raw[a:b] for a, b in zip(w.starts[i : i + n], w.ends[i : i + n]))
                t = text_of[i]
                found[t].append((i - int(w.first[t]), n, gram.decode("utf-8", "replace")))
        return [np.diff(w.first), [[dict(zip(hit.names, h)) for h in {*f}] for f in found]]

    row, hits = unused([*docs.columns, "n_words"], "row"), unused([*docs.columns, "n_words"], "hits")
    wide = V.with_columns(docs, text, [FIELDS[0], T.StructField(hits, T.ArrayType(hit))], work, [c for c in keep if c.lower() not in {f.name for f in FIELDS}])
    wide = stored(wide.withColumn(row, F.monotonically_increasing_id()), "documents")
    others = [c for c in wide.columns if c not in (row, hits)]
    met = wide.select(F.col(row).alias("row"), F.explode(hits).alias("hit")).select("row", "hit.*").join(grams, "gram")
    # places that are hit, from merged intervals; as many as the document has at most
    spans = F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("length")).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(spans, start, lambda a, x: F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(x["end"] - F.greatest(a["upto"], x["first"]), F.lit(0).cast("long"))).alias("n")))["n"]
    r, items, n = (unused(wide.columns, c) for c in ("r", "found", "covered"))
    found = met.groupBy(F.col("row").alias(r)).agg(F.sort_array(F.collect_set("item_id")).alias(items), covered.alias(n))
    clean = wide.filter(F.size(hits) == 0).select(*others, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    some = wide.filter(F.size(hits) > 0).join(found, F.col(row) == F.col(r), "left")
    return clean.unionAll(some.select(*others, F.coalesce(F.col(n), F.lit(0)).alias("n_hit"), F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_hit and the sorted `items` found in each text.

    Columns of docs with these three names are replaced.
    """
    keep = [*(docs.columns if keep is None else keep)]
    windows = item_windows(items, item_id, item_text, window)
    size = windows.agg(F.sum(F.octet_length(F.concat_ws(" ", "words")) + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 200)).first()[0] or 0
    if size > broadcast_bytes:
        return _join(docs, text, keep, windows)
    rows = [(r[0], r[1]) for r in windows.collect()]
    return _probe(docs, text, keep, docs.sparkSession.sparkContext.broadcast(WindowIndex(rows)))


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
