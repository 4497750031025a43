"""Token-id output in wavelet shards (operator 2).

Texts are put in ascending doc_id order by a range partitioning, encoded, and
written as shard files of about `shard_tokens` tokens; a document is never
split.  The shards are binary rows of a table in the shared folder, written by
Spark's committer, so a lost executor costs a task and leaves no half file.

Encoding uses the tokenizers library.  Where its pre-tokenizer drops white
space, each distinct piece of a word is encoded by the library once and kept,
and texts are put together from kept pieces in numpy.  Other tokenizers encode
whole texts.

Defined cases: null is the empty text and holds the end id alone; rows with
equal doc_ids each have their own place, ordered by text; a null doc_id comes
first; an empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import vectext as V
from .common import fresh_path
from .transducer import byte_symbols

END_ID = 2
SHARD_TOKENS = 1 << 21
#: Pieces kept in a worker, about 60 bytes each, and bytes of long or odd words; with more of either, all are forgotten.
KEPT_PIECES, KEPT_BYTES = 400_000, 16 << 20

_LETTER, _DIGIT, _SYMBOL, _ODD = 1, 2, 3, 4
#: Classes of the bytes of plain words: printable ASCII and, below, two-byte Latin letters.
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SYMBOL
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x61:0x7B] = _CLASS[0xC3] = _LETTER
_CLASS[0x27] = _ODD  # contractions are for the library
_STAND_IN = {b: ord(c) for b, c in enumerate(byte_symbols())}


def _plain_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes, classes): what normalising and the pre-tokenizer make of plain words."""
    low = V.LOWER[data]
    kind = _CLASS[low]
    at = np.flatnonzero(low[:-1] == 0xC3) + 1
    after = low[at]
    upper = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    low[at[upper]] += 0x20
    kind[at[upper | (after >= 0x9F) & (after <= 0xBF) & (after != 0xB7)]] = _LETTER
    mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    kind[mark] = _ODD  # `<|` may begin a special token
    return low, kind


class _Table:
    """Byte strings of up to 16 bytes -> entry numbers: an open-addressing table in numpy arrays.

    A string is known by its length, its first eight and its last eight bytes, which is all of it.
    """

    def __init__(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)
        self.named = np.zeros((3, 0), np.uint64)
        self.entry = np.zeros(0, np.int64)

    def _slot(self, name: np.ndarray) -> np.ndarray:
        return (V.mix(name[0] + V.mix(name[1] + (name[2] << np.uint64(56)))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, name: np.ndarray) -> np.ndarray:
        """Entry of each name (rows: first bytes, last bytes, length), -1 where unknown."""
        out = np.full(name.shape[1], -1, np.int64)
        left, slot = np.arange(name.shape[1]), self._slot(name)
        while len(left):
            row = self.slots[slot]
            met = row >= 0
            left, slot, row = left[met], slot[met], row[met]
            same = self.named[0][row] == name[0][left]
            same &= self.named[1][row] == name[1][left]
            same &= self.named[2][row] == name[2][left]
            out[left[same]] = self.entry[row[same]]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def add(self, name: np.ndarray, entry: np.ndarray) -> None:
        """Names that are not in the table, each once."""
        old = self.named.shape[1]
        self.named, self.entry = np.concatenate([self.named, name], 1), np.concatenate([self.entry, entry])
        rows = np.arange(old, self.named.shape[1], dtype=np.int32)
        if 3 * self.named.shape[1] > len(self.slots):
            self.slots = np.full(1 << (4 * self.named.shape[1]).bit_length(), -1, np.int32)
            rows = np.arange(self.named.shape[1], dtype=np.int32)
        slot = self._slot(self.named[:, rows])
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]  # of several for one slot one stays
            away = self.slots[slot] != rows
            rows, slot = rows[away], (slot[away] + 1) & (len(self.slots) - 1)


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First and last eight bytes (padded with zeros) and length of short strings."""
    whole = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(whole[:-7].view(), (len(whole) - 7, 8), (1, 1))
    size = ends - starts
    first = np.ascontiguousarray(eight[starts + 8]).view(np.uint64)[:, 0]
    last = np.ascontiguousarray(eight[ends]).view(np.uint64)[:, 0]
    short = (8 * np.clip(8 - size, 0, 7)).astype(np.uint64)
    return np.stack([(first << short) >> short, np.where(size > 8, last, 0), size.astype(np.uint64)])


class Encoder:
    """Ids of texts by the tokenizers library, without special tokens added.

    Where the pre-tokenizer drops white space, no token crosses it, so the ids
    of a text are those of its words.  Words of printable ASCII and Latin
    letters, where normalising is lower-casing, are cut into pieces by byte
    classes; each distinct piece goes to the library's model once and is kept.
    All other words are encoded whole by the library, once each.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _drops_space(spec)
        if self.by_word:
            self.model = Tokenizer(self.library.model)  # the same merges, for pieces in byte form
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.table, self.other, self.held = _Table(), {}, 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New entries for runs of ids of the given sizes; returns their numbers."""
        if len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        n = len(self.start)
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(ids)
        return np.arange(n, n + len(size))

    def _pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Entries for plain pieces, from the library's model."""
        forms = [p.decode() if p.isascii() else p.decode("latin-1").translate(_STAND_IN) for p in pieces]
        found = np.array(self.model.encode_batch_fast([forms], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        # every piece ends with the one token that carries the end of a word
        return self._keep(found, np.diff(np.flatnonzero(self.ends[found]), prepend=-1))

    def _words(self, words: list[bytes]) -> np.ndarray:
        """Entries for words that go to the library whole."""
        found = self._library([w.decode() for w in words])
        return self._keep(np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _strings(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, learn) -> np.ndarray:
        """Entries of strings by a dictionary: long pieces and odd words."""
        found = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        known = self.other.setdefault(learn.__name__, {})
        if new := list(set(found).difference(known)):
            known.update(zip(new, learn(new).tolist()))
            self.held += sum(map(len, new)) + 100 * len(new)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text) for UTF-8 bytes with row bounds."""
        if not self.by_word:
            raw = data.tobytes()
            found = self._library([raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])])
            return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.start) > KEPT_PIECES or self.held > KEPT_BYTES:
            self.reset()
        w = V.Words(data, bounds)
        low, kind = _plain_bytes(data)
        odd = np.concatenate([[0], np.cumsum(kind == _ODD, dtype=np.int64)])
        plain = odd[w.ends] == odd[w.starts]
        # cuts: word starts, and within plain words where the class changes or a digit stands
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[w.starts[plain]] += 1
        inside[w.ends[plain]] -= 1
        cut &= np.cumsum(inside, dtype=np.int8).view(bool)
        cut[w.starts] = True
        starts = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
        word = np.searchsorted(w.starts, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), w.ends[word])
        entry = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(plain[word] & (ends - starts <= 16))
        name = _names(low, starts[short], ends[short])
        got = self.table.find(name)
        if len(unknown := np.flatnonzero(got < 0)):
            new = unknown[V.first_ones_of(name[:, unknown])]
            raw = low.tobytes()
            at = short[new]
            self.table.add(name[:, new], self._pieces([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            got[unknown] = self.table.find(name[:, unknown])
        entry[short] = got
        for mask, source, learn in ((plain[word], low, self._pieces), (~plain[word], data, self._words)):
            at = np.flatnonzero(mask & (entry < 0))
            if len(at):
                entry[at] = self._strings(source.tobytes(), starts[at], ends[at], learn)
        size = self.size[entry]
        first = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.start[entry] - first, size)]
        return ids, V.sum_by_text(size, np.searchsorted(starts, bounds))


def _drops_space(spec: dict) -> bool:
    """Whether the pieces of a text never hold or cross ASCII white space.

    True for a pre-tokenizer that keeps matches of letters, numbers and
    symbols only, after a normaliser that works on characters.
    """
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    kinds = {n.get("type") for n in norm.get("normalizers", [norm])}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    prefixed = any(p.get("add_prefix_space") for p in pre.get("pretokenizers", []))
    ends = spec.get("model", {}).get("end_of_word_suffix") == "</w>"
    return bool(ends and kept and plain and not prefixed and not spec.get("post_processor") and kinds <= {"NFC", "Replace", "Lowercase"})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import wavelet

        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, before, ids, names, sizes, held
            size = np.concatenate(sizes)
            data = wavelet.write_shard(np.concatenate(ids), names, np.concatenate([[0], np.cumsum(size)]))
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, number, before, held)] + [pa.array([data], pa.binary())], names=["part", "number", "before", "n_tokens", "data"])
            number, before = number + 1, before + held
            ids, names, sizes, held = [], [], [], 0
            return row

        for batch in batches:
            for rows in V.blocks(batch, "text", 1 << 20):
                found, size = encoder(path).encode(*V.utf8(rows.column("text")))
                # the end id after each document
                whole = np.full(len(found) + len(size), end_id, np.uint32)
                place = np.ones(len(whole), bool)
                place[np.cumsum(size + 1) - 1] = False
                whole[place] = found
                ids.append(whole)
                names += rows.column("doc").to_pylist()
                sizes.append(size + 1)
                held += len(whole)
                if held >= shard_tokens:
                    yield shard()
        if held:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, order: list[str] | None = None) -> None:
    """Encode all texts in ascending order of doc_id, or of the columns `order`, into wavelet shards at `path`."""
    by = [f"by{i}" for i in range(len(order or []))] or ["doc"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), *(F.col(c).alias(f"by{i}") for i, c in enumerate(order or [])))
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc", "text")
    shards = ordered.mapInArrow(_shards(tokenizer, end_id, shard_tokens), "part long, number long, before long, n_tokens long, data binary")
    shards.write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards.

    Shards know their place within their partition; the partitions' totals,
    one row each, are summed up and broadcast.
    """
    shards = spark.read.parquet(path)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("part", "base")
    placed = shards.join(F.broadcast(totals), "part").select((F.col("base") + F.col("before")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import wavelet

        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                matrix, names, bounds = wavelet.read_shard(data.as_py())
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the shards (to a fresh place in the shared folder by default) and read them back."""
    path = path or fresh_path(docs.sparkSession, "token-ids")
    write_shards(docs, tokenizer, path, **options)
    return read_shards(docs.sparkSession, path)
