"""n-gram Jaccard join by parity sketches (operator 7).

A document's set holds its distinct word shingles.  Two sets of sizes n <= m
with Jaccard similarity of t or more differ in at most (1 - t) / (1 + t) *
(n + m) shingles.  Sizes fall into bands by the smaller set of a pair; in a
band the shingle space is hashed into more parts than any pair may differ in,
each part is XOR-hashed to 64 bits, and by the pigeonhole principle a similar
pair agrees in some part.  Parts without any shingle say nothing, so a set that
has too few non-empty parts for the argument also emits its empty ones.  No
link is lost; there are no caps.

Agreement in a part makes candidates; sets that agree share the part's bucket.
A set with f non-empty parts that may differ in d agrees with every similar set
in f - d of them or more.  So, as in prefix filtering, it may leave f - d - 1
of its buckets, the dearest ones in one order of all buckets: what two similar
sets share last is in the part that both keep.  A passage that many unlike
documents share fills a few buckets a document, and these are the ones left.

Copies (equal sets) are one node from the start.  Rounds compare the members
of a bucket with its hub, the member that meets most others, and join verified
links into components; a bucket whose members are all in one component is
settled.  When a round no longer settles much, the members of unsettled buckets
that are in different components are compared, each bucket dearer than
`_CELL` members in salted cells.  Every candidate must pass the size bound and
the bit sketch: parity bits whose Hamming distance never exceeds the symmetric
difference.  Survivors are verified on the sets themselves.

Part hashes travel as packed arrays, one row for each block of texts and
target partition.  There are as many targets as the counted shingles ask for
at `PART_KEYS` part hashes each, so what a task sorts does not grow with the
input, nor with the size of a bucket.

Defined cases: null, empty and word-less texts have an empty set, linked with
nothing; a text of fewer words than a shingle is one shingle; repeated rows
are copies of each other; an empty table gives an empty result.  Shingles are
known by 64-bit hashes, sets by 128-bit hashes.  No column but the two named
ones is read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .common import drop, small, stored
from .components import components

SHINGLE = 5
PERCENT = 75
#: Part hashes of a target partition, about 40 bytes each while it is sorted.
PART_KEYS = 2_000_000
#: Up to here the list of documents to read again is broadcast; its bytes are counted first.
BROADCAST_BYTES = 32 << 20
#: Members of a cell in which all pairs are looked at; a dearer bucket is dealt over pairs of cells.
_CELL = 512
#: Rounds end when so few pairs are left for each membership, when one finds no link, or after so many.
_FEW, _ROUNDS = 500, 6
_BLOCK = 1 << 20
_ROWS = 1 << 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0x6A09E667F3BCC909)


class Bands:
    """Size bands and their numbers of parts for a similarity of percent / 100."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.slack = Fraction(100 - percent, 100 + percent)
        self.lows = [1]

    def most(self, n: int) -> int:
        """The largest set that may be similar to one of size n."""
        return n * 100 // self.percent

    def differ(self, n: int, m: int) -> int:
        return int(self.slack * (n + m))

    def upto(self, n: int) -> np.ndarray:
        while self.lows[-1] <= n:
            low = self.lows[-1]
            self.lows.append(max(low + 1, self.most(low)))
        return np.array(self.lows)

    def parts(self, band: int) -> int:
        top = self.lows[band + 1] - 1
        return self.differ(top, self.most(top)) * 120 // 100 + 3


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the parity sketch of a set of n: a power of two, four bits or more a shingle."""
    return 2 ** np.ceil(np.log2(np.maximum(n, 16) * 4 / 64)).astype(np.int64)


class Sets:
    """Distinct shingle hashes of a block of texts: hash, text number, sizes, set ids."""

    def __init__(self, column: pa.Array, shingle: int) -> None:
        w = V.Words(*V.utf8(column), V.NON_SPACE, lower=True)
        hashes, left, text = w.hashes(), w.left_in_text(), w.text_of_word()
        at, h = V.windows(hashes, left, shingle)
        owner = text[at]
        counts = np.diff(w.first)
        for n in range(1, shingle):
            short = w.first[:-1][counts == n]
            if len(short):
                owner = np.concatenate([owner, text[short]])
                h = np.concatenate([h, V.range_hashes(hashes, short, short + n)])
        if len(owner) > len(at):  # short texts go to their place
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
        first = V.first_ones(V.mix(h + owner.astype(np.uint64) * _GOLDEN))
        self.hash, self.owner = h[first], owner[first]
        self.size = np.bincount(self.owner, minlength=len(column)).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.stack([self._sums(seed) for seed in (_GOLDEN, _OTHER)])
        self.spread, self.value = V.mix(self.hash ^ np.uint64(0x5851F42D4C957F2D)), V.mix(self.hash)

    def _sums(self, seed: np.uint64) -> np.ndarray:
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(V.mix(self.hash ^ seed), out=sums[1:])
        return V.mix(sums[self.at[1:]] - sums[self.at[:-1]] + V.mix(self.size.astype(np.uint64)))

    def select(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shingles of the chosen texts, and their place in the choice."""
        size = self.size[texts]
        place = np.repeat(np.arange(len(texts)), size)
        return np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + self.at[texts][place], place


def roles(s: Sets, texts: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, texts, most differences to a similar set there): the bands in which some texts emit parts."""
    lows = bands.upto(int(s.size.max(initial=1)) + 1)
    own = np.searchsorted(lows, s.size[texts], "right") - 1
    for band in np.unique(own):
        mine = texts[own == band]
        n = s.size[mine]
        yield int(band), mine, bands.slack.numerator * (n + n * 100 // bands.percent) // bands.slack.denominator
        if band:  # the larger of a pair whose smaller is in the band below
            down = -(-n * bands.percent // 100) < lows[band]
            if down.any():
                yield int(band) - 1, mine[down], bands.slack.numerator * (n[down] + lows[band] - 1) // bands.slack.denominator


def _cells(s: Sets, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each shingle of some texts (text number times k plus part), its position, and which cells are used."""
    at, place = s.select(texts)
    cell = place * k + (s.spread[at] % np.uint64(k)).astype(np.int64)
    used = np.zeros(len(texts) * k, bool)
    used[cell] = True
    return cell, at, used


def _part_keys(s: Sets, texts: np.ndarray, band: int, bands: Bands, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of the parts of some texts in a band; limit: differences a pair of each may have there."""
    k = bands.parts(band)
    cell, at, used = _cells(s, texts, k)
    values = np.zeros(len(used), np.uint64)
    np.bitwise_xor.at(values, cell, s.value[at])
    grid = used.reshape(-1, k)
    grid[grid.sum(1) <= limit] = True  # too few for the argument: the empty ones too
    cells = np.flatnonzero(used)
    key = V.mix(values[cells] + V.mix((cells % k).astype(np.uint64) + np.uint64(band << 32)))
    # bit 16 says the band's parity, which tells the two roles of a set apart
    return key & ~np.uint64(1 << 16) | np.uint64((band & 1) << 16), texts[cells // k]


def spare(s: Sets, bands: Bands) -> np.ndarray:
    """Buckets that each text may leave, for its band of even and of odd number."""
    out = np.zeros((2, len(s.size)), np.int64)
    for band, texts, limit in roles(s, np.flatnonzero(s.size), bands):
        k = bands.parts(band)
        full = _cells(s, texts, k)[2].reshape(-1, k).sum(1)
        out[band & 1, texts] = np.maximum(full - limit - 1, 0)
    return out


def _emit_parts(text: str, shingle: int, percent: int, targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for part in V.blocks(batch, text, _BLOCK):
                s = Sets(part.column(text), shingle)
                # a copy that this task has seen adds nothing
                fresh = []
                for i, name in enumerate(zip(*s.ids.tolist())):
                    if s.size[i] and name not in seen:
                        seen.add(name)
                        fresh.append(i)
                if len(seen) > 50_000:
                    seen.clear()
                found = [_part_keys(s, chosen, band, bands, limit) for band, chosen, limit in roles(s, np.array(fresh, np.int64), bands)]
                if not found:
                    continue
                key, owner = (np.concatenate(x) for x in zip(*found))
                target = key % np.uint64(targets)
                order = np.argsort(target.astype(np.uint16) if targets <= 1 << 16 else target, kind="stable")
                key, owner, target = key[order], owner[order], target[order].astype(np.int64)
                heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
                # the target is known, and 48 bits more tell the parts of a target apart
                high, low, owner = (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(16)).astype(np.uint16), owner.astype(np.uint32)
                ids, places, lists = [], [], []
                mark = np.zeros(len(part), np.uint32)
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(key)]):
                    mine = owner[a:b]
                    mark[mine] = 1
                    who = np.flatnonzero(mark)
                    mark[who] = np.arange(len(who))
                    place = mark[mine]
                    mark[who] = 0
                    ids.append(s.ids[:, who].tobytes())
                    places.append(place.astype(np.uint32 if len(who) > 65535 else np.uint16).tobytes())
                    lists.append(high[a:b].tobytes() + low[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(target[heads].astype(np.int32)), pa.array(ids, pa.binary()), pa.array(places, pa.binary()), pa.array(lists, pa.binary())], names=["target", "ids", "places", "keys"])

    return run


def _read_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, k, x, y): the members (set ids x, y) of every bucket of k > 1 sets."""
    keys, places, names, held = [], [], [], 0
    for batch in batches:
        for target, who, place, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            n = len(packed) // 6
            place = np.frombuffer(place, np.uint16 if len(place) == 2 * n else np.uint32)
            high, low = np.frombuffer(packed, np.uint32, n), np.frombuffer(packed, np.uint16, n, 4 * n)
            keys.append((np.uint64(target & 0xFFFF) << np.uint64(48)) | (high.astype(np.uint64) << np.uint64(16)) | low)
            places.append(place.astype(np.uint32) + np.uint32(held))
            names.append(np.frombuffer(who, np.uint64).reshape(2, -1))
            held += names[-1].shape[1]
    if not keys:
        return
    key, place, name = np.concatenate(keys), np.concatenate(places), np.concatenate(names, 1)
    keys.clear()
    several = V.repeated(key)
    key, place = key[several], place[several]
    # tasks may have emitted a set twice: one membership each
    order = np.lexsort((name[1][place], name[0][place], key))
    key, place = key[order], place[order]
    x, y = name[:, place]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    key, x, y = key[new], x[new], y[new]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[heads, len(key)])
    k = np.repeat(size, size)
    key, k, x, y = (c[k > 1].view(np.int64) for c in (key, k, x, y))
    for a in range(0, len(key), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + _ROWS]) for c in (key, k, x, y)], names=["bucket", "k", "x", "y"])


def _emit_sets(text: str, shingle: int, percent: int):
    """Set id, size and spare buckets of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for part in V.blocks(batch, text, _BLOCK):
                s = Sets(part.column(text), shingle)
                x, y = s.ids.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("mark"), *map(pa.array, (x, y, s.size, *spare(s, bands)))], names=["doc", "mark", "x", "y", "n", "even", "odd"])

    return run


def _emit_shingles(text: str, shingle: int):
    """Set id, parity sketch and sorted shingle hashes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.blocks(batch, text, _BLOCK):
                s = Sets(part.column(text), shingle)
                words = sketch_words(s.size)
                first = np.concatenate([[0], np.cumsum(words)])
                bit = (V.mix(s.hash ^ np.uint64(0x2545F4914F6CDD1D)) % (64 * words)[s.owner].astype(np.uint64)).astype(np.int64) + 64 * first[s.owner]
                odd = np.packbits((np.bincount(bit, minlength=64 * int(first[-1])) & 1).astype(np.uint8), bitorder="little")
                sketch = [odd[8 * a : 8 * b].tobytes() for a, b in zip(first[:-1], first[1:])]
                lists = [np.sort(s.hash[a:b]).tobytes() for a, b in zip(s.at[:-1], s.at[1:])]
                # another text of the same doc_id may have come along
                same = (s.ids.view(np.int64) == np.stack([part.column(c).to_numpy() for c in "xy"])).all(0)
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(s.size), pa.array(sketch, pa.binary()), pa.array(lists, pa.binary())], names=["id", "n", "sketch", "shingles"])
                yield out.filter(pa.array(same))

    return run


def hamming(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Hamming distances of parity sketches, the longer folded to the length of the shorter.

    Bit numbers are hashes modulo powers of two, so a sketch of half the bits is the XOR of the halves.
    """
    out = np.zeros(len(x), np.int64)
    size = np.stack([pc.binary_length(c).to_numpy() // 8 for c in (x, y)])
    for p, q in np.unique(size, axis=1).T.tolist():
        rows = np.flatnonzero((size[0] == p) & (size[1] == q))
        pick = pa.array(rows)
        u, v = (np.frombuffer(b"".join(c.take(pick).to_pylist()), np.uint64).reshape(len(rows), -1, min(p, q)) for c in (x, y))
        out[rows] = np.bitwise_count(np.bitwise_xor.reduce(u, 1) ^ np.bitwise_xor.reduce(v, 1)).sum(1)
    return out


def _sift(percent: int):
    """Pairs whose sketches allow the similarity; drops no pair that is similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            good = (100 + percent) * hamming(batch.column("xa"), batch.column("xb")) <= (100 - percent) * n
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(V.distinct(np.concatenate([x, y])))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both sets; names end in a and b."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), *(F.col(c).alias(c[0] + side) for c in columns)), side)
    return pairs


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: size bound, sketch bound, then the shingles."""
    sized = _sides(pairs.distinct(), sets.select("id", "n", F.col("sketch").alias("x")), "n", "x").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = stored(sized.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_sift(percent), "a long, b long"), "jaccard-likely")
    found = stored(_sides(likely, sets, "shingles").select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long"), "jaccard-links")
    drop(likely)
    return found


def _kept(members: DataFrame) -> DataFrame:
    """Memberships less those that each set may leave, buckets with most pairs first; `fame` sums up these."""
    role = Window.partitionBy("id", F.col("bucket").bitwiseAND(F.lit(1)))
    place = F.row_number().over(role.orderBy(F.desc("cross"), F.desc("bucket")))
    return members.withColumns({"place": place, "fame": F.sum("cross").over(role)}).filter("place > spare").drop("place")


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Memberships of buckets with sets of several components, with `root` and `cross`, the pairs between components."""
    rooted = members.drop("root", "cross").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    by_root = rooted.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    mixed = by_root.groupBy("bucket").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("roots")).filter("roots > 1")
    return stored(rooted.join(mixed.select("bucket", (F.col("k") * F.col("k") - F.col("same")).alias("cross")), "bucket"), "jaccard-members")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def _compare(percent: int):
    """Pairs of different components within cells that the size and sketch bounds allow.

    Rows come sorted by cell; side 2 marks members of a cell on its own, whose
    pairs are all looked at, 0 and 1 the two sides of a pair of cells.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        side, ids, roots, n = (rows.column(c).to_numpy() for c in ("side", "id", "root", "n"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        sketch = rows.column("sketch").to_pylist()
        words = np.array([len(x) // 8 for x in sketch], np.int64)
        out = [np.zeros((2, 0), np.int64)]
        for p in np.unique(words[left]):
            for q in np.unique(words[right]):
                u, v = left[words[left] == p], right[words[right] == q]
                x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(sketch[i] for i in c), np.uint64).reshape(len(c), -1, min(p, q)), 1) for c in (u, v))
                for i, mine in enumerate(u):
                    may = (roots[v] != roots[mine]) & (100 * np.minimum(n[v], n[mine]) >= percent * np.maximum(n[v], n[mine]))
                    if side[mine] == 2:
                        may &= ids[v] > ids[mine]
                    other = np.flatnonzero(may)
                    apart = np.bitwise_count(y[other] ^ x[i]).sum(1, dtype=np.int64)
                    other = v[other[(100 + percent) * apart <= (100 - percent) * (n[v[other]] + n[mine])]]
                    out.append(np.stack([np.minimum(ids[other], ids[mine]), np.maximum(ids[other], ids[mine])]))
        a, b = np.unique(np.concatenate(out, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            ends = [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip([0, *ends], ends):
                if b > a:
                    if held and cell[a] != last:
                        yield pairs(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = cell[a]
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _rest(kept: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of unsettled buckets, in cells of bounded size."""
    # of buckets with the same members one is enough (128-bit signature and count)
    marks = (F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("s2"))
    several = kept.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), *marks).filter("low < high")
    several = several.groupBy("s1", "s2", "size").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    rows = kept.select("bucket", "id", "root").join(several, "bucket").join(sets.select("id", "n", "sketch"), "id")
    cells = F.ceil(F.col("size") / _CELL).cast("long")
    rows = rows.withColumns({"cells": cells, "own": F.pmod(F.xxhash64("id"), cells)})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("cell"), side.alias("side"), "id", "root", "n", "sketch")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(percent), "a long, b long")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, part_keys: int = PART_KEYS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    component_id is the least doc_id reachable over links between documents
    whose shingle sets have 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    # a document without an id is known by its text where it is read again
    mark = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))).otherwise(F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc"), mark.cast("long").alias("mark"), F.col(text).alias("text"))
    doc_type = rows.schema["doc"].dataType.simpleString()
    base = stored(rows.mapInArrow(_emit_sets("text", shingle, percent), f"doc {doc_type}, mark long, x long, y long, n long, even long, odd long"), "jaccard-base")
    first = F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "mark")).alias("head")
    heads = base.filter("n > 0").groupBy("x", "y").agg(first, *(F.max(c).alias(c) for c in ("n", "even", "odd")))
    heads = stored(heads.withColumn("id", F.monotonically_increasing_id()), "jaccard-heads")

    # about 0.36 parts a shingle and role; as many targets as that many keys ask for
    keys = (heads.agg(F.sum("n")).first()[0] or 0) * 0.75
    targets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(keys / part_keys) + 1)
    packed = rows.select("text").mapInArrow(_emit_parts("text", shingle, percent, targets), "target int, ids binary, places binary, keys binary")
    buckets = packed.repartitionById(targets, "target").mapInArrow(_read_buckets, "bucket long, k long, x long, y long")
    spare = F.when(F.col("bucket").bitwiseAND(F.lit(1)) == 1, F.col("odd")).otherwise(F.col("even")).alias("spare")
    buckets = stored(buckets, "jaccard-buckets")
    members = stored(buckets.join(heads, ["x", "y"]).select("bucket", "k", "id", spare), "jaccard-members")
    drop(buckets)

    # the sets that meet others are read again, one text for each
    met = stored(_kept(members.withColumn("cross", F.col("k"))).select("id").distinct().join(heads, "id").select("id", "head.doc", "head.mark", "x", "y"), "jaccard-met")
    met_rows = F.broadcast(met) if small(met, BROADCAST_BYTES) else met
    again = rows.join(met_rows, rows["doc"].eqNullSafe(met["doc"]) & (rows["mark"] == met["mark"])).select("id", "x", "y", "text")
    sets = stored(again.mapInArrow(_emit_shingles("text", shingle), "id long, n long, sketch binary, shingles binary"), "jaccard-sets", "none")

    # rounds against hubs; the first hub of a bucket meets the most sets, later ones differ from bucket to bucket
    found, roots, open_, number, gained = [], None, members.withColumns({"root": F.col("id"), "cross": F.col("k") * (F.col("k") - 1)}), 0, True
    while True:
        kept = stored(_kept(open_), "jaccard-kept")
        cost = kept.groupBy("bucket").agg(F.max("cross").alias("cross"), F.count("*").alias("c")).filter("c > 1").agg(F.sum("cross"), F.sum("c")).first()
        if number and (number == _ROUNDS or (cost[0] or 0) <= _FEW * (cost[1] or 0) or not gained):
            break
        number += 1
        rank = F.struct("fame", "id") if number == 1 else F.struct(F.xxhash64("bucket", "id", F.lit(number)).alias("fame"), "id")
        hubs = kept.groupBy("bucket").agg(F.max_by(F.struct("id", "root"), rank).alias("hub"))
        pairs = kept.join(hubs, "bucket").filter(F.col("root") != F.col("hub.root"))
        found.append(_links(pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")), sets, percent))
        gained = not found[-1].isEmpty()
        if roots is not None:
            drop(roots, open_)
        drop(kept)
        roots = components(_all(found))
        open_ = _unsettled(members, roots)

    # and last the sets of unsettled buckets that are still in different components
    found.append(_links(_rest(kept, sets, percent), sets, percent))
    drop(kept, open_, roots, members)
    roots = components(_all(found))

    # from sets to documents
    to = heads.join(roots.withColumnRenamed("node", "id"), "id", "left").select("x", "y", F.col("head.doc").alias("head"), F.coalesce("root", "id").alias("root"))
    least = to.groupBy("root").agg(F.min("head").alias("component_id"))
    to = stored(to.join(least, "root").select("x", "y", "component_id"), "jaccard-classes")
    drop(heads, sets, roots, *found)
    return base.join(to, ["x", "y"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
