"""Word and line scanning over whole Arrow text columns.

The scanners work on the UTF-8 bytes of many texts at once: a class table
turns bytes into "word byte or not", edges of that mask are word bounds, and
polynomial prefix sums give every word or line a 64-bit hash without a Python
object per word.  Bytes are hashed modulo the prime 2**61 - 1, where two
different strings of n bytes agree with a chance of n / 2**61 and no family of
strings is known that always does; runs of a few words are hashed modulo 2**64
over the scrambled hashes of their words.  Texts are cut into blocks of a few
MB, so memory stays flat whatever an Arrow batch holds; a text is never split
or truncated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true in the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but the ASCII white space 0x20 and 0x09 to 0x0D.
NON_SPACE = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: ASCII digits and lower-case letters, and every byte of a non-ASCII character.
ALNUM_OR_HIGH = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_CONTINUATION = byte_class((0x80, 0xBF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Tables of powers grow in steps of so many.
_STEP = 1 << 18


class _Powers:
    """Powers of the base and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // _STEP) * _STEP
            up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
            if n > 4 * BLOCK_BYTES:  # too large to keep
                up, down, self.up, self.down = self.up, self.down, self.up[:1], self.down[:1]
                return up, down
        return self.up, self.down


_POWERS = _Powers()


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[starts:ends], runs of a few scrambled values; equal content, equal hash."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_PRIME = np.uint64((1 << 61) - 1)
#: Bases of the byte hashes: one for 64 bits, both for 128.
BASES = (0x0B5297A4D8E63C1F, 0x1E7F39A65C20D48B)
#: Prefix sums are exact for ranges up to so many bytes; longer ones are hashed one by one.
_LONG = 1 << 22


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it, in 31-bit halves."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


class _PrimePowers:
    """Powers of a base and of its inverse modulo the prime, grown by doubling."""

    def __init__(self, base: int) -> None:
        self.base, self.size = base, 0

    def _table(self, base: int, n: int) -> np.ndarray:
        table = np.ones(1, np.uint64)
        while len(table) < n:
            step = np.full(min(len(table), n - len(table)), np.uint64(pow(base, len(table), int(_PRIME))))
            table = np.concatenate([table, _product(table[: n - len(table)], step)])
        return table

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Low 32 and high 29 bits of the powers, and the inverse powers."""
        if self.size < n:
            size = -(-n // _STEP) * _STEP
            up = self._table(self.base, size)
            found = (up & np.uint64(0xFFFFFFFF)).astype(np.uint32), (up >> np.uint64(32)).astype(np.uint32), self._table(pow(self.base, -1, int(_PRIME)), size)
            if n > 4 * BLOCK_BYTES:  # too large to keep
                return found
            self.found, self.size = found, len(up)
        return self.found


_PRIME_POWERS = [_PrimePowers(b) for b in BASES]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of each data[starts:ends]; equal bytes, equal hash.  The families are independent."""
    low, high, inverse = _PRIME_POWERS[family].get(len(data) + 1)
    value = data.astype(np.uint64)
    value += np.uint64(1)
    sums = np.zeros((2, len(data) + 1), np.uint64)
    for row, power in zip(sums, (low, high)):
        np.multiply(value, power[: len(data)], out=row[1:])
        np.cumsum(row[1:], out=row[1:])
    size = ends - starts
    part, upper = sums[0][ends] - sums[0][starts], sums[1][ends] - sums[1][starts]
    upper = (upper & _PRIME) + (upper >> np.uint64(61))
    # times 2**32 is a rotation modulo the prime
    whole = (part & _PRIME) + (part >> np.uint64(61)) + (upper >> np.uint64(29)) + ((upper & np.uint64((1 << 29) - 1)) << np.uint64(32))
    whole = _reduced(whole)
    out = mix(_product(whole, inverse[starts]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=BASES[family])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 bounds of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    low, high = int(bounds[0]), int(bounds[-1])
    return (np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)), bounds - low


class Words:
    """Words of a block of texts: byte bounds, and for each text its range of words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray = NON_SPACE, lower: bool = False) -> None:
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        inside = word_bytes[self.data]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        cut = np.zeros(len(inside) + 1, bool)
        cut[bounds] = True  # a word never runs from one text into the next
        self.starts = np.flatnonzero(after & (~before | cut))
        self.ends = np.flatnonzero(before & (~after | cut))
        self.first = np.searchsorted(self.starts, bounds)  # n + 1 bounds in words

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))

    def hashes(self, family: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, family)

    def left_in_text(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def windows(word_hashes: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of n words that lie within one text."""
    starts = np.flatnonzero(left >= n)
    return starts, range_hashes(word_hashes, starts, starts + n)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix sums of code points over bytes: entry i counts those before byte i."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_CONTINUATION[data], out=sums[1:])
    return sums


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in any [start, start + length)."""
    if not len(starts):
        return np.zeros(n, bool)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges first[i]:first[i + 1]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    twice = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, ascending."""
    ordered = np.sort(keys)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def first_ones(keys: np.ndarray) -> np.ndarray:
    """Which keys don't occur before; a plain sort finds the few that repeat."""
    out = np.ones(len(keys), bool)
    at = np.flatnonzero(repeated(keys))
    if len(at):
        order = np.argsort(keys[at], kind="stable")
        ordered = keys[at][order]
        out[at[order[1:][ordered[1:] == ordered[:-1]]]] = False
    return out


def first_ones_of(rows: np.ndarray) -> np.ndarray:
    """Numbers of the first of each group of equal columns of a 2-d array, in no set order."""
    order = np.lexsort(rows)
    ordered = rows[:, order]
    return order[np.r_[True, (ordered[:, 1:] != ordered[:, :-1]).any(0)]] if len(order) else order


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    total = np.cumsum(lengths, dtype=np.int64)
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_columns(df: DataFrame, column: str, fields: list[T.StructField], work: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the fields that work() computes from blocks of rows.

    A column of df that is named like a new field is replaced by it.
    """
    names = {f.name.lower() for f in fields}
    stay = [c for c in (keep if keep is not None else df.columns) if c.lower() not in names]
    source = df.select(*dict.fromkeys([*stay, column]))
    schema = T.StructType([*(T.StructField(c, source.schema[c].dataType) for c in stay), *fields])
    added = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(work(part), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *arrays], names=[*stay, *added.names])

    return source.mapInArrow(run, schema)
