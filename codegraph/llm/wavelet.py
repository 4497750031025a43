"""Wavelet matrix: a sequence of token ids as succinct bit planes.

Plane by plane from the highest bit, the sequence is split stably into zeros
and ones.  With rank over the planes one file answers access, counting and
occurrence lookup of a token without decoding, and decodes whole ranges plane
by plane.  Rank uses a directory of one 32-bit count per 512 bits.

File layout (little-endian): magic "WVM1", then uint32 bits, uint64 tokens,
uint64 documents, then sections, each a uint64 length and a zstd frame:
document ids (int64), their validity (uint8), first token of each document and
the end (uint64), zeros of each plane (uint64), then for each plane its packed
bits (lowest bit first) and its rank directory.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512
_HEAD = struct.Struct("<4sIQQ")


class WaveletMatrix:
    def __init__(self, length: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None) -> None:
        self.length, self.planes, self.zeros = length, planes, zeros
        self.bits = len(planes)
        self.ranks = ranks or [_directory(p) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (now >> now.dtype.type(b)) & now.dtype.type(1) != 0
            planes.append(_packed(one))
            low = now[~one]
            zeros.append(len(low))
            now = np.concatenate([low, now[one]])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids: the stable splits undone from the lowest plane up."""
        now = np.zeros(self.length, np.uint16 if self.bits <= 16 else np.uint32)
        for b, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.length, bitorder="little").view(bool)
            out = np.empty_like(now)
            out[~one] = now[:zeros]
            out[one] = now[zeros:] | now.dtype.type(1 << b)
            now = out
        return now.astype(np.uint32)

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[plane][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at // BLOCK
        total = self.ranks[plane][block].astype(np.int64)
        bits = np.unpackbits(self.planes[plane][(block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8))], axis=1, bitorder="little")
        return total + np.where(np.arange(BLOCK) < (at - block * BLOCK)[:, None], bits, 0).sum(1, dtype=np.int64)

    def _select(self, plane: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Position of the nth (from 0) one or zero."""
        ranks = self.ranks[plane].astype(np.int64)
        ranks = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = np.searchsorted(ranks, nth, "right") - 1
        bits = np.unpackbits(self.planes[plane][(block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8))], axis=1, bitorder="little") == one
        return block * BLOCK + (np.cumsum(bits, 1) <= (nth - ranks[block])[:, None]).sum(1, dtype=np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given positions."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(len(at), np.uint32)
        for plane in range(self.bits):
            one = self._bit(plane, at).astype(bool)
            ones = self._rank1(plane, at)
            at = np.where(one, self.zeros[plane] + ones, at - ones)
            out = out << np.uint32(1) | one
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        bounds = np.array([start, end])
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            ones = self._rank1(plane, bounds)
            bounds = self.zeros[plane] + ones if token >> (self.bits - 1 - plane) & 1 else bounds - ones
        return int(bounds[0]), int(bounds[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range of positions."""
        low, high = self._range(token, start, self.length if end is None else end)
        return high - low

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of a token in a range, ascending."""
        at = np.arange(*self._range(token, start, self.length if end is None else end))
        for plane in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - plane) & 1)
            at = self._select(plane, at - self.zeros[plane] if one else at, one)
        return at


def _packed(one: np.ndarray) -> np.ndarray:
    """Packed bits, padded to whole rank blocks and one block more."""
    packed = np.packbits(one, bitorder="little")
    size = (len(one) // BLOCK + 1) * (BLOCK // 8)
    return np.concatenate([packed, np.zeros(size - len(packed), np.uint8)])


def _directory(plane: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)[:-1]])


def write_shard(ids: np.ndarray, doc_ids: list[int | None], bounds: np.ndarray, level: int = 1) -> bytes:
    """One shard file: the ids of its documents, bounds[i]:bounds[i + 1] those of document i."""
    matrix = WaveletMatrix.build(ids)
    names = np.array([0 if d is None else d for d in doc_ids], np.int64)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    press = zstandard.ZstdCompressor(level=level).compress
    sections = [names, valid, np.asarray(bounds, np.uint64), np.array(matrix.zeros, np.uint64)]
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        sections += [plane, ranks]
    out = [_HEAD.pack(MAGIC, matrix.bits, len(ids), len(doc_ids))]
    for s in sections:
        frame = press(s.tobytes())
        out += [struct.pack("<Q", len(frame)), frame]
    return b"".join(out)


def read_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, document ids, bounds) of a shard file."""
    magic, bits, n, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    at, parts, unpress = _HEAD.size, [], zstandard.ZstdDecompressor().decompress
    while at < len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        parts.append(unpress(data[at + 8 : at + 8 + size]))
        at += 8 + size
    names, valid = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.uint8)
    planes = [np.frombuffer(p, np.uint8) for p in parts[4::2]]
    ranks = [np.frombuffer(p, np.uint32) for p in parts[5::2]]
    if len(planes) != bits:
        raise ValueError("damaged wavelet shard")
    matrix = WaveletMatrix(n, planes, np.frombuffer(parts[3], np.uint64).astype(int).tolist(), ranks)
    return matrix, [int(d) if v else None for d, v in zip(names, valid)], np.frombuffer(parts[2], np.uint64).astype(np.int64)
