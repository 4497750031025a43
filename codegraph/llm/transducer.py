"""A byte-pair tokenizer compiled to a deterministic finite-state transducer.

Reading a pre-token byte by byte, the encoding of every prefix ends in one
token, and it is the only token u such that the encoding of the prefix before
u ends in a token that u may follow.  Which token may follow which is decided
by the merges alone.  So what the future depends on is: the suffixes of the
prefix that can still grow into a longer token, and for each of them the token
that ends before it and its count relative to now.  That is a state of the
transducer; a transition is annotated with the change of the token count, and
a final transition (the last byte of a pre-token, which carries the end-of-word
mark) with what the pre-token ends on.  Counts telescope: their sum is the
number of tokens.

States are found as texts need them (lazy determinisation) and kept in dense
numpy tables of bounded size, so all pre-tokens of a block run in lockstep.  A chunk of text is
a map from the state at its start to the state at its end plus a count; it is
constant from the first pre-token start in the chunk on.  Chunk maps are
composed by a parallel prefix scan, so chunks may cut pre-tokens anywhere.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

END = "</w>"
CHUNK = 1 << 16
#: Bytes of tables and keys of the states that a worker keeps; when a step goes beyond, all states but those in use are forgotten.
STATE_BYTES, KEY_BYTES = 224 << 20, 500
_UNKNOWN = -1


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in stand_in)
    stand_in.update({b: chr(256 + n) for n, b in enumerate(others)})
    return [stand_in[b] for b in range(256)]


class Merges:
    """Byte-pair encoding of symbol sequences, and which token may follow which."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.rank = {m: i for i, m in enumerate(merges)}
        self.alone: dict[str, bool] = {}
        self.pair: dict[tuple[str, str], bool] = {}

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            return [*token[: -len(END) - 1], token[-len(END) - 1 :]]
        return list(token)

    def encode(self, symbols: list[str]) -> list[str]:
        worst = len(self.rank)
        while len(symbols) > 1:
            ranks = [self.rank.get(p, worst) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == worst:
                break
            merged, i = [], 0
            while i < len(symbols):
                if i < len(ranks) and ranks[i] == best:
                    merged.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    merged.append(symbols[i])
                    i += 1
            symbols = merged
        return symbols

    def is_token(self, token: str) -> bool:
        """In the vocabulary, and the encoding of its own symbols."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = token in self.vocab and self.encode(self.symbols(token)) == [token]
        return known

    def may_follow(self, before: str | None, token: str) -> bool:
        if before is None:
            return True
        known = self.pair.get((before, token))
        if known is None:
            known = self.pair[before, token] = self.encode(self.symbols(before) + self.symbols(token)) == [before, token]
        return known


class Transducer:
    """Token counts of pre-tokens; states and transitions are added when first met."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.merges = Merges(vocab, merges)
        self.names = byte_symbols()
        bodies = (t[: -len(END)] if t.endswith(END) else t for t in vocab)
        self.growing = {b[:i] for b in bodies for i in range(len(b))}  # proper prefixes of tokens
        self.limit = STATE_BYTES
        self.reset()

    def reset(self, width: int = 64) -> None:
        self.number: dict[tuple, int] = {}
        self.in_use = 0  # states that were kept when others were last forgotten
        self.states: list[tuple] = []
        self.symbol = np.full(256, _UNKNOWN, np.int64)  # dense numbers of the bytes that occur
        self.bytes: list[int] = []
        self.to = np.full((1024, width), _UNKNOWN, np.int32)
        self.change = np.zeros((1024, width), np.int8)
        self.final = np.full((1024, width), _UNKNOWN, np.int8)
        self._state((("", None, 0),))

    def _state(self, key: tuple) -> int:
        known = self.number.get(key)
        if known is None:
            known = self.number[key] = len(self.states)
            self.states.append(key)
            if known == len(self.to):
                more = lambda a, fill: np.concatenate([a, np.full_like(a[: max(1024, len(a) // 4)], fill)])
                self.to, self.change, self.final = more(self.to, _UNKNOWN), more(self.change, 0), more(self.final, _UNKNOWN)
        return known

    def _forget(self, used: np.ndarray) -> np.ndarray:
        """Drop all states but the given ones; returns their new numbers."""
        keys, place = np.unique(used, return_inverse=True)
        kept = [self.states[i] for i in keys.tolist()]
        symbol, bytes_ = self.symbol, self.bytes
        self.reset(max(64, self.to.shape[1]))
        self.symbol, self.bytes = symbol, bytes_
        numbers = np.array([self._state(k) for k in kept], np.int64)
        self.in_use = len(self.states)
        return numbers[place]

    def full(self) -> bool:
        return len(self.states) * (6 * self.to.shape[1] + KEY_BYTES) > self.limit and len(self.states) > 2 * self.in_use

    def symbols(self, data: np.ndarray) -> np.ndarray:
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.symbol < 0))
        for b in new.tolist():
            self.symbol[b] = len(self.bytes)
            self.bytes.append(b)
        if len(self.bytes) > self.to.shape[1]:
            wide = lambda a, fill: np.concatenate([a, np.full_like(a, fill)], axis=1)
            self.to, self.change, self.final = wide(self.to, _UNKNOWN), wide(self.change, 0), wide(self.final, _UNKNOWN)
            return self.symbols(data)
        return self.symbol[data]

    def _add_step(self, state: int, symbol: int) -> None:
        c = self.names[self.bytes[symbol]]
        found, grown = None, []
        for suffix, before, count in self.states[state]:
            token = suffix + c
            if found is None and self.merges.is_token(token) and self.merges.may_follow(before, token):
                found = token, count + 1
            if token in self.growing:
                grown.append((token, before, count))
        token, change = found
        to = self._state((*((s, before, count - change) for s, before, count in grown), ("", token, 0)))
        self.to[state, symbol], self.change[state, symbol] = to, change

    def _add_final(self, state: int, symbol: int) -> None:
        c = self.names[self.bytes[symbol]]
        for suffix, before, count in self.states[state]:
            token = suffix + c + END
            if self.merges.is_token(token) and self.merges.may_follow(before, token):
                self.final[state, symbol] = count + 1
                return
        raise ValueError("the vocabulary cannot end a word in every byte")

    def _fill(self, table: str, add, states: np.ndarray, symbols: np.ndarray) -> None:
        """Add the transitions that a step needs and the table lacks."""
        miss = getattr(self, table)[states, symbols] == _UNKNOWN
        if miss.any():
            width = self.to.shape[1]
            for cell in np.unique(states[miss] * width + symbols[miss]).tolist():
                add(cell // width, cell % width)

    def run(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and count changes after reading symbols[start:end] from the given states, all in lockstep."""
        states, counts = states.astype(np.int64, copy=True), np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the active ones are a prefix
        length = (ends - starts)[order]
        now, total, at = states[order], counts[order], starts[order]
        active = len(order)
        step = 0
        while active := int(np.searchsorted(-length[:active], -step, "left")):
            s, c = now[:active], symbols[at[:active] + step]
            self._fill("to", self._add_step, s, c)
            total[:active] += self.change[s, c]
            now[:active] = self.to[s, c]
            step += 1
            if self.full():
                now = self._forget(now)
        states[order], counts[order] = now, total
        return states, counts

    def finish(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Count changes of the last byte of pre-tokens."""
        self._fill("final", self._add_final, states, symbols)
        return self.final[states, symbols].astype(np.int64)


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to a pre-token that is open at its start.

    The open pre-token reads symbols head_start:head_end; `closes` tells
    whether it ends there.  If the chunk begins a pre-token of its own that is
    still open at its end, `exit` is the key of its state and it carries no count yet
    (`pending`), else exit is None.
    """

    head_start: int
    head_end: int
    closes: bool
    exit: tuple | None
    pending: int


def compose(a: ChunkMap, b: ChunkMap, run) -> tuple[ChunkMap, int]:
    """First a, then b; and the count of the pre-token that the seam completes, if known now."""
    if a.exit is None and not (a.head_end > a.head_start and not a.closes):
        # nothing is open at the seam
        return ChunkMap(a.head_start, a.head_end, a.closes, b.exit, b.pending), 0
    if a.exit is None:
        # the head of a runs through: heads are adjacent and grow together
        return ChunkMap(a.head_start, b.head_end, b.closes, b.exit, b.pending), 0
    state, change, total = run(a.exit, b.head_start, b.head_end, b.closes)
    if b.closes:
        return ChunkMap(a.head_start, a.head_end, a.closes, b.exit, b.pending), a.pending + total
    return ChunkMap(a.head_start, a.head_end, a.closes, state, a.pending + change), 0


#: Character classes of the pre-tokenizer.
SPACE, LETTER, NUMBER, SYMBOL = range(4)
#: Unicode White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    table = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[_WHITE] = SPACE
    return table


def normalised(text: str) -> str:
    """NFC, then every character in lower case by itself (white space needs no change: it is dropped)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # str.lower() looks at the neighbours of a capital sigma only
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


_TAIL_1, _TAIL_2 = b"stmd", (b"re", b"ve", b"ll")


def pre_tokens(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, in code points, of the pre-tokens of texts joined without separators.

    Runs of letters, single numbers, runs of other non-space characters; an
    apostrophe that begins such a run takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    kind = character_classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.concatenate([[SPACE], kind[:-1]]) if n else kind
    start = first[:n] | (kind != before) | (kind == NUMBER)
    quote = np.flatnonzero((points == 0x27) & (first[:n] | (before != SYMBOL)))
    if len(quote):
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        end = bounds[np.searchsorted(bounds, quote, "right")]
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = np.isin(one, list(_TAIL_1)) & (quote + 1 < end)
        long = np.zeros(len(quote), bool)
        for a, b in _TAIL_2:
            long |= (one == a) & (two == b)
        long &= (quote + 2 < end) & ~short
        start[quote[short | long] + 1] = False
        for taken, width in ((quote[short], 2), (quote[long], 3)):
            after = taken + width
            after = after[after < n]
            start[after] = True
    start &= kind != SPACE
    starts = np.flatnonzero(start)
    stop = np.flatnonzero(start | (kind == SPACE) | first[:n])
    nxt = np.searchsorted(stop, starts, "right")
    ends = np.append(stop, n)[nxt]
    return starts, ends


class Counter:
    """Token counts of whole texts by a compiled tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        norm = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or norm != ["NFC", "Replace", "Lowercase"] or pre[0]["pattern"]["Regex"] != pattern or pre[1]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE with word ends and this pre-tokenizer is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.transducer = Transducer(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these it holds."""
        parts, count = [text], 0
        if "<|" not in text:
            return parts, 0
        # the leftmost special string is taken first, as the library does
        at, out = 0, []
        while True:
            hits = [(p, s) for s in self.special if (p := text.find(s, at)) >= 0]
            if not hits:
                break
            p, s = min(hits, key=lambda h: (h[0], -len(h[1])))
            out.append(text[at:p])
            at, count = p + len(s), count + 1
        return [*out, text[at:]], count

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text, without special tokens added."""
        t = self.transducer
        owner, parts = [], []
        total = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own, special = self.pieces(text)
            total[i] += special
            parts += [normalised(p) for p in own]
            owner += [i] * len(own)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        joined = "".join(parts)
        if not joined:
            return total
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = pre_tokens(points, bounds)
        text_of = np.array(owner, np.int64)[np.searchsorted(bounds, starts, "right") - 1]
        # from code points to bytes
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        starts, ends = offset[starts], offset[ends]
        symbols = t.symbols(np.frombuffer(joined.encode(), np.uint8))

        # the first fragment of every pre-token, up to its end or the next chunk bound
        edge = (starts // chunk + 1) * chunk
        cut = ends > edge
        stop = np.where(cut, edge, ends - 1)
        states, counts = t.run(symbols, starts, stop, np.zeros(len(starts), np.int64))  # state 0 is the start for good
        whole = ~cut
        done = counts[whole] + t.finish(states[whole], symbols[ends[whole] - 1])
        np.add.at(total, text_of[whole], done)
        for group in self._seams(symbols, starts[cut], ends[cut], states[cut], counts[cut], text_of[cut], chunk):
            np.add.at(total, *group)
        return total

    def _seams(self, symbols, starts, ends, states, counts, text_of, chunk):
        """Counts of the pre-tokens that chunk bounds cut, by a scan over chunk maps."""
        t = self.transducer
        if not len(starts):
            return

        def run(state: tuple, a: int, b: int, closes: bool) -> tuple[tuple, int, int]:
            # states are carried by their keys: their numbers don't last
            last = b - 1 if closes else b
            s, c = t.run(symbols, np.array([a]), np.array([last]), np.array([t._state(state)]))
            whole = int(c[0]) + (int(t.finish(s, symbols[last : last + 1])[0]) if closes else 0)
            return t.states[int(s[0])], int(c[0]), whole

        keys = [t.states[i] for i in states.tolist()]
        for a, b, state, count, text in zip(starts.tolist(), ends.tolist(), keys, counts.tolist(), text_of.tolist()):
            maps = [ChunkMap(0, 0, False, state, count)]
            for low in range((a // chunk + 1) * chunk, b, chunk):
                high = min(low + chunk, b)
                maps.append(ChunkMap(low, high, high == b, None, 0))
            found = 0
            while len(maps) > 1:  # pairwise rounds of the scan's up-sweep
                joined = [compose(x, y, run) for x, y in zip(maps[::2], maps[1::2])]
                found += sum(n for _, n in joined)
                maps = [m for m, _ in joined] + ([maps[-1]] if len(maps) % 2 else [])
            yield np.array([text]), np.array([found])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)
