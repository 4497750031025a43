"""Quality rules by repetition coverage (operator 3).

Words are runs of non-white-space (ASCII white space).  Rolling hashes over
word hashes find, for several n-gram lengths, the n-grams that a text repeats;
the share of its characters inside such n-grams, and inside repeated lines,
decides.  Everything is computed block-wise in numpy on the texts' bytes: no
shuffle, no model, no state between texts.

Defined cases: a null or empty text has no words and fails; a text of one very
long word, or of many lines, is measured whole; copies get the same verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vectext as V

#: n-gram length -> largest share of word characters inside n-grams that the text repeats.
MAX_NGRAM_SHARE = {5: 0.5, 8: 0.4, 10: 0.35, 16: 0.3}
#: Largest share of characters inside lines that occur earlier in the text.
MAX_LINE_SHARE = 0.4
BASE_WINDOW, BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 8, 20, 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = 0x0A

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("dup_line_share", T.DoubleType()),
]


def _line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the \\n-split lines of all texts."""
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    text = np.searchsorted(bounds[1:], starts, "right")
    # a text that ends in a line break has an empty last line, at the bound of the next text
    own = np.searchsorted(breaks, bounds[1:], "left") - np.searchsorted(breaks, bounds[:-1], "left") + 1
    text = np.repeat(np.arange(len(own)), own)
    ends = np.append(starts[1:] - 1, bounds[-1])
    last = np.cumsum(own) - 1
    ends[last] = bounds[1:]
    return starts, ends, text


def measure(data: np.ndarray, bounds: np.ndarray, max_ngram_share: dict[int, float], max_line_share: float) -> dict[str, np.ndarray]:
    """All figures of a block of texts, one entry for each text."""
    w = V.Words(data, bounds)
    n_texts, n_words = len(bounds) - 1, np.diff(w.first)
    points = V.code_points(data)
    chars = points[w.ends] - points[w.starts]
    word_chars = V.sum_by_text(chars, w.first)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": V.sum_by_text(_SYMBOLS[data], bounds)}

    starts, ends, text = _line_bounds(data, bounds)
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    key = V.mix(V.byte_hashes(data, starts, ends) + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(text[later], minlength=n_texts)
    line_chars = points[ends] - points[starts]
    share = lambda part, whole: part / np.maximum(whole, 1)
    out["dup_line_share"] = share(np.bincount(text[later], line_chars[later], n_texts), np.bincount(text, line_chars, n_texts))
    bad = out["dup_line_share"] > max_line_share

    hashes, left = w.hashes(), w.left_in_text()
    salt = w.text_of_word().astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for n in sorted({BASE_WINDOW, *max_ngram_share}):
        at, h = V.windows(hashes, left, n)
        twice = at[V.repeated(V.mix(h + salt[at]))]
        inside = V.covered(twice, n, len(hashes))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = V.sum_by_text(inside, w.first)
        if n in max_ngram_share:
            out[f"dup_{n}gram_share"] = share(V.sum_by_text(chars * inside, w.first), word_chars)
            bad |= out[f"dup_{n}gram_share"] > max_ngram_share[n]
    out["base_failed"] = (n_words < BASE_MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def repetition_quality(df: DataFrame, text: str = "text", keep: list[str] | None = None, max_ngram_share: dict[int, float] | None = None, max_line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """df (or its columns `keep`) with the figures and the verdict `kept`.

    n_dup_lines counts lines with a word that equal an earlier line;
    n_repeat_words counts words in 8-word windows that the text has twice or
    more; `base_failed` is the plain rule on these, `kept` also needs every
    share of repeated characters to stay within its limit.
    """
    limits = MAX_NGRAM_SHARE if max_ngram_share is None else max_ngram_share
    fields = [*FIELDS, *(T.StructField(f"dup_{n}gram_share", T.DoubleType()) for n in sorted(limits))]

    def work(part: pa.RecordBatch) -> list:
        found = measure(*V.utf8(part.column(text)), limits, max_line_share)
        return [found[f.name] for f in fields]

    return V.with_columns(df, text, fields, work, keep)
