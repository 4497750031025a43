"""Secret scans by assignment-aware lexing (operator 1).

Two layers work on every whole text.  Fixed patterns find assignments to
well-known names, access key ids and long hex strings.  Then a small lexer
reads the text as source or configuration syntax: names, string and bare
literals, `=`, `:`, `:=`, `=>`, `+`, brackets, comments.  It keeps a table of
constants (name -> the literals it was made of), follows references and
concatenations through it, and scores the literals that reach a sensitive
target name by name and by strength.  The lexer runs on every text that has
the stem of a sensitive name and, anywhere behind it, an operator that may
assign.  Every name with a score holds a stem and stands before its operator,
so the lexer could add nothing to the other texts.

Defined cases: null is the empty text and has no findings; spans count code
points, ends exclusive; repeated rows each get their findings; an empty table gives
an empty result; texts of any length are scanned whole, in linear time:
comments and strings that never close are looked for once, and references to
constants are followed, not expanded.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V

#: Kinds in their listed order.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# runs are maximal, so asking for the least length inside the pattern finds the same runs
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6

_STEM = re.compile(r"pass|pwd|secret|token|key|cred|auth", re.I | re.A)
#: A comment by `//` does not follow a name or a colon (`http://`), one by `#` stands alone or first.
_LEX = re.compile(
    r"""(?P<skip>[ \t\r]+|(?<![\w:])//[^\n]*|(?<!\S)\#[^\n]*)
      | (?P<open>/\*)
      | (?P<line>\n)
      | (?P<quote>["'])
      | (?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)
      | (?P<bare>[0-9+/_=.\-]*[0-9][\w+/=.\-]*)
      | (?P<op>:=|=>|==|!=|<=|>=|\+=|[=:+,;(){}\[\]])
      | (?P<other>.)""",
    re.X | re.A | re.S,
)
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+", re.S) for q in "\"'"}
_STRONG = {"password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "secretkey", "authkey"}
_STRONG_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("auth", "key"), ("signing", "key"), ("encryption", "key"), ("pass", "phrase")}
_WEAK = {"key", "auth", "pass", "cred", "creds"}
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|null|none|nil|true|false|undefined|changeme|change_me|example|placeholder|todo|<.*>|\$\{.*|\{\{.*|%\(.*|your[_-].*)$", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
MIN_SCORE = 1.0


def name_score(name: str) -> float:
    """How sensitive a target name is: 1 strong, 0.5 weak, else 0."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if any(p in _STRONG for p in parts) or any(pair in _STRONG_PAIRS for pair in zip(parts, parts[1:])):
        return 1.0
    return 0.5 if any(p in _WEAK for p in parts) else 0.0


def _strength(n: float, counts: dict[str, float], looks: str) -> float:
    if n < MIN_ASSIGNED or _PLACEHOLDER.match(looks) or any(c.isspace() for c in counts):
        return 0.0
    bits = n * -sum(k / n * math.log2(k / n) for k in counts.values())
    return 2.0 if bits >= 64 else 1.0 if bits >= 24 else 0.0


def literal_score(value: str) -> float:
    """Strength of a literal: 1 from about 24 bits of empirical entropy on, 2 from 64 bits on."""
    return _strength(len(value), Counter(value), value)


@dataclass(frozen=True)
class Literal:
    start: int
    end: int
    value: str
    quoted: bool


class Value:
    """What was assigned: literals and references to earlier values, never expanded.

    Values form an acyclic graph, as a name refers to what it held before, so
    a chain that doubles its text on every line stays as small as its lines.
    """

    __slots__ = ("parts", "figures", "marked")

    def __init__(self, parts: list[Literal | Value]) -> None:
        self.parts, self.figures, self.marked = parts, None, 0.0

    def strength(self) -> float:
        """The score of the joined literals, from their character counts, first and last characters."""
        todo = [self]
        while todo:
            now = todo[-1]
            missing = [x for x in now.parts if isinstance(x, Value) and x.figures is None] if now.figures is None else []
            todo += missing
            if missing:
                continue
            todo.pop()
            if now.figures is None:
                now.figures = now._joined()
        n, counts, head, tail = self.figures
        return _strength(n, counts, head if n <= _ENDS else head + tail)

    def _joined(self) -> tuple[float, dict[str, float], str, str]:
        n, counts, head, tail = 0.0, Counter(), "", ""
        for x in self.parts:
            m, more, first, last = (len(x.value), Counter(x.value), x.value[:_ENDS], x.value[-_ENDS:]) if isinstance(x, Literal) else x.figures
            n += m
            counts.update(more)
            head, tail = (head + first)[:_ENDS] if len(head) < _ENDS else head, (tail + last)[-_ENDS:]
        if n > 1e200:  # far above every limit: only the shares matter
            n, counts = n / 1e150, Counter({c: k / 1e150 for c, k in counts.items()})
        return n, counts, head, tail

    def mark(self, score: float) -> Iterator[Literal]:
        """The literals of this value and of all it refers to, but for values marked with this score or more."""
        todo = [self]
        while todo:
            now = todo.pop()
            if now.marked >= score:
                continue
            now.marked = score
            for x in now.parts:
                if isinstance(x, Literal):
                    yield x
                else:
                    todo.append(x)


#: Characters of a joined value's beginning and end that the placeholder patterns look at.
_ENDS = 256


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, word, start, end) of the lexer's tokens, in linear time.

    A comment that never closes is looked for once.  A quote that doesn't close
    is a character like others; a later one that its scan has passed, where it
    was escaped, would scan to the same end and isn't tried again.
    """
    scan, closes, dead = _LEX.scanner(text), True, {'"': 0, "'": 0}
    while m := scan.match():
        kind, at = m.lastgroup, m.end()
        if kind == "skip":
            continue
        if kind == "open" and closes:
            end = text.find("*/", at)
            if end >= 0:
                scan = _LEX.scanner(text, end + 2)
                continue
            closes = False
        if kind == "quote" and m.start() >= dead[m.group()]:
            end = _BODY[m.group()].match(text, at).end()
            if text[end : end + 1] == m.group():
                yield "string", text[m.start() : end + 1], m.start(), end + 1
                scan = _LEX.scanner(text, end + 1)
                continue
            dead[m.group()] = end
        yield kind if kind not in ("open", "quote") else "other", m.group(), m.start(), at


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(target name, its value), in order of assignment."""
    constants: dict[str, Value] = {}
    target, value, want, joined = None, [], False, False  # want: a value may follow

    before: tuple[str, str] | None = None  # the last name or string, a possible target

    def close():
        nonlocal target, value, want
        done = (target, Value(value)) if target is not None and value else None
        if done:
            constants[target] = done[1]
        target, value, want = None, [], False
        return done

    quoted = lambda x: isinstance(x, Literal) and x.quoted
    for kind, word, start, end in tokens(text):
        if kind in ("string", "name", "bare"):
            if target is not None and (want or joined or kind == "string" and value and quoted(value[-1]) and before is None):
                if kind == "string":
                    value.append(Literal(start + 1, end - 1, word[1:-1], True))
                elif kind == "name" and word in constants:
                    value.append(constants[word])
                else:
                    value.append(Literal(start, end, word, False))
                want = joined = False
                # `a: b = "c"` names a type after the colon: b may be a target itself
                before = (kind, word) if kind == "name" else None
                continue
            if done := close():
                yield done
            before = (kind, word[1:-1] if kind == "string" else word)
        elif kind == "op" and word in ("=", ":", ":=", "=>") and before:
            typed = target is not None and word == "=" and len(value) == 1 and not quoted(value[0])
            name = target if typed else before[1]
            if typed:
                value = []
            elif done := close():
                yield done
            target, want, before, joined = name, True, None, False
        elif kind == "op" and word == "+" and value:
            joined = True
        elif kind == "op" and word == "]" and before:
            continue  # settings["key"] = ...
        elif kind == "op" and word == "(" and target is not None and (joined or want):
            continue
        else:
            if done := close():
                yield done
            before, joined = None, False
    if done := close():
        yield done


def may_assign(text: str) -> bool:
    """Whether a sensitive name could be assigned to: a stem, and behind it a `=` or `:`."""
    stem = _STEM.search(text)
    return stem is not None and max(text.rfind("="), text.rfind(":")) >= stem.end()


def findings(text: str | None) -> list[tuple[str, int, int, float, str | None]]:
    """(kind, start, end, score, target name) by start, then kind as listed.

    A literal of a sensitive target within the span of a fixed pattern adds no
    span of its own but gives that one its name and score.
    """
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGNED]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    named: dict[tuple[str, int, int], tuple[float, str | None]] = {f: (1.0, None) for f in found}
    if may_assign(text):
        # of the spans that begin up to a place, the one that reaches furthest
        starts, reach = [f[1] for f in found], []
        for f in found:
            reach.append(f if not reach or f[2] > reach[-1][2] else reach[-1])
        for name, value in pairs(text):
            weight = name_score(name)
            strength = weight * value.strength() if weight else 0.0
            if strength < MIN_SCORE:
                continue
            for x in value.mark(strength):
                # a bare word counts as a secret only if it doesn't look like prose
                if x.end == x.start or not x.quoted and not (len(x.value) >= 12 and any(c.isdigit() for c in x.value)):
                    continue
                at = bisect_right(starts, x.start) - 1
                span = reach[at] if at >= 0 and reach[at][2] >= x.end else ("literal", x.start, x.end)
                old = named.get(span)
                if old is None or old[1] is None or strength > old[0]:
                    named[span] = (strength, name)
    return [(*span, *named[span]) for span in sorted(named, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))]


FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("name", T.StringType())])


def secret_findings(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with `findings`: array of (kind, start, end, score, name).

    A column of df of that name is replaced.
    """

    def work(part: pa.RecordBatch) -> list:
        return [[[dict(zip(FINDING.names, f)) for f in findings(t)] for t in part.column(text).to_pylist()]]

    return V.with_columns(df, text, [T.StructField("findings", T.ArrayType(FINDING))], work, keep)


def span_list(found: F.Column) -> F.Column:
    """kind:start:end of the findings, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count_kind(found: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
