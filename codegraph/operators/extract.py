"""Syntax extraction from C and C++ text without a grammar.

A lexer drops comments, literals and preprocessor lines; a scope tracker over
the remaining tokens recognises namespaces, classes with a body, function
definitions, lambdas, blocks and call sites, all with exact byte spans.  It is
an own parser and says so in its parser record: unbalanced brackets make a
file `partial`; macros and unusual declarators may be missed.

Arrays are in source order.  Runs as one Arrow batch function over files.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CODE_MODEL, MODEL_RECORD
from .classify import file_struct

PARSER = {"name": "codegraph-scopes", "runtime_version": "1", "grammar_version": "1", "extractor_version": "scopes-1"}

_TOKEN = re.compile(
    rb"""(?P<skip>[ \t\r\n\f\v]+|\\\r?\n|//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))
      | (?P<raw>(?:u8|[uUL])?R"(?P<mark>[^()\\ ]{0,16})\(.*?\)(?P=mark)")
      | (?P<string>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)
      | (?P<directive>\#(?:[^\n\\/]|\\\r?\n|\\.|/(?!/|\*)|/\*.*?\*/)*)
      | (?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)
      | (?P<number>\.?[0-9](?:[eEpP][+-]|['A-Za-z0-9_.])*)
      | (?P<op>::|->\*?|\+\+|--|<<=|>>=|<=>|[-+*/%&|^!<>=]=|&&|\|\||<<|\.\.\.|.)""",
    re.X | re.S,
)
_INCLUDE = re.compile(rb"#\s*include\s*(<[^>\n]*>|\"[^\"\n]*\"|[^\s]+)")
# Words that take parentheses or blocks without being calls or functions.
_CONTROL = {b"if", b"for", b"while", b"switch", b"catch", b"return", b"sizeof", b"alignof", b"decltype", b"typeid", b"noexcept", b"static_assert", b"alignas", b"throw", b"co_return", b"co_await", b"co_yield", b"case", b"delete", b"new", b"else", b"do", b"try", b"requires", b"goto", b"not", b"and", b"or", b"__attribute__", b"_Static_assert", b"defined", b"asm"}
_TYPES = {b"int", b"char", b"void", b"bool", b"float", b"double", b"long", b"short", b"unsigned", b"signed", b"auto", b"const", b"static", b"inline", b"constexpr", b"virtual", b"explicit", b"friend", b"extern", b"struct", b"class", b"enum", b"union", b"typename", b"volatile", b"mutable", b"template", b"using", b"typedef", b"operator", b"register", b"static_cast", b"dynamic_cast", b"const_cast", b"reinterpret_cast"}
_AFTER_PARAMETERS = {b"const", b"noexcept", b"override", b"final", b"volatile", b"&", b"&&", b"try", b"mutable", b"throw"}


@dataclass
class Token:
    kind: str
    text: bytes
    start: int
    end: int


class Extractor:
    def __init__(self, source: bytes, language: str) -> None:
        self.source, self.language = source, language
        self.breaks = [m.start() for m in re.finditer(b"\n", source)]
        self.out: dict[str, list] = {k: [] for k in ("includes", "classes", "functions", "calls", "diagnostics", "scopes")}
        self.tokens: list[Token] = []
        self.partner: dict[int, int] = {}
        self.broken = False

    def span(self, start: int, end: int) -> dict:
        line = bisect.bisect_left(self.breaks, start) + 1
        last = bisect.bisect_left(self.breaks, end) + 1
        # an end at the beginning of a line doesn't reach that line
        if end > start and last > 1 and self.breaks[last - 2] == end - 1:
            last -= 1
        return {"start_byte": start, "end_byte": end, "start_line": line, "end_line": last}

    def text(self, start: int, end: int) -> str:
        return self.source[start:end].decode("utf-8", "replace").strip(" \t\r\n")

    @staticmethod
    def occurrence(kind: str, start: int, end: int) -> str:
        return f"{kind}:{start}:{end}"

    @staticmethod
    def qualify(scope: str, name: str) -> str:
        if name.startswith("::"):
            return name[2:]
        return name if not scope or name.startswith(scope + "::") else f"{scope}::{name}"

    def lex(self) -> None:
        line_start = True
        for m in _TOKEN.finditer(self.source):
            kind = m.lastgroup if m.lastgroup != "mark" else "raw"
            if kind == "skip":
                line_start = line_start or b"\n" in m.group()
                continue
            if kind == "directive" and line_start:
                if found := _INCLUDE.match(m.group()):
                    target = found[1].decode("utf-8", "replace")
                    span = self.span(m.start(), m.end())
                    self.out["includes"].append({"target": target[1:-1] if target[:1] in '<"' else target, "line": span["start_line"], "span": span, "resolution_status": "unresolved"})
                continue
            line_start = False
            if kind == "directive":
                continue
            if kind in ("raw", "string"):
                kind = "string"
            self.tokens.append(Token(kind, m.group(), m.start(), m.end()))

    def match_brackets(self) -> None:
        closes, stack = {b")": b"(", b"]": b"[", b"}": b"{"}, []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in (b"(", b"[", b"{"):
                stack.append(i)
            elif t.text in closes:
                while stack and self.tokens[stack[-1]].text != closes[t.text]:
                    self.unbalanced(stack.pop())
                if stack:
                    self.partner[stack[-1]] = i
                    self.partner[i] = stack.pop()
                else:
                    self.unbalanced(i)
        for i in stack:
            self.unbalanced(i)

    def unbalanced(self, i: int) -> None:
        self.broken = True
        t = self.tokens[i]
        self.out["diagnostics"].append({"kind": "error", "message": f"unbalanced {t.text.decode()}", "span": self.span(t.start, t.end)})

    def name_before(self, i: int) -> tuple[int, int]:
        """Token range [a, b) of the qualified name that ends before token i, or (i, i)."""
        b, k = i, i - 1
        if k >= 0 and self.tokens[k].text == b">":  # template arguments
            depth = 0
            while k >= 0:
                text = self.tokens[k].text
                depth += (text == b">") - (text == b"<")
                if text in (b";", b"{", b"}"):
                    return i, i
                k -= 1
                if depth == 0:
                    break
        if k < 0:
            return i, i
        if self.tokens[k].kind != "name":
            # operator overloads: operator followed by its sign
            for back in (1, 2):
                if k - back >= 0 and self.tokens[k - back].text == b"operator":
                    k -= back
                    break
            else:
                return i, i
        a = k
        if a > 0 and self.tokens[a - 1].text == b"~":
            a -= 1
        while a >= 2 and self.tokens[a - 1].text == b"::" and self.tokens[a - 2].kind == "name":
            a -= 2
        if a >= 1 and self.tokens[a - 1].text == b"::":
            a -= 1
        return a, b

    def run(self) -> dict:
        self.lex()
        self.match_brackets()
        self.walk()
        for key in ("classes", "functions", "calls", "scopes"):
            self.out[key].sort(key=lambda x: (x["span"]["start_byte"], -x["span"]["end_byte"]))
        grammar = "c" if self.language == "C" else "cpp"
        return {"schema_version": 2, "parser": PARSER | {"grammar": grammar}, "parse_status": "partial" if self.broken else "complete", **self.out}

    def walk(self) -> None:
        """One pass; contexts are (close token, scope name, owner id, caller name, caller id, in function)."""
        toks, n = self.tokens, len(self.tokens)
        stack = [(n, "", "", "", "", False)]
        opened: dict[int, tuple] = {}  # body brace -> the context it opens
        begin = 0  # where the current declaration begins
        i = 0
        while i < n:
            while len(stack) > 1 and i >= stack[-1][0]:
                stack.pop()
                begin = i + 1
            t = toks[i]
            _, scope, owner, caller, caller_id, inside = stack[-1]
            if t.text == b"{" and t.kind == "op":
                close = self.partner.get(i, n)
                context = opened.pop(i, None)
                if context is None:
                    end = toks[close].end if close < n else len(self.source)
                    name = self.occurrence("block", t.start, end)
                    if inside:
                        self.out["scopes"].append({"id": name, "kind": "block", "name": "", "qualified_name": scope, "owner_id": owner, "span": self.span(t.start, end)})
                        context = (close, scope, name, caller, caller_id, True)
                    else:
                        context = (close, scope, owner, caller, caller_id, inside)
                stack.append(context)
                begin = i + 1
            elif t.text == b";" and t.kind == "op" or t.text == b":" and i and toks[i - 1].text in (b"public", b"private", b"protected"):
                begin = i + 1
            elif t.text == b"namespace" and (not i or toks[i - 1].text != b"using"):
                self.namespace(i, scope, owner, opened)
            elif t.text in (b"class", b"struct", b"union") and not (i and toks[i - 1].text == b"enum"):
                self.class_(i, scope, owner, opened)
            elif t.text == b"[" and self.lambda_(i, scope, owner, opened):
                pass
            elif t.text == b"(" and t.kind == "op":
                body = None if inside and not self.local_class(stack) else self.function(i, begin, scope, owner, opened)
                if body is None:
                    self.call(i, stack[-1])
                else:
                    begin = i
                    i = body  # parameters and initialisers hold declarations only
                    continue
            i += 1

    @staticmethod
    def local_class(stack: list[tuple]) -> bool:
        return not stack[-1][5]

    def namespace(self, i: int, scope: str, owner: str, opened: dict) -> None:
        k, name = i + 1, []
        while k < len(self.tokens) and (self.tokens[k].kind == "name" or self.tokens[k].text == b"::"):
            name.append(self.tokens[k].text.decode("utf-8", "replace"))
            k += 1
        if k < len(self.tokens) and self.tokens[k].text == b"{":
            close = self.partner.get(k, len(self.tokens))
            start, end = self.tokens[i].start, self.tokens[close].end if close < len(self.tokens) else len(self.source)
            own = "".join(name) or f"<anonymous:{start}>"
            inner, ident = self.qualify(scope, own), self.occurrence("namespace", start, end)
            self.out["scopes"].append({"id": ident, "kind": "namespace", "name": own, "qualified_name": inner, "owner_id": owner, "span": self.span(start, end)})
            opened[k] = (close, inner, ident, "", "", False)

    def class_(self, i: int, scope: str, owner: str, opened: dict) -> None:
        k, name = i + 1, ""
        while k < len(self.tokens) and self.tokens[k].text not in (b"{", b";", b"(", b")", b"=", b",", b">", b"*", b"&"):
            t = self.tokens[k]
            if t.text == b":":  # base classes
                while k < len(self.tokens) and self.tokens[k].text not in (b"{", b";"):
                    k += 1
                break
            if t.kind == "name" and t.text != b"final":
                name = (name + t.text.decode("utf-8", "replace")) if name.endswith("::") else t.text.decode("utf-8", "replace")
            elif t.text == b"::":
                name += "::"
            elif t.text == b"<":
                while k < len(self.tokens) and self.tokens[k].text not in (b">", b"{", b";"):
                    k += 1
            elif t.text == b"[":
                k = self.partner.get(k, k)
            k += 1
        if k < len(self.tokens) and self.tokens[k].text == b"{":
            close = self.partner.get(k, len(self.tokens))
            start, end = self.tokens[i].start, self.tokens[close].end if close < len(self.tokens) else len(self.source)
            kind = self.tokens[i].text.decode()
            own = name or f"<anonymous:{start}>"
            inner, ident, span = self.qualify(scope, own), self.occurrence("class", start, end), self.span(start, end)
            self.out["classes"].append({"id": ident, "name": own.rsplit("::", 1)[-1], "qualified_name": inner, "owner_id": owner, "kind": kind, "start_line": span["start_line"], "end_line": span["end_line"], "span": span})
            self.out["scopes"].append({"id": ident, "kind": kind, "name": own, "qualified_name": inner, "owner_id": owner, "span": span})
            opened[k] = (close, inner, ident, "", "", False)

    def body_after(self, close: int) -> int | None:
        """The body brace that follows a parameter list, past qualifiers, a trailing type and initialisers."""
        k, n = close + 1, len(self.tokens)
        while k < n:
            text = self.tokens[k].text
            if text == b"{":
                return k
            if text == b"->":
                while k < n and self.tokens[k].text not in (b"{", b";", b"="):
                    k = self.partner.get(k, k) if self.tokens[k].text in (b"(", b"[") else k
                    k += 1
                continue
            if text == b":":  # constructor initialisers: name(…) or name{…}, comma separated
                k += 1
                while k < n:
                    while k < n and self.tokens[k].text not in (b"(", b"{", b";"):
                        k += 1
                    if k >= n or self.tokens[k].text == b";":
                        return None
                    k = self.partner.get(k, n) + 1
                    if k < n and self.tokens[k].text == b",":
                        k += 1
                        continue
                    break
                continue
            if text in (b"noexcept", b"throw", b"__attribute__") and k + 1 < n and self.tokens[k + 1].text == b"(":
                k = self.partner.get(k + 1, n) + 1
                continue
            if text in _AFTER_PARAMETERS:
                k += 1
                continue
            return None
        return None

    def function(self, i: int, begin: int, scope: str, owner: str, opened: dict) -> int | None:
        close = self.partner.get(i)
        if close is None:
            return None
        a, b = self.name_before(i)
        if a == b or self.tokens[b - 1].text in _CONTROL or a < begin:
            return None
        if b - a == 1 and self.tokens[a].text in _TYPES:
            return None
        if any(t.text in (b"=", b"return") for t in self.tokens[begin:a]):
            return None
        body = self.body_after(close)
        if body is None:
            return None
        first = begin
        if self.tokens[first].text == b"template":  # the definition begins behind its template header
            depth, k = 0, first + 1
            while k < a:
                depth += (self.tokens[k].text == b"<") - (self.tokens[k].text == b">")
                k += 1
                if depth == 0:
                    break
            first = k
        end_token = self.partner.get(body, len(self.tokens) - 1)
        start, end = self.tokens[first].start, self.tokens[end_token].end
        spelling = self.text(self.tokens[a].start, self.tokens[b - 1].end)
        qualified = self.qualify(scope, spelling)
        name = re.sub(r"<.*>$", "", spelling).rsplit("::", 1)[-1]
        ident, span = self.occurrence("function", start, end), self.span(start, end)
        self.out["functions"].append({
            "id": ident, "name": name, "qualified_name": qualified, "signature": self.text(start, self.tokens[body].start), "return_type": self.text(start, self.tokens[a].start),
            "owner_id": owner, "kind": "function", "start_line": span["start_line"], "end_line": span["end_line"], "span": span,
        })
        self.out["scopes"].append({"id": ident, "kind": "function", "name": name, "qualified_name": qualified, "owner_id": owner, "span": span})
        opened[body] = (end_token, qualified, ident, qualified, ident, True)
        return body

    def lambda_(self, i: int, scope: str, owner: str, opened: dict) -> bool:
        before = self.tokens[i - 1] if i else None
        if before and (before.kind in ("name", "number", "string") and before.text not in _CONTROL or before.text in (b")", b"]", b"[")):
            return False  # a subscript or an attribute
        close = self.partner.get(i)
        if close is None:
            return False
        k = close + 1
        if k < len(self.tokens) and self.tokens[k].text == b"(":
            k = self.partner.get(k, len(self.tokens)) + 1
        body = k if k < len(self.tokens) and self.tokens[k].text == b"{" else self.body_after(k - 1)
        if body is None:
            return False
        end_token = self.partner.get(body, len(self.tokens) - 1)
        start, end = self.tokens[i].start, self.tokens[end_token].end
        name = f"<lambda:{start}>"
        qualified, ident, span = self.qualify(scope, name), self.occurrence("lambda", start, end), self.span(start, end)
        self.out["functions"].append({
            "id": ident, "name": name, "qualified_name": qualified, "signature": self.text(start, self.tokens[body].start), "return_type": "",
            "owner_id": owner, "kind": "lambda", "start_line": span["start_line"], "end_line": span["end_line"], "span": span,
        })
        self.out["scopes"].append({"id": ident, "kind": "lambda", "name": name, "qualified_name": qualified, "owner_id": owner, "span": span})
        opened[body] = (end_token, qualified, ident, qualified, ident, True)
        return True

    def call(self, i: int, context: tuple) -> None:
        a, b = self.name_before(i)
        if a == b or self.tokens[b - 1].text in _CONTROL or (b - a == 1 and self.tokens[a].text in _TYPES):
            return
        close = self.partner.get(i)
        if close is None:
            return
        if not context[5] and self.tokens[close + 1].text in (b";", b"=", b",", b"const", b"override", b"noexcept") if close + 1 < len(self.tokens) else False:
            return  # a declaration outside of any function
        # a name after a type is a declaration with constructor arguments
        first = a
        while first > 0 and self.tokens[first - 1].text in (b".", b"->", b"::"):
            first -= 1
            if first and self.tokens[first - 1].text in (b")", b"]"):
                first = self.partner.get(first - 1, first)
            p, _ = self.name_before(first)
            first = p if p < first else first
        if first and self.tokens[first - 1].kind == "name" and self.tokens[first - 1].text not in _CONTROL:
            return
        _, _, owner, caller, caller_id, _ = context
        start, end = self.tokens[first].start, self.tokens[close].end
        expression = self.text(start, self.tokens[i - 1].end)
        callee = re.sub(r"<.*>$", "", self.text(self.tokens[a].start, self.tokens[b - 1].end)).rsplit("::", 1)[-1]
        span = self.span(start, end)
        self.out["calls"].append({
            "id": self.occurrence("call", start, end), "caller": caller, "caller_id": caller_id, "callee": callee, "owner_id": owner,
            "expression": expression, "line": span["start_line"], "resolution_status": "unresolved", "span": span,
        })


def extract(source: str, language: str = "C++") -> dict:
    """The code model of one source text."""
    return Extractor(source.encode(), language).run()


def code_models(kept: DataFrame) -> DataFrame:
    """Model records of code artifacts: (artifact_id, model_type, file, code, sections).

    Files are dealt over the tasks first, whatever the layout of their table,
    and carried through the one pass of the extractor.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    code = kept.filter("model_type = 'code'").select(F.col("id").alias("artifact_id"), "model_type", file_struct().alias("file"), "content", "language")
    kind = to_arrow_type(CODE_MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = batch.column("content").to_pylist(), batch.column("language").to_pylist()
            models = pa.array([extract(c or "", lang) for c, lang in zip(texts, languages)], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("artifact_id", "model_type", "file")), models], ["artifact_id", "model_type", "file", "code"])

    deal = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*(f for f in code.schema.fields if f.name in ("artifact_id", "model_type", "file")), T.StructField("code", CODE_MODEL)])
    sections = MODEL_RECORD["sections"].dataType.simpleString()
    return code.repartition(deal, "artifact_id").mapInArrow(run, schema).withColumn("sections", F.lit(None).cast(sections))


def records(kept: DataFrame) -> DataFrame:
    """Model records of all stored artifacts."""
    from .classify import document_models

    return code_models(kept).unionByName(document_models(kept).withColumn("code", F.lit(None).cast(CODE_MODEL.simpleString())))
