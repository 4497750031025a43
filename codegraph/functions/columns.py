"""Column expressions shared by the operators; all native, all null-safe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line ends as str.splitlines() has them: CRLF first, then the single characters.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Directories that a checkout walk leaves out (fixed values).
EXCLUDED_DIRECTORIES = (".git", ".venv", "venv", "node_modules", "build", "__pycache__", ".pytest_cache")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows in the name; a leading dot alone begins no extension."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def safe_path(path: Column) -> Column:
    """A non-empty relative path without `..` or `.git` components and NUL."""
    parts = F.split(path, "/")
    bad = path.startswith("/") | F.array_contains(parts, "..") | F.array_contains(parts, ".git") | path.contains("\0") | (path == "")
    return F.coalesce(~bad, F.lit(False))


def identity(*parts: Column) -> Column:
    """A compact JSON array of strings; null parts become empty strings."""
    return F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; no empty line after a final line end."""
    parts = F.split(text, LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def terms_of(query: Column) -> Column:
    """Runs of a-z, 0-9 and _ in the folded query, repetitions kept."""
    return F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_]+)"), F.lit(1))


def term_score(haystack: Column, terms: list[str]) -> Column:
    """How many terms are contained; a repeated term counts each time."""
    score = F.lit(0)
    for term in terms:
        score = score + F.when(haystack.contains(term), 1).otherwise(0)
    return score


@F.pandas_udf(T.StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def casefold(text: Column, exact: bool = False) -> Column:
    """Caseless form; `exact` sends non-ASCII rows through full Unicode folding."""
    if not exact:
        return F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), _casefold(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(F.lower(text))


def percent_encode(text: Column) -> Column:
    """Bytes other than A-Z a-z 0-9 - . _ ~ as %XX, upper-case."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))

    def one(pair: Column) -> Column:
        code = F.conv(pair, 16, 10).cast("int")
        plain = code.between(48, 57) | code.between(65, 90) | code.between(97, 122) | code.isin(45, 46, 95, 126)
        return F.when(plain, F.chr(code)).otherwise(F.concat(F.lit("%"), pair))

    return F.array_join(F.transform(pairs, one), "")


def point_id(task: Column, generation: Column, chunk: Column) -> Column:
    """hex(task, 16) hex(generation, 8) hex(chunk, 8), dashed 8-4-4-4-12."""
    pad = lambda x, n: F.lower(F.lpad(F.hex(x.cast("long")), n, "0"))
    whole = F.concat(pad(task, 16), pad(generation, 8), pad(chunk, 8))
    cut = lambda a, n: F.substring(whole, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def walk_key(path: Column) -> Column:
    """Sort key of a walk that lists the files of a directory before its subdirectories."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda name, i: F.struct((i < F.size(parts) - 1).cast("int").alias("is_dir"), name.alias("name")))


def qualify(scope: Column, spelling: Column) -> Column:
    """scope::spelling; a leading :: is global, and a name that has its scope keeps it."""
    prefix = F.concat(scope, F.lit("::"))
    whole = F.when((scope == "") | spelling.startswith(prefix), spelling).otherwise(F.concat(prefix, spelling))
    return F.when(spelling.startswith("::"), F.substr(spelling, F.lit(3))).otherwise(whole)


def hex_revision(text: Column) -> Column:
    return F.coalesce(text.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), F.lit(False))
