"""Queries over source text: line ranges, byte spans, literal search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LINE_END, casefold, lines_of, newline_count, walk_key
from ..storage import stored
from .classify import BadInput

MAX_LINES, MAX_FILE_BYTES, MAX_SEARCH_FILES, MAX_SEARCH_BYTES, EXCERPT = 200, 2 << 20, 5000, 10 << 20, 1000


def check_range(start_line: int, end_line: int, most: int = MAX_LINES) -> None:
    for value in (start_line, end_line):
        if type(value) is not int:
            raise BadInput("lines are whole numbers")
    if not 1 <= start_line <= 10_000_000 or not start_line <= end_line <= start_line + most - 1:
        raise BadInput(f"end_line must lie within {most} lines from start_line")


def lines_with_ends(text: Column) -> Column:
    """Lines with their ends kept; none for the empty text."""
    return F.filter(F.split(text, rf"(?<=\r\n)|(?<=\r)(?!\n)|(?<={LINE_END.split('|', 1)[1].replace(chr(13), '')})"), lambda x: x != "")


def read_range(files: DataFrame, start_line: int = 1, end_line: int = 120, most: int = MAX_LINES) -> DataFrame:
    """files(path, content) with the text of a line range, its real end, total lines and hash.

    A start beyond the end of a file gives null content, but line 1 of an
    empty file is the empty text.
    """
    check_range(start_line, end_line, most)
    lines = lines_with_ends(F.col("content"))
    total = F.size(lines)
    end = F.least(F.lit(end_line), total)
    text = F.array_join(F.slice(lines, F.lit(start_line), F.greatest(end - start_line + 1, F.lit(0))), "")
    ok = (F.lit(start_line) <= total) | ((total == 0) & (F.lit(start_line) == 1))
    return files.select("path", F.when(ok, text).alias("content"), F.lit(start_line).alias("start_line"), end.alias("end_line"), total.alias("total_lines"), F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


def span_source(files: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """files(path, content, start_byte, end_byte) with the source of the span and its lines."""
    raw = F.encode("content", "UTF-8")
    piece = F.decode(F.substr(raw, F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    before = F.decode(F.substr(raw, F.lit(1), F.col("start_byte").cast("int")), "UTF-8")
    ok = (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.octet_length("content"))
    lines = lines_with_ends(F.col("_piece"))
    cut = F.when(F.size(lines) > most, F.array_join(F.slice(lines, 1, most), "")).otherwise(F.col("_piece"))
    out = files.filter(ok).withColumn("_piece", piece).withColumn("start_line", newline_count(before) + 1).withColumn("truncated", F.size(lines) > most).withColumn("source", cut)
    return out.withColumn("end_line", F.col("start_line") + F.greatest(F.size(lines_of(F.col("source"))) - 1, F.lit(0))).drop("_piece")


def walked(files: DataFrame, max_files: int = MAX_SEARCH_FILES, max_bytes: int = MAX_SEARCH_BYTES, max_file_bytes: int = MAX_FILE_BYTES, partition: tuple[str, ...] = ()) -> DataFrame:
    """files(path, content, …) of a walk with what the budgets admit.

    `searched` is false for unreadable files (they use up the file budget
    only) and from the first file on that is over a budget (`stopped`).  The
    contents are not among the columns that come back.

    Files are dealt by ranges of the walk; each range has its own running
    totals and adds those of the ranges before, so no task sees a whole walk.
    """
    size = F.octet_length("content").cast("long")
    readable = F.coalesce((size <= max_file_bytes) & ~F.col("content").contains("\0"), F.lit(False))
    kept = [c for c in files.columns if c != "content"]
    plain = files.select(*kept, readable.alias("readable"), F.when(readable, size).otherwise(0).alias("_size"), walk_key(F.col("path")).alias("_key"))
    deal = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of the range is stored, as a second sampling could draw other bounds
    ranges = stored(plain.repartitionByRange(deal, *partition, "_key").withColumn("_range", F.spark_partition_id()), "walk")
    walk = [*partition, "_range"]
    totals = ranges.groupBy(*walk).agg(F.count("*").alias("_files"), F.sum("_size").alias("_bytes"))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(*(F.col(c).alias(f"_{c}_") for c in walk), F.coalesce(F.sum("_files").over(before), F.lit(0)).alias("_files"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes"))
    order = Window.partitionBy(*walk).orderBy("_key")
    out = ranges.withColumns({"_number": F.row_number().over(order), "_sum": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in walk]
    out = out.join(F.broadcast(totals), same).withColumns({"file_number": F.col("_number") + F.col("_files"), "bytes": F.col("_sum") + F.col("_bytes")})
    # both totals only grow along the walk, so the first file over a budget stops all behind it
    stopped = (F.col("file_number") > max_files) | (F.col("bytes") > max_bytes)
    return out.select(*kept, "readable", "file_number", "bytes", stopped.alias("stopped"), (F.col("readable") & ~stopped).alias("searched"))


def matches(files: DataFrame, query: str, path_filter: str = "", excerpt: int = EXCERPT, exact_fold: bool = False) -> DataFrame:
    """One row for each line that contains the query, caseless: path, line, excerpt, sha256."""
    if not query.strip():
        raise BadInput("query is blank")
    kept = files.filter(F.coalesce(F.col("path"), F.lit("")).contains(path_filter)) if path_filter else files
    found = kept.select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), F.posexplode(lines_of(F.col("content"))).alias("at", "body"))
    found = found.filter(casefold(F.col("body"), exact_fold).contains(query.casefold()))
    return found.select("path", (F.col("at") + 1).alias("line"), F.left("body", F.lit(excerpt)).alias("content"), (F.length("body") > excerpt).alias("excerpt_truncated"), "sha256")


def search(files: DataFrame, query: str, path_filter: str = "", limit: int = 20, **budgets: int) -> dict:
    """The first `limit` matches in walk order, with what was skipped and whether more exists."""
    kept = files.filter(F.col("path").contains(path_filter)) if path_filter else files
    walk = walked(kept, **budgets)
    found = matches(kept.join(walk.filter("searched").select("path"), "path", "left_semi"), query, exact_fold=True).orderBy(walk_key(F.col("path")), "line").limit(limit + 1)
    rows = found.collect()
    counts = walk.agg(F.count_if(~F.col("readable") & ~F.col("stopped")).alias("skipped"), F.max("stopped").alias("stopped"), F.count_if("searched").alias("searched")).first()
    return {"matches": rows[:limit], "truncated": len(rows) > limit or bool(counts["stopped"]), "files_searched": counts["searched"], "files_skipped": counts["skipped"]}
