"""Evidence interning, citation audits, delivered sets, run evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import BadInput

MODES = ("source-only", "graph")
#: Digits of any script, as the citation mark allows.
CITATION = r"\[(ev-\p{Nd}+)\]"


def interned(records: DataFrame, session: str = "session_id", identity: str = "identity", order: str = "seq") -> DataFrame:
    """(session, identity, seq, evidence_id): ids number distinct identities by first appearance."""
    first = records.groupBy(session, identity).agg(F.min(order).alias(order))
    number = F.row_number().over(Window.partitionBy(session).orderBy(order))
    return first.withColumn("evidence_id", F.concat(F.lit("ev-"), number.cast("string")))


def citations(answer: Column) -> Column:
    """Distinct cited ids in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)))


def audited(answers: DataFrame, known: Column, delivered: Column) -> DataFrame:
    """answers(answer, …) with citations, invalid_citations, has_citations, citations_valid.

    A citation counts only if its evidence exists and was delivered.
    """
    good = F.array_intersect(known, delivered)
    out = answers.withColumn("citations", citations(F.col("answer"))).withColumn("invalid_citations", F.array_except("citations", good))
    has = F.size("citations") > 0
    return out.withColumn("has_citations", has).withColumn("citations_valid", has & (F.size("invalid_citations") == 0)).withColumn("semantic_support_checked", F.lit(False))


def delivered(events: DataFrame, session: str = "session_id", ids: str = "evidence_ids") -> DataFrame:
    """(session, delivered): ids of evidence in results that were returned."""
    return events.select(session, F.explode(ids).alias("id")).groupBy(session).agg(F.sort_array(F.collect_set("id")).alias("delivered"))


def reference(record: Column) -> Column:
    """One line for a record: place, lines, revision and what identifies it."""
    filled = lambda c: F.nullif(c, F.lit(""))
    place = F.coalesce(filled(record["path"]), filled(record["node_id"]), F.lit("graph relationship"))
    lines = F.when(F.coalesce(record["start_line"], F.lit(0)) != 0, F.concat(F.lit(":"), record["start_line"].cast("string"), F.lit("-"), record["end_line"].cast("string"))).otherwise("")
    revision = F.coalesce(filled(record["revision"]), F.lit("unknown revision"))
    mark = F.when(F.coalesce(record["sha256"], F.lit("")) != "", F.concat(F.lit(" working-tree sha256="), F.left(record["sha256"], F.lit(12)))).otherwise(" graph snapshot")
    return F.concat(F.lit("["), record["evidence_id"], F.lit("] "), place, lines, F.lit(" ("), revision, mark, F.lit(")"))


def within_budget(calls: DataFrame, session: str = "session_id", turn: str = "round", order: str = "call", rounds: int = 8, per_round: int = 8) -> DataFrame:
    """calls with `admitted`: beyond the calls of a round they are errors, beyond the rounds the limit is reached."""
    by = Window.partitionBy(session, turn).orderBy(order)
    nth = F.dense_rank().over(Window.partitionBy(session).orderBy(turn))
    return calls.withColumn("place", F.row_number().over(by)).withColumn("nth_round", nth).withColumn("admitted", (F.col("place") <= per_round) & (F.col("nth_round") <= rounds))


def missing_terms(answer: Column, terms: Column) -> Column:
    """The required terms that the answer lacks, caseless."""
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: ~F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(t)))


def whole_sum(counts: Column) -> Column:
    """Sum of an array of counts; null if it is empty or any is null."""
    return F.when((F.size(counts) > 0) & F.forall(counts, lambda x: x.isNotNull()), F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x))


def evaluated(reports: DataFrame) -> DataFrame:
    """reports(task_id, mode, completion, answer, terms, expected_paths, cited_paths, citations_valid, statuses, input_tokens, output_tokens) with mechanical checks."""
    missing = missing_terms(F.col("answer"), F.col("terms"))
    lost = F.array_sort(F.array_except(F.coalesce("expected_paths", F.array().cast("array<string>")), F.coalesce("cited_paths", F.array().cast("array<string>"))))
    out = reports.withColumn("missing_answer_terms", missing).withColumn("missing_cited_paths", lost)
    passed = (F.col("completion") == "answered") & (F.size("missing_answer_terms") == 0) & (F.size("missing_cited_paths") == 0) & F.col("citations_valid")
    return out.select(
        "task_id", "mode", "completion", "missing_answer_terms", "missing_cited_paths", "citations_valid", passed.alias("checks_passed"), F.lit(True).alias("review_required"),
        F.size("statuses").alias("tool_calls"), F.size(F.filter("statuses", lambda s: s == "error")).alias("tool_errors"), whole_sum(F.col("input_tokens")).alias("input_tokens"), whole_sum(F.col("output_tokens")).alias("output_tokens"),
    )


def check_tasks(tasks: DataFrame) -> None:
    """Non-blank unique ids, questions and rubrics; arrays of non-blank strings."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    odd = lambda c: F.coalesce(F.exists(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""), F.lit(False))
    bad = tasks.filter(blank("id") | blank("question") | odd("answer_contains") | odd("expected_evidence_paths")).select("id").limit(1).collect()
    if bad or tasks.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise BadInput("tasks need unique ids, questions and lists of text")


def comparison(tasks: DataFrame) -> DataFrame:
    """Every task in every mode, by task, then mode."""
    modes = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(m).alias("mode")) for i, m in enumerate(MODES))))
    return tasks.withColumn("_m", modes).select(*tasks.columns, F.col("_m.place").alias("mode_place"), F.col("_m.mode").alias("mode"))
