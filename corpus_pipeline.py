"""The training-data pipeline: documents in, token-id shards out.

Five stages, each over everything its predecessor kept: quality rules reject
documents, the n-gram Jaccard join keeps one document of each class, benchmark
decontamination removes contaminated documents, mixing repeats documents to
reach the sources' target weights (dropping none), and the last stage encodes
the mix, in the order of its permutation, into wavelet shards and reads them
back.

Every stage but the last returns the columns of its input as they were: it
works on renamed columns, so names that operators give to their own results
can't clash.  Defined cases: a document with null, empty or very few words is
rejected by the first stage; rows that repeat a doc_id and its text are one
document from the second stage on, rows that repeat a doc_id with another text
are documents of their own; of a class without any doc_id the exact copies
become one; a null source is a source of its own; an empty table stays empty
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph.llm import decontam, jaccard, mixing, quality, tokenids
from codegraph.llm.common import fresh_path, sweep, table
from codegraph.llm.queries import tokenizer_path

#: Not expressible in SQL (tokenizer); tests hold run() against a brute-force version.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 ..., and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of repetition keep."""
    rows, named = _apart(docs)
    return quality.repetition_quality(rows, text=named["text"]).filter("kept").select(rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest doc_id stays, once."""
    rows, named = _apart(docs)
    found = jaccard.classes(rows, text=named["text"], doc_id=named["doc_id"]).filter("doc_id <=> component_id")
    leads = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = rows.join(leads, rows[named["doc_id"]].eqNullSafe(leads["doc_id"]))
    single = kept.filter("n = 1").select(rows.columns)
    if leads.filter("n > 1").isEmpty():
        return single.toDF(*docs.columns)
    several = kept.filter("n > 1").withColumn("mark", F.xxhash64(named["text"])).dropDuplicates([named["doc_id"], "mark"])
    return single.unionAll(several.select(rows.columns)).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of two benchmark items or more go."""
    rows, named = _apart(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), text=named["text"])
    return found.filter(F.size("items") < 2).select(rows.columns).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, once for each pass of its source that takes it."""
    rows, named = _apart(docs)
    mixed = mixing.mix(rows, text=named["text"], doc_id=named["doc_id"], source=named["source"])
    return mixed.select(rows.columns).toDF(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from shards in the order of the mix: by pass, then by the key of the permutation."""
    ordered, order = mixing.in_order(docs)
    return tokenids.token_ids(ordered, tokenizer_path(), order=order)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, but=path)  # what the stage and its predecessor left
        docs = spark.read.parquet(path)
    return docs
