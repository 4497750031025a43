"""The pipeline against a brute-force version on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
from codegraph.llm import mixing, quality
from codegraph.llm.common import shared_dir


def test_pipeline(spark, tmp_path):
    shared_dir(spark)
    r = random.Random(4)
    make = lambda n: " ".join(f"w{r.randint(0, 400)}" for _ in range(n))
    items = [(i, make(12)) for i in range(6)]
    clean = [make(60) for _ in range(12)]
    texts = clean + [clean[0], clean[1] + " tail", "too short", "spam " * 40, make(20) + " " + items[0][1] + " " + items[1][1] + " " + make(20), items[2][1] + " " + make(40), None]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "token_output"]
    docs, kept = spark.read.parquet(folder + "/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        kept.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    whole = set(range(len(texts)))
    assert kept[0] == whole - {14, 15, 18}  # short, repeated, null
    assert kept[1] == kept[0] - {12, 13}  # an exact and a near copy
    assert kept[2] == kept[1] - {16}  # two items; one item alone stays
    assert kept[3] == kept[2]  # mixing drops nothing
    out = corpus_pipeline.run(spark, folder).collect()
    assert {x["doc_id"] for x in out} == kept[3] and len(out) == docs.count()
    assert mixing.MAX_EPOCHS == 2.0 and quality.BASE_MIN_WORDS == 20
