"""The pipeline against brute force on a small corpus, stage by stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOC, coder, edited, prose  # noqa: F401

import corpus_pipeline
from kindred.llm import op7_jaccard


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng = random.Random(1)
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    item = prose(5000, 40)
    good = [prose(i, 150) for i in range(60)]
    texts = [*good, *good[:5], *[edited(good[i], rng, 2) for i in range(5, 10)], *[" ".join(w.upper() + "!!" for w in prose(i, 80).split()) for i in range(200, 240)]]
    texts += [prose(7000, 100) + " " + item + " " + prose(7001, 100), prose(7002, 120) + " password=hunter2hunter2 " + prose(7003, 50), None, ""]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 70 <= i < 110), 0) for i in range(111)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages(spark, corpus, coder):  # noqa: F811
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit(1)).withColumn("overlaps", F.lit("x"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), f"test-{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == columns
    assert not set(range(70, 110)) & set(kept["quality"]) and set(range(60)) <= set(kept["quality"])
    sets = {i: set(op7_jaccard.shingle_set(texts[i], 5).tolist()) for i in kept["quality"]}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert set(kept["near_duplicates"]) == set(sets) - {b for _, b in links}  # groups here are pairs
    assert len(links) >= 9
    assert set(kept["near_duplicates"]) - set(kept["decontaminate"]) == {110}
    assert set(kept["secrets"]) == set(kept["decontaminate"])
    masked = kept["secrets"][111]["text"]
    assert "[secret]" in masked and "hunter2" not in masked and kept["secrets"][111]["n_chars"] == len(masked)
    assert {i: r["text"] for i, r in kept["secrets"].items() if i != 111} == {i: texts[i] for i in kept["secrets"] if i != 111}
    for i, r in kept["encode"].items():
        ids = coder.encode(kept["secrets"][i]["text"] or "")
        assert np.array(r["ids"], "<u4").tobytes() == ids and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()


def test_run_and_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 40
    empty = f"file://{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
