"""The pipeline's stages against brute force on a small corpus."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cityhop.llm.scratch import written
from test_line_dedup import brute as lines_removed
from test_near_dedup import brute as components
from test_toxicity import LABELS, corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("corpus"))


@pytest.fixture
def tables(spark, make, folder):
    docs, labels = corpus(400)
    clean = [t for (_, t), (_, _, toxic) in zip(docs, labels) if not toxic and words(t) > 40]
    docs = [(i, t, f"s{i % 4}") for i, t in docs]
    docs += [(2000 + k, f"{t} changed here", "s1") for k, t in enumerate(clean[:20])]  # near copies
    docs += [(2100 + k, f"a passage that many share\n{t}\nown words {k}", "s2") for k, t in enumerate(clean[20:40])]
    docs += [(2200, None, "s0"), (2201, "", None), (2202, "same", "s3"), (2203, "same", "s3")]
    make(docs).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, tables, folder):
    (_, toxicity), (_, line_dedup), (_, near_dedup), (_, mixing), (_, packing) = corpus_pipeline.STAGES
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}

    one = written(toxicity(spark, tables, folder))
    assert one.columns == COLUMNS
    kept = dict(rows(one))
    gone = {i for i, _ in rows(tables)} - kept.keys()
    assert sum(truth.get(i, 0) != (i in gone) for i, _ in rows(tables)) <= 0.03 * tables.count()

    two = written(line_dedup(spark, one, folder))
    assert two.columns == COLUMNS
    removed = lines_removed(list(kept.items()))
    expected = {}
    for i, t in kept.items():
        left = t if not removed[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[i])
        if not removed[i] or words(left):
            expected[i] = left
    assert dict(rows(two)) == expected
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in two.collect())

    three = written(near_dedup(spark, two, folder))
    label = components(list(expected.items()), 5, 80)
    assert dict(rows(three)) == {i: t for i, t in expected.items() if label[i] == i}

    four = written(mixing(spark, three, folder))
    assert four.columns == COLUMNS
    sizes, taken = {}, {}
    for r in three.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    originals = dict(rows(three))
    copies = {}
    for r in four.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        assert r["text"] is None or originals[r["doc_id"]].startswith(r["text"])
    assert max(copies.values()) <= 2 and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)

    five = packing(spark, four, folder).collect()
    total = four.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"] for r in five} == {r["doc_id"] for r in total}
    assert all(len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 2048 for r in five)
    for _, pieces in itertools.groupby(sorted(five, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]


def test_run_is_the_stages(spark, tables, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:2] == ["doc_id", "start"] and got.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, make, tmp_path):
    make([], 1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
