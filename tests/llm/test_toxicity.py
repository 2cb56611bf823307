import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cityhop.llm.toxicity import ANCHORED, LabelModel, Model, _letters, clean_documents, fit, held_out, label_model, logistic, score, vote_patterns


def corpus(n=900, seed=4):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 80))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(1 + len(words) // 12):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum"]) if i % 2 else "zork" + rnd.choice(plain))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark, make):
    docs, labels = corpus()
    out_of_fit = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    table = make(docs)
    assert {r["doc_id"] for r in table.where(held_out(F.col("doc_id"))).collect()} == out_of_fit
    model = fit(table, spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r for r in score(table, model).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    truth = {i: t for i, _, t in labels}
    wrong = sum(got[i]["predicted"] != truth[i] for i in out_of_fit)
    assert wrong <= 0.03 * len(out_of_fit)
    swapped = [(i, q, 1 - t if i in out_of_fit else t) for i, q, t in labels]
    again = fit(table, spark.createDataFrame(swapped, LABELS))
    assert {r["doc_id"]: r["score"] for r in score(table, again).collect()} == {i: r["score"] for i, r in got.items()}
    kept = {r["doc_id"] for r in clean_documents(table, model).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def tallied(spark, votes):
    rows = Counter(_letters(v) for v in votes.tolist())
    return spark.createDataFrame(list(rows.items()), "pattern string, n long").repartition(3)


def test_label_model_finds_accuracies_and_correlations(spark):
    rnd = np.random.default_rng(1)
    y = rnd.random(4000) < 0.3
    vote = lambda right: np.where(rnd.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    good, poor, twin = vote(0.9), vote(0.65), vote(0.7)
    votes = np.stack([good, poor, twin, twin, twin, vote(0.995)], axis=1)
    model = label_model(tallied(spark, votes), 6, 0.3)
    post, table, correlation = model.posterior(votes), model.table, model.correlation
    assert abs(table[1, 0, 2] - 0.9) < 0.03 and abs(table[0, 1, 0] - 0.65) < 0.04
    assert correlation[2, 3] > 0.95 > 0.2 > abs(correlation[0, 1])
    assert ((post > 0.5) == y).mean() > 0.98


def test_label_model_learns_from_rows_without_annotation(spark):
    rnd = np.random.default_rng(2)
    y = rnd.random(6000) < 0.3
    vote = lambda right: np.where(rnd.random(6000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    annotated = rnd.random(6000) < 0.01
    votes = np.stack([vote(0.9), vote(0.8), vote(0.7), np.where(annotated, np.where(y, 1, -1), 0)], axis=1)
    model = label_model(tallied(spark, votes), 4, 0.3)
    for v, right in enumerate((0.9, 0.8, 0.7)):
        assert abs(model.table[1, v, 2] - right) < 0.05 and abs(model.table[0, v, 0] - right) < 0.05
    # one more round by plain loops over the rows leaves the estimates where they are
    post = LabelModel(0.3, model.table, model.effect, model.correlation).posterior(votes)
    for v in range(3):
        for k in (-1, 0, 1):
            hit = votes[:, v] == k
            assert abs((post[hit].sum() + 0.5) / (post.sum() + 1.5) - model.table[1, v, k + 1]) < 1e-3
    assert model.table[1, 3, 2] == ANCHORED
    again = label_model(tallied(spark, votes).repartition(1), 4, 0.3)
    assert (again.table == model.table).all() and (again.correlation == model.correlation).all()


def test_every_document_votes(spark, make):
    docs = [(1, "you are an idiot"), (2, "fine words"), (2, "fine words"), (None, "fine words"), (None, None), (3, "d**n it is a##e")]
    known = spark.createDataFrame([(1, 1), (2, 0)], "id long, toxic int")
    table = make(docs).selectExpr("doc_id as id", "text")
    model = Model()
    got = {r["pattern"]: r["n"] for r in vote_patterns(table, known, model).collect()}
    says = {1: "c", 2: "a"}
    want = Counter(_letters(model.votes(*model.read(text))) + says.get(i, "b") for i, text in docs)
    assert got == want and sum(got.values()) == len(docs)


def test_without_the_annotation_voter(spark, make):
    docs, labels = corpus()
    table, known = make(docs), spark.createDataFrame(labels, LABELS)
    truth = {i: t for i, _, t in labels}
    got = {r["doc_id"]: r["predicted"] for r in score(table, fit(table, known, annotations_vote=False)).collect()}
    assert sum(got[i] != truth[i] for i in got) <= 0.1 * len(got)


def test_logistic_separates():
    rows = [(np.array([k % 2]), np.array([1.0])) for k in range(200)]
    w, b = logistic(rows, np.array([float(k % 2) for k in range(200)]), 2)
    assert w[1] + b > 1.5 and w[0] + b < -1.5


def test_nulls_empty_long_repeated_and_extra_columns(spark, make):
    docs, labels = corpus(200)
    docs += [(1000, None), (1001, ""), (1002, "word " * 60_000), (1003, "you are an idiot, you scum"), (1003, "you are an idiot, you scum"), (None, "null id")]
    labels += [(1000, 1, 0), (1001, None, None), (1003, 1, 1), (1003, 1, 0), (None, 1, 1), (1002, 0, 0)]
    table = make(docs).withColumn("id", F.lit("x")).withColumn("toxic", F.lit(1)).withColumn("score", F.lit(9.0))
    got = score(table, fit(table, spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == len(docs)
    of = {r["doc_id"]: r["score"] for r in got}
    assert of[1000] == of[1001] < 0.5 and of[1002] < 0.7 <= of[1003] and None in of


def test_empty_tables(spark, make):
    nobody = spark.createDataFrame([], LABELS)
    assert score(make([]), fit(make([]), nobody)).collect() == []
    got = {r["doc_id"]: r["predicted"] for r in score(make([(1, "fine words here"), (2, "idiot idiot moron scum trash")]), fit(make([(1, "fine")]), nobody)).collect()}
    assert got == {1: 0, 2: 1}
    assert Model().counts(Counter(["idiot", "fine"])) == {-1: 1}
