import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cityhop.llm.mixing import permuted, first_words, mix, mixed_documents, split_quotas


def water(sizes, weights, share=Fraction(3, 2), most=2):
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weights[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


ROWS = [(i, "w " * (i * 37 % 400), f"s{i % 5}") for i in range(300)] + [(1000 + i, "x y z", "hot") for i in range(300)]
ROWS += [(2000, None, None), (2001, "", None), (2002, "null source words here", None), (2003, "long " * 60_000, "s1"), (2004, "tie", "t"), (2004, "tie", "t"), (None, "no id", "t"), (2005, "é\x0bü", "Z")]


def test_targets_and_words_taken(make):
    docs = make(ROWS).withColumn("size", F.lit("q")).withColumn("target", F.lit(1)).withColumn("bucket", F.lit(2))
    got = mix(docs).join(docs.select("doc_id", "source", "text").distinct(), "doc_id").collect()
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = {}
    for r in got:
        assert r["size"] == words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(target[r["source"]]))
        mine = sum(c["words"] for c in r["copies"])
        assert mine <= 2 * r["size"] and all(0 <= c["shard"] < 16 and c["words"] <= r["size"] for c in r["copies"])
        taken[r["source"]] = taken.get(r["source"], 0) + mine
    for s in sizes:
        if s != "t":  # its repeated rows meet twice in the join above
            assert abs(taken[s] - target[s]) <= 0.5
    again = {(r["doc_id"], r["size"], str(r["copies"])) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"], str(r["copies"])) for r in mix(docs).collect()}


def test_tree_keeps_quotas_and_spreads_sources(spark):
    counts = [5000, 0, 1, 2500, 40]
    quotas = split_quotas(spark.createDataFrame(list(enumerate(counts, 1)), "place int, blocks long"), 3, 7).collect()
    of = {(r["shard"], r["place"]): r["quota"] for r in quotas}
    assert [sum(of[h, p] for h in range(8)) for p in range(1, 6)] == counts
    totals = [sum(of[h, p] for p in range(1, 6)) for h in range(8)]
    assert max(totals) - min(totals) <= 1 and min(of.values()) >= 0
    assert all(abs(of[h, 1] - 625) < 6 * (625 * (1 - 5000 / 7541)) ** 0.5 for h in range(8))


def test_first_words_keeps_the_writing(spark):
    row = spark.createDataFrame([("  a\tb\n\nc d ",)], "t string").select(*[first_words(F.col("t"), F.lit(n)) for n in (0, 1, 2, 4)]).first()
    assert tuple(row) == ("", "  a", "  a\tb", "  a\tb\n\nc d")


def test_mixed_documents_are_what_the_mix_takes(make):
    docs = make([r for r in ROWS if r[0] != 2004]).withColumn("shard", F.lit("own"))
    rows = mixed_documents(docs).collect()
    plan = {r["doc_id"]: sum(c["words"] for c in r["copies"]) for r in mix(docs).collect()}
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + words(r["text"])
    assert {k: v for k, v in plan.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixed_documents(docs).columns[: len(docs.columns)] == docs.columns and rows[0]["shard"] == "own"


def test_empty_tables(make):
    assert mix(make([])).collect() == [] and mixed_documents(make([])).collect() == []
    assert [tuple(r)[1:4] for r in mix(make([(1, "", "a")])).collect()] == [(0, 0, 0.0)]


@pytest.mark.parametrize("blocks", [1, 2, 3, 7, 1000, 166_667, 333_334])
def test_blocks_are_permuted_by_seed_and_source(spark, blocks):
    b, n = F.col("id"), F.lit(blocks).cast("long")
    places = spark.range(blocks).select("id", *[permuted(b, n, seed, F.lit(key)).alias(f"p{i}") for i, (seed, key) in enumerate([(1, "x"), (1, "x"), (2, "x"), (1, "y")])])
    p = places.toPandas().sort_values("id")
    for c in ("p0", "p2", "p3"):
        assert sorted(p[c]) == list(range(blocks))
    assert (p["p0"] == p["p1"]).all()
    if blocks >= 1000:
        for x, y in (("id", "p0"), ("p0", "p2"), ("p0", "p3")):
            assert (p[x] == p[y]).mean() < 0.02
        steps = p["p0"].diff().dropna() % blocks
        assert steps.value_counts(normalize=True).max() < 0.05  # no stride
