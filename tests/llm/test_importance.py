"""Importance resampling against a plain restatement of its rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cityhop.llm import importance as im

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, max_run):
    ws = PATTERN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return ws, [" ".join(ws[i : i + k]) for i in range(len(ws)) for k in range(1, max_run + 1) if i + k <= len(ws)]


def brute(docs, target, percent=10, min_words=20, max_run=1, buckets=10_000, seed="2024"):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(crc(f) for _, t in docs for f in _features(t, max_run)[1])
    t = Counter(crc(f) for x in target for f in _features(x, max_run)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        ws, fs = _features(text, max_run)
        weight = sum(gain(crc(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, len(ws)])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    taken = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], taken.get(id(r))) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [
    None,
    "",
    "...!?  --",
    "Ünter HÉ 12ab C3PO co-operate x\xa0y",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "the mix of the words " * 30,
    "quick brown fox " * 40 + "\x00 end",
    "日本 語 と " * 25,
]


@pytest.mark.parametrize("max_run,buckets", [(1, 10_000), (1, 7), (3, 500)])
def test_equals_brute_force(spark, make, max_run, buckets):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)]
    target = ["the mix of words", "brown fox jumps", None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = im.resample(make(docs), bench, percent=30, max_run=max_run, buckets=buckets)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(out) == brute(docs, target, 30, max_run=max_run, buckets=buckets)


def test_repeated_and_null_ids_and_clashing_columns(spark, make):
    docs = [(None, TEXTS[5]), (3, TEXTS[5]), (3, TEXTS[5]), (3, TEXTS[6]), (4, TEXTS[4]), (None, TEXTS[7])]
    df = make(docs).withColumns({c: F.lit(1) for c in ("id", "hit", "times", "n_words", "score", "rank", "weight")})
    bench = spark.createDataFrame([(1, "the mix", 5)], "item_id long, text string, id int")
    assert got(im.resample(df, bench, percent=60)) == brute(docs, ["the mix"], 60)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert im.resample(make([]), none).collect() == []
    docs = [(i, TEXTS[4 + i % 4]) for i in range(20)]
    assert got(im.resample(make(docs), none, percent=50)) == brute(docs, [], 50)


def test_offsets_cut_whole_words_of_long_texts():
    text = ("wörd" * 40_000 + " " + "ab cé " * 30_000 + "\x00").encode()
    found = list(im.words(text))
    assert [w for w, _ in found] == PATTERN.findall(text.decode())
    assert all(text[a:b].decode() == w for w, (a, b) in found)


def test_all_documents_of_one_score(spark):
    scored = spark.range(1000).select(F.col("id"), F.lit(30).alias("n_words"), F.lit(5).alias("n_features"), F.lit(0).alias("weight"), F.lit(7).cast("long").alias("score"))
    out = {r["id"]: r["rank"] for r in im.ranked(scored, F.lit(True), 10, "id").collect()}
    assert out == {i: i + 1 if i < 100 else None for i in range(1000)}
