import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityhop.llm import near_dedup
from cityhop.llm.near_dedup import near_duplicates, trees_for
from cityhop.llm.words import batch_shingles, batch_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, width))
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = find(a), find(b)
            label[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def corpus(seed=3, groups=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([5, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 8, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = word()
            rows.append((n * 7 % 1009 - 20, " ".join(w)))
            n += 1
    return rows


def labels(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def test_words_and_shingles_are_those_of_the_pattern():
    texts = ["A b\tC", None, "", " \n ", "one", "éa ÉA x\x0by\x0cz", "two words", "a " * 3000 + "end"]
    hashes, bounds = batch_words(texts)
    assert [b - a for a, b in zip(bounds, bounds[1:])] == [len(words(t)) for t in texts]
    assert hashes[0] == batch_words(["a"])[0][0]
    values, ends = batch_shingles(texts, 3)
    assert [b - a for a, b in zip(ends, ends[1:])] == [len(shingle_set(t, 3)) for t in texts]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(make, width, percent):
    rows = corpus()
    got = near_duplicates(make(rows), width=width, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert labels(got) == brute(rows, width, percent)


def test_large_nodes_branch_and_large_components_go_in_blocks(make, monkeypatch):
    rows = corpus(seed=8, groups=9)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = near_duplicates(make(rows), width=3, percent=85, node_limit=4)
    assert labels(got) == brute(rows, 3, 85)


def test_nulls_empty_long_repeated_and_extra_columns(make):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (9, "same text here now"), (4, "same text here now"), (4, "same text here now"), (None, "same text here now"), (5, long), (6, long + " more"), (7, "one"), (8, "ONE")]
    docs = make(rows).withColumn("id", F.lit("x")).withColumn("rep", F.lit(0)).withColumn("label", F.lit(None).cast("string"))
    got = {r["doc_id"]: tuple(r)[1:] for r in near_duplicates(docs, width=3, percent=85).collect()}
    assert got == {None: (2, 4, False), 1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (2, 4, True), 9: (2, 4, False), 5: (59_998, 5, True), 6: (59_999, 5, False), 7: (1, 7, True), 8: (1, 7, False)}


def test_unlike_texts_of_one_id_link_what_each_is_like(make):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, "alone here now")]
    assert labels(near_duplicates(make(rows), width=3, percent=85)) == {1: 1, 2: 1, 3: 1, 4: 4} == brute(rows, 3, 85)


def test_null_ids_are_documents(make):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (7, a + " x"), (None, b), (None, b), (None, b + " y"), (None, c), (None, ""), (None, None)]
    got = sorted((tuple(r) for r in near_duplicates(make(rows), width=3, percent=85).collect()), key=repr)
    assert [r for r in got if r[0] == 7] == [(7, 59, 7, True)]
    assert [(r[1:]) for r in got if r[0] is None and r[1] == 58 and r[2] == 7] == [(58, 7, False)]
    lone = [r for r in got if r[0] is None and r[2] is None]
    assert len(lone) == 5 and sum(r[3] for r in lone if r[1] > 0) == 2 and all(r[3] for r in lone if r[1] == 0)


def test_words_with_equal_polynomials_are_unlike(make):
    """The two Thue-Morse words agree modulo 2**64 in any polynomial of their letters."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    hashes, _ = batch_words([f"{one} {two} {one.upper()} {'é' * 40}"])
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[2]
    assert labels(near_duplicates(make([(1, one), (2, two)]), width=3, percent=85)) == {1: 1, 2: 2}


def test_components_of_many_shingles_go_in_blocks(make, monkeypatch):
    rows = corpus(seed=9, groups=6)
    monkeypatch.setattr(near_dedup, "SHINGLES", 500)
    assert labels(near_duplicates(make(rows), width=3, percent=85)) == brute(rows, 3, 85)


def test_empty_table(make):
    assert near_duplicates(make([])).collect() == []


def test_trees_reach_the_recall():
    assert trees_for(0.999, 3, 1.45) < 12 < trees_for(1 - 1e-7, 3, 1.45)


def test_large_nodes_of_the_last_level_compare_all_pairs(make, monkeypatch):
    """One node holds everything: chains a-x-y-b, of which only neighbours are alike, meet there or nowhere."""

    def roots(trees, branching):
        def run(batches):
            from cityhop.llm.near_dedup import _minima, _sketch

            for pdf in batches:
                s = _sketch(_minima(pdf["minima"])).view("int64")
                yield pdf[["id", "n"]].assign(key=0, s0=s[:, 0], s1=s[:, 1], s2=s[:, 2], s3=s[:, 3])[["key", "id", "n", "s0", "s1", "s2", "s3"]]

        return run

    monkeypatch.setattr(near_dedup, "_roots", roots)
    chains = [[" ".join(f"c{c}w{i}" for i in range(at, at + 202)) for at in (0, 16, 32, 48, 64)] for c in range(12)]
    rows = [(c * 5 + k, t) for c, chain in enumerate(chains) for k, t in enumerate(chain)]
    random.Random(1).shuffle(rows)
    got = near_duplicates(make(rows), width=3, percent=85, node_limit=4, max_depth=1)
    assert labels(got) == {i: i // 5 * 5 for i, _ in rows} == brute(rows, 3, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_meet_on_the_third_level(percent):
    rng = np.random.default_rng(percent)
    pairs, trees = 20_000, trees_for(0.999, 3, 1.45, percent)
    one = rng.integers(0, 2**64, (pairs, near_dedup.K), dtype=np.uint64)
    other = np.where(rng.random(one.shape) < percent / 100, one, rng.integers(0, 2**64, one.shape, dtype=np.uint64))
    met = np.zeros(pairs, bool)
    seeds = near_dedup.mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for seed in seeds:
        pair, path = np.arange(pairs), np.full(pairs, seed)
        for _ in range(3):
            row, key = near_dedup._children(one[pair], path, 1.45)
            other_row, other_key = near_dedup._children(other[pair], path, 1.45)
            both = set(zip(other_row.tolist(), other_key.tolist()))
            shared = np.array([p in both for p in zip(row.tolist(), key.tolist())], bool)
            pair, path = pair[row[shared]], key[shared]
        met[pair] = True
    assert (~met).sum() <= 1.5e-3 * pairs
