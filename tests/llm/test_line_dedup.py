import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityhop.llm import line_dedup
from cityhop.llm.line_dedup import dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER)))


def brute(rows, percent=80):
    """Every line against every earlier one."""
    lines = [(i, k, words(x)) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    out = {i: [] for i, _ in rows}
    for n, (i, k, s) in enumerate(lines):
        if s and any(o and 100 * len(s & o) >= percent * len(s | o) for _, _, o in lines[:n]):
            out[i].append(k)
    return out


def corpus(seed, documents=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 5))) for _ in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 5, 9, 30, 200]))] for _ in range(40)]
    rows = []
    for i in range(documents):
        lines = []
        for _ in range(rnd.randrange(1, 8)):
            w = list(rnd.choice(base)) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 12))]
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            lines.append(rnd.choice([" ", "  "]).join(w))
        rows.append((i * 31 % 977 - 10, "\n".join(lines)))
    return rows


def removed(df):
    return {r["doc_id"]: r["removed"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(make, seed):
    rows = corpus(seed)
    got = dedup_lines(make(rows))
    expected = brute(rows)
    assert removed(got) == expected
    for r in got.collect():
        lines = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in expected[r["doc_id"]]) and r["n_lines"] == len(lines)


def test_large_word_groups_and_many_candidates(make, monkeypatch):
    rnd = random.Random(5)
    common = [f"c{k}" for k in range(30)]
    rows = [(i, " ".join(w if rnd.random() > 0.12 else f"x{rnd.randrange(50)}" for w in common)) for i in range(90)]
    monkeypatch.setattr(line_dedup, "GROUP", 16)
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    assert removed(dedup_lines(make(rows))) == brute(rows)


def test_nulls_empty_long_repeated_and_extra_columns(make):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b\n\na b\nA  B"), (5, long), (6, long + " more\nown"), (7, "tie x"), (7, "tie y"), (8, "rep eat"), (8, "rep eat"), (None, "own")]
    docs = make(rows).withColumn("gone", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("removed_", F.lit(2))
    got = dedup_lines(docs).collect()
    of = {(r["doc_id"], (r["text"] or "")[:20]): (r["n_lines"], r["removed"]) for r in got}
    assert len(got) == len(rows) and dedup_lines(docs).columns == [*docs.columns, "n_lines", "removed"]
    assert of[1, ""] == (1, []) and of[2, ""] == (1, []) and of[3, "\n\n"] == (3, [])
    assert of[4, "a b\n"] == (4, [2, 3])
    assert of[5, long[:20]] == (1, []) and of[6, ""] == (2, [0, 1])
    assert of[7, "tie x"] == of[7, "tie y"] == (1, []) and of[8, "rep eat"] == (1, []) and of[None, "own"] == (1, [])


def test_empty_table(make):
    assert dedup_lines(make([])).collect() == []


def test_words_with_equal_polynomials_are_unlike(make):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    assert removed(dedup_lines(make([(1, one), (2, two), (3, two)]))) == {1: [], 2: [], 3: [0]}


def test_many_rows_without_an_id(make):
    rows = [(None, f"only line of text {i} and {i * i} of it\nshared line of all of them") for i in range(2_500)]
    got = dedup_lines(make(rows)).collect()
    assert len(got) == 2_500 and sum(r["removed"] == [] for r in got) == 1
    kept = {r["text"] for r in got}
    assert {t.split("\n")[0] for _, t in rows} == {t.split("\n")[0] for t in kept}


def test_columns_of_the_added_names_stay(make):
    docs = make([(1, "a b c\na b c"), (2, "d")]).withColumn("removed", F.lit("r")).withColumn("n_lines", F.lit(9)).withColumn("number", F.lit(0))
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_removed"]
    assert {(r["doc_id"], r["removed"], r["n_lines"], r["_n_lines"], tuple(r["_removed"])) for r in out.collect()} == {(1, "r", 9, 2, (1,)), (2, "r", 9, 1, ())}


def met(rows, nearest, limit=1 << 15):
    """Pairs of lines, and whether there are more, that ``_meet`` finds over rows of (word, n, place, b1, doc)."""
    rows = np.array(sorted(rows), np.int64)
    zero = np.zeros(len(rows), np.int64)
    columns = dict(word=rows[:, 0], size=rows[:, 1] << 32 | rows[:, 2], place=rows[:, 2], n=rows[:, 1], doc=rows[:, 4], uid=zero, b1=rows[:, 3], b2=zero)
    batches = pa.table(columns).to_batches(max_chunksize=1000)
    out = [b.to_pandas() for b in line_dedup._meet(80, nearest, limit)(iter(batches))]
    return [(d, t, o) for b in out for d, t, o in zip(b["doc"], b["to_doc"], b["open"])]


def test_a_group_of_like_lines_is_not_held_as_its_pairs():
    """3,000 lines of one word meet each other 4.5 million times; a task holds some of them."""
    n = 3_000
    tracemalloc.start()
    found = met([(7, 20, 0, 0, d) for d in range(n)], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert sorted(found) == [(d, t, d > 4) for d in range(n) for t in range(min(d, 4))]


@pytest.mark.parametrize("nearest", [1, 4, None])
def test_pairs_found_bit_by_bit(monkeypatch, nearest):
    rnd = random.Random(3)
    rows = [(w, n, rnd.randrange(1 + n // 4), rnd.randrange(4), d) for d in range(80) for n in [rnd.randrange(3, 30)] for w in rnd.sample(range(5), 2)]
    expected = {}
    for w, n, p, b, d in rows:
        for v, m, q, c, e in rows:
            need = -(-80 * (n + m) // 180)
            if v == w and e < d and 80 * max(n, m) <= 100 * min(n, m) and min(n - p, m - q) >= need and (b ^ c).bit_count() <= n + m - 2 * need:
                expected.setdefault(d, set()).add(((b ^ c).bit_count(), e))
    pairs = {(d, e, len(x) > (nearest or len(x))) for d, x in expected.items() for _, e in sorted(x)[:nearest]}
    for size in (1 << 19, 7):
        monkeypatch.setattr(line_dedup, "PAIRS", size)
        assert set(met(rows, nearest)) == pairs
