"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cityhop.llm.scratch import heavy_join
from cityhop.llm.trie import BLOCK, numbered_turns, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    out = {}
    said = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", said(x[2] or "", x[3] or ""))):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def brute(rows, mixed=True):
    own = ordered(rows)
    paths = {}
    for c, turns in own.items():
        h = 0 if c is None or not mixed else zlib.crc32(str(c).encode()) % 9
        paths[c] = (own.get(c - c % 5, [])[:h] if h else []) + turns[h:]
    members, ends, children = {}, {}, {}
    for c in sorted(paths, key=lambda c: (c is None, c or 0)):
        digest, node = hashlib.sha256(), (0, "")
        members.setdefault(node, []).append((c, None, 0))
        for d, (role, text) in enumerate(paths[c], 1):
            digest.update(hashlib.sha256(repr((role, text)).encode()).digest())
            below = (d, digest.hexdigest())
            members.setdefault(below, []).append((c, node, len(text.encode())))
            children.setdefault(node, set()).add(below)
            node = below
        ends.setdefault(node, []).append("null" if c is None else str(c))
    leaves, saved = {}, {}
    for node in sorted(members, key=lambda n: -n[0]):
        under = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in under) or 1
        saved[node] = (len(members[node]) - 1) * members[node][0][2] + sum(saved[x] for x in under)
    return {
        (m[0][0], node[0], members[m[0][1]][0][0] if m[0][1] else None, len(m), len(children.get(node, ())), leaves[node], saved[node],
         hashlib.sha256(",".join(ends.get(node, [])).encode()).hexdigest())
        for node, m in members.items()
    }


def trie(spark, rows, mixed=True, height=4, partitions=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    conv = F.col("conv")
    source, head = (conv - conv % 5, F.crc32(conv.cast("string")) % 9) if mixed else (conv, F.lit(0))
    out = prefix_trie(rebuilt(numbered_turns(df), source, head), height=height)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bé", "", "ccc"]) if t else rng.choice(["hello", "hi"])))
    return rows


@pytest.mark.parametrize("height", [2, 4])
def test_rebuilt_conversations(spark, height):
    rows = conversations(1, [*range(0, 60), 71, 72, 73, 1_000_003, 40_000], 9)
    assert trie(spark, rows, height=height) == brute(rows)


def test_null_ids_turns_roles_and_texts_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (None, 1, "user", "x"), (3, None, "user", "b"), (3, None, "user", "a"), (3, 0, None, "a")]
    rows += [(4, 0, "us", "er"), (9, 0, "u", "ser"), (10, 0, "user", None), (11, 0, "user", ""), (11, 0, "user", "")]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, mixed=False) == brute(rows, mixed=False)


def test_a_conversation_with_most_of_all_turns(spark):
    """Its turns lie in many ranges and blocks, and its trie has several levels of bands."""
    rows = [(7, t, "user", f"t{t}") for t in range(2 * BLOCK + 50)] + [(8, t, "user", f"t{t}") for t in range(BLOCK + 3)]
    rows += [(9, 0, "user", "t0"), (9, 1, "user", "z")]
    assert trie(spark, rows, mixed=False) == brute(rows, mixed=False)


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"é{t}") for c in [*range(400), *range(100_000, 100_400)] for t in range(3)] + conversations(2, range(5_000, 5_050), 5)
    assert trie(spark, rows, mixed=False) == brute(rows, mixed=False)


def test_clashing_columns_and_empty_table(spark):
    extra = {c: F.lit(1) for c in ("conv", "pos", "range", "depth", "k0", "turn_hash", "n_bytes", "c")}
    df = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA).withColumns(extra)
    out = prefix_trie(rebuilt(numbered_turns(df), F.col("conv"), F.lit(0)))
    assert {tuple(r) for r in out.collect()} == brute([(1, 0, "user", "x")], mixed=False)
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(numbered_turns(none), F.col("conv"), F.lit(0))).collect() == []


def test_heavy_join_finds_light_heavy_and_missing_keys(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") < 3_000, 0).otherwise(F.col("id") % 1_700).alias("k"), F.lit("x").alias("heavy"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("top")).where("k % 7 != 3")
    got = {(r["id"], r["k"]): r["top"] for r in heavy_join(rows, table, ["k"], "w", ["id"]).collect()}
    tops = {r["k"]: r["top"] for r in table.collect()}
    assert len(got) == 5_000 and all(top == tops.get(k) for (_, k), top in got.items())
