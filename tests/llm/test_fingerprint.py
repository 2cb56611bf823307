import hashlib
import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cityhop.llm.fingerprint import delete, fingerprints, from_string, insert, likeness, to_string, vector, with_next

PARTS = st.lists(st.text(alphabet="abc é", max_size=20), min_size=1, max_size=6)


@settings(max_examples=100, deadline=None)
@given(PARTS, st.randoms(), st.text(alphabet="xyz ", max_size=20))
def test_order_insertion_and_deletion(parts, rnd, new):
    said = to_string(vector("\n".join(parts)))
    mixed = list(parts)
    rnd.shuffle(mixed)
    assert to_string(vector("\n".join(mixed))) == said
    more = insert(said, new)
    assert more == to_string(vector("\n".join([*mixed, new]))) != said
    assert delete(more, new) == said
    assert to_string(from_string(said)) == said


def test_likeness_falls_with_edits():
    text = "\n".join(f"paragraph number {i} speaks of {i * i}" for i in range(30))
    other = "\n".join(f"nothing {i + 900} like those lines {i}" for i in range(30))
    a, same, near, far = vector(text), vector(text), vector(text[:-200] + other[:200]), vector(other)
    assert likeness(a, same) == 1.0 > likeness(a, near) > 0.6 > 0.3 > likeness(a, far)
    assert likeness(vector(""), vector(None)) == 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for (i, _), t, n in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    return out


def test_edits_by_the_next_document(make):
    rows = [(i * 3, f"text {i} é\n" * (i % 7)) for i in range(40)] + [(500, None), (501, ""), (502, "x" * 200_000), (7, "tie b"), (7, "tie a"), (7, "tie a"), (None, "no id")]
    docs = make(rows, 6).withColumn("id", F.lit(1)).withColumn("block", F.lit(2)).withColumn("o", F.lit("x"))
    for blocks in (1, 2, 50):
        got = with_next(docs, blocks=blocks).collect()
        assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, expected(rows)))
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[500] == prints[501] == to_string(vector(""))
    assert prints == {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs).collect()} | {7: prints[7]}


def _grams(text):
    """Exact counts of what the lanes count: 8-byte grams of each paragraph, or a shorter paragraph itself."""
    out = Counter()
    for p in text.encode().split(b"\n"):
        if len(p) < 8:
            out[p] += 1
        else:
            out.update(p[i : i + 8] for i in range(len(p) - 7))
    return out


def _cosine(a, b):
    x, y = _grams(a), _grams(b)
    return sum(n * y[g] for g, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def test_likeness_is_the_cosine_of_exact_counts_also_in_long_repetitive_texts(make):
    texts = ["a" * 100_000, "a" * 40_000 + "b" * 9_000, "abc def " * 40_000, "z" * 65_536 + "\n" + "y" * 65_536, "the end of it is near\n" * 9_000, "word " * 70_000]
    texts += ["\n".join(f"line {i * k} of some text {i}" for i in range(400)) for k in (1, 1, 3)]
    rows = list(enumerate(texts))
    for r in with_next(make(rows)).collect():
        said, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        k = len(said) // 4
        assert abs(r["near_edited"] - _cosine(said, said[: len(said) - k] + after[:k])) < 0.1
        # texts of a handful of grams can meet in a lane by chance
        assert abs(r["near_next"] - _cosine(said, after)) < 0.3


def test_one_row_and_empty_table(make):
    r = with_next(make([(3, "abcdefgh")])).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert with_next(make([])).collect() == []
