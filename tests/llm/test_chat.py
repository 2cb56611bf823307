import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cityhop.llm.chat import CLOSE, escape, expand, head, read_back, read_turns, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = st.text(alphabet=st.sampled_from("\\#</turn>: \nab"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_template_round_trip(turns):
    assert read_turns("".join(f"{head(r)}{escape(t)}{CLOSE}\n" for r, t in turns)) == turns
    assert all(unescape(escape(t)) == t for _, t in turns)


def test_foreign_text_is_refused():
    with pytest.raises(ValueError):
        read_turns("### user: x</turn>\nrest")


def test_each_reply_is_an_example_with_its_context(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b ###"), (1, 3, "user", "d"), (2, 0, "system", "s")]
    got = expand(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"]) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert read_turns(got[0]["text"]) == [("user", "a"), ("assistant", "b ###")]
    assert [r["text"][r["loss_start"] : r["loss_end"]] if r["loss_start"] is not None else None for r in got] == [r"b \###", "c", None, None]
    assert read_turns(got[2]["text"])[-1] == ("user", "d")


def expected(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_read_back_digests(spark):
    long = "\\### " * 40_000
    rows = [(7, 0, "user", None), (7, 1, "assistant", long), (7, 1, "assistant", long), (7, None, None, "é"), (None, 0, "assistant", "x"), (-3, 0, "user", ""), (4, 1, "assistant", "</turn>"), (4, 0, "as:sistant", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(9)).withColumn("loss_start", F.lit("z")).repartition(5)
    got = {r["conv_id"]: r for r in read_back(expand(docs)).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        replies = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(replies))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(replies.encode()).hexdigest()


def test_empty_table(spark):
    assert read_back(expand(spark.createDataFrame([], SCHEMA))).collect() == []
