import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cityhop.llm import packing
from cityhop.llm.packing import Encoder, class_lengths, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!abcstrevmld019éÉß²½–“中<|endoftext>"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_encoding_equals_the_tokenizers(texts):
    encode = Encoder.of(PATH)
    expected = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == expected


PLAIN = " ABYZabyzstrevmldÀéßÿ0189\n\r\t'\"!.,-¿¡–—‘’“”…€"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(PLAIN), max_size=40), min_size=1, max_size=5))
def test_pre_tokens_are_the_patterns(texts):
    letter = "A-Za-zÀ-ÖØ-öø-ÿ"
    pattern = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[0-9]+| ?[^\s{letter}0-9]+|\s+(?!\S)|\s+")
    data = "".join(t + "\0" for t in texts) + "\0\0"
    begins = packing.pre_tokens(np.frombuffer(data.encode("cp1252"), np.uint8)).tolist()
    expected = [p for t in texts for p in (*pattern.findall(t), "\0")] + ["\0", "\0"]
    assert [data[a:b] for a, b in zip(begins, [*begins[1:], len(data)])] == expected


def test_every_plain_character_in_every_place(tokenizer):
    """Each character that counts as plain, alone and beside each class, and each that does not."""
    around = ["{0}", "a{0}", "{0}a", " {0}", "{0} ", "1{0}1", "!{0}!", "'{0}", "{0}'s", "  {0}  a", "\n{0}\n"]
    texts = [a.format(chr(c)) for c in [*range(0x180), *range(0x2010, 0x2040), 0x20AC] for a in around]
    assert Encoder(PATH)(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Counted:
    """A tokenizer that counts the inputs and words that it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.inputs, self.words = tokenizer, 0, 0

    def encode_batch_fast(self, inputs, **options):
        self.inputs += len(inputs)
        self.words += sum(map(len, inputs))
        return self.tokenizer.encode_batch_fast(inputs, **options)


def test_the_tokenizer_gets_new_pieces_only_and_many_at_once(tokenizer):
    encode = Encoder(PATH)
    counted = encode.tokenizer = Counted(encode.tokenizer)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))] * 3
    expected = np.array(tokenizer.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(texts) == [expected] * 3
    assert counted.words == 600 and counted.inputs == 3
    assert encode(texts[:1] + [texts[0] + " new"])[0] == expected
    assert counted.words == 601 and counted.inputs == 4


def test_what_is_remembered_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "REMEMBERED_CHARS", 1000)
    encode = Encoder(PATH)
    texts = [" ".join(f"word{i * j}" for j in range(20)) + "x" * (i % 7 * 300) + ("中 文" if i % 3 else "") for i in range(40)]
    for t in texts:
        assert encode([t, "", t]) == [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in (t, "", t)]
        assert len(encode.known) <= 50 + 100 and len(encode.bound) == len(encode.known) + 1
    assert encode([]) == []


def test_class_lengths_are_reciprocals():
    fit = class_lengths(2048)
    assert fit[2048] == 2048 and fit[2047] == 1024 and fit[1023] == 682 and fit[5] == 5
    assert all(2048 % (2048 // n) <= n for n in range(1, 2049))


def check(rows, docs, tokenizer, **options):
    pieces = pack(docs, PATH, **options).collect()
    capacity = options.get("capacity", 2048)
    got = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert len(ids) == p["length"] > 0
        got.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append(ids_of(tokenizer, t))
    assert got.keys() == expected.keys()
    for i, texts in expected.items():
        if len(texts) == 1:
            assert [x for _, ids, _ in sorted(got[i]) for x in ids] == texts[0]
            assert {n for *_, n in got[i]} == {len(texts[0])}
        assert sum(len(ids) for _, ids, _ in got[i]) == sum(map(len, texts))
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return pieces, bins


def test_round_trip_and_little_padding(make, tokenizer):
    rows = [(i, " ".join(f"word{i * j}" for j in range(i * 13 % 300))) for i in range(120)]
    pieces, bins = check(rows, make(rows), tokenizer, capacity=256)
    total = sum(p["length"] for p in pieces)
    assert sum(256 - sum(n for _, n in b) for b in bins.values()) < 0.03 * total + 256


def test_nulls_empty_long_repeated_and_extra_columns(make, tokenizer):
    rows = [(1, None), (2, ""), (3, "x" * 3000 + " y" * 30_000), (4, "same"), (4, "same"), (5, "a  b\n\n\tc")]
    docs = make(rows).withColumn("ids", F.lit(1)).withColumn("start", F.lit("q")).withColumn("task", F.lit(0))
    pieces, _ = check(rows, docs, tokenizer)
    assert {p["doc_tokens"] for p in pieces if p["doc_id"] in (1, 2)} == {1}
    assert pack(make([(None, "x")]), PATH).first()["doc_id"] is None


def test_empty_table(make):
    assert pack(make([]), PATH).collect() == []
