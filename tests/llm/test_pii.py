import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cityhop.llm.pii import Feistel, iban_check, luhn_digit, pseudonymise, replace, restore

FEISTEL = Feistel(b"test key")
VALUES = {
    "email": ["jo.hn-12@mail3.example.com", "éa.7@x.org", "JO.HN-12@MAIL3.EXAMPLE.COM"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "4952935900253053"],
    "phone": ["+1 (974) 555-3436", "+4915112345678", "(212) 555-0199 22"],
    "ip": ["83.229.25.121"],
    "ssn": ["123-45-6789"],
    "date": ["1999-12-31", "12/31/1999", "31.12.1999"],
    "key": ["4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"],
    "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 257])
def test_feistel_permutes(n):
    assert sorted(FEISTEL("k", n, x) for x in range(n)) == list(range(n))
    assert all(FEISTEL("k", n, FEISTEL("k", n, x), True) == x for x in range(n))


@given(st.integers(2, 10**40), st.data())
def test_feistel_inverts_large_domains(n, data):
    x = data.draw(st.integers(0, n - 1))
    y = FEISTEL("k", n, x)
    assert 0 <= y < n and FEISTEL("k", n, y, True) == x


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_formats_are_kept_and_restored(kind, value):
    text = f"so {value}, and {value}!"
    new, spans = replace(text, FEISTEL)
    assert [k for k, *_ in spans] == [kind, kind] and value not in new
    a, b = (new[s:e] for _, s, e in spans)
    assert a == b and re.sub(r"[a-z0-9à-þ]+", "x", a.lower()) == re.sub(r"[a-z0-9à-þ]+", "x", value.lower())
    assert replace(new, FEISTEL, True)[0] == text
    assert replace(text, Feistel(b"other"))[0] != new


def test_check_digits_and_days_stay_valid():
    new = {k: [replace(v, FEISTEL)[0] for v in vs] for k, vs in VALUES.items()}
    cards = [re.sub(r"\D", "", c) for c in new["card"]]
    assert luhn_digit(cards[0][:-1]) == cards[0][-1] and cards[0] == cards[1]
    assert luhn_digit(cards[2][:-1]) != cards[2][-1]  # was not valid
    assert new["iban"][0].replace(" ", "") == new["iban"][1] and iban_check("DE", new["iban"][1][4:]) == new["iban"][1][2:4]
    days = [datetime.date.fromisoformat(new["date"][0]), datetime.datetime.strptime(new["date"][1], "%m/%d/%Y").date(), datetime.datetime.strptime(new["date"][2], "%d.%m.%Y").date()]
    assert len(set(days)) == 1
    assert new["email"][0].upper() == new["email"][2]


@pytest.mark.parametrize("text", ["300.1.1.1 and 1.2.3", "2023-02-30", "000-12-3456", "DE00370400440532013000x", "version 3.0, 2.0.1", "a@b", "chapter 12 of 40", ""])
def test_what_is_not_valid_is_left(text):
    assert replace(text, FEISTEL) == (text, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*sum(VALUES.values(), []), "word", "42", "é"]), max_size=6), st.sampled_from([" ", "\n", ", ", " | "]))
def test_texts_are_restored(parts, between):
    text = between.join(parts)
    assert replace(replace(text, FEISTEL)[0], FEISTEL, True)[0] == text


def test_table(make):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de " * 5000), (4, "call +1 (974) 555-3436"), (4, "call +1 (974) 555-3436"), (5, "+1 (974) 555-3436"), (None, "clean")]
    docs = make(rows).withColumn("_found", F.lit("old")).withColumn("replaced", F.lit(1))
    got = pseudonymise(docs, b"k")
    assert got.columns == [*docs.columns, "found"] and {r["_found"] for r in got.collect()} == {"old"}
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[None]["text"] == "clean" and len(out[3]["found"]) == 5000
    assert out[4]["text"] == "call " + out[5]["text"] and out[5]["found"][0]["kind"] == "phone"
    assert {(r["doc_id"], r["text"]) for r in restore(got, b"k").collect()} == set(rows)
    assert pseudonymise(make([]), b"k").collect() == []


@pytest.mark.parametrize("value", ["+33 6 12 34 56 78", "+49 30 1234567", "0171 2345678", "(030) 123456"])
def test_phones_of_other_countries(value):
    text = f"call {value}, or {value}"
    new, spans = replace(text, FEISTEL)
    assert [k for k, *_ in spans] == ["phone", "phone"] and value not in new
    assert [new[a:b] for _, a, b in spans] == [new[spans[0][1] : spans[0][2]]] * 2 and spans[0][2] - spans[0][1] == len(value)
    assert replace(new, FEISTEL, True)[0] == text


@pytest.mark.parametrize("key", range(30))
@pytest.mark.parametrize("value,rest", [("AT61 1904 3002 3457 3201", " A"), ("AT611904300234573201", " 2024"), ("+49 30 1234567", " 12345678"), ("DE89 3704 0044 0532 0130 00", "")])
def test_what_follows_a_value_does_not_hide_it(value, rest, key):
    feistel = Feistel(b"key %d" % key)
    new, spans = replace(value + rest, feistel)
    assert len(spans) == 1 and new == replace(value, feistel)[0] + rest and value not in new
    assert replace(new, feistel, True)[0] == value + rest


def test_a_failed_match_does_not_hide_the_next():
    text = "12 34 +49 30 1234567 and 300.1.2.3 83.229.25.121"
    new, spans = replace(text, FEISTEL)
    assert [k for k, *_ in spans] == ["phone", "ip"] and replace(new, FEISTEL, True)[0] == text


def test_values_read_as_a_later_kind_are_restored():
    for key in range(300):
        feistel = Feistel(b"key %d" % key)
        for text in ("000-12-3456 7890", "2023-02-30 12345678"):
            new, spans = replace(text, feistel)
            assert [k for k, *_ in spans] == ["card"] and replace(new, feistel, True)[0] == text


def test_a_column_named_found_stays(make):
    docs = make([(1, "mail a.b@c.org now")]).withColumn("found", F.lit("old"))
    out = pseudonymise(docs, b"k")
    r = out.first()
    assert out.columns == [*docs.columns, "_found"] and r["found"] == "old" and len(r["_found"]) == 1 and r["text"] != "mail a.b@c.org now"
