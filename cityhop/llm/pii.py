"""Personal data replaced by format-preserving pseudonyms.

Finds card numbers (Luhn check; numbers of card length without a valid check digit too, kept apart), IBANs (modulo 97), social security numbers, telephone numbers, IPv4 addresses,
calendar dates, e-mail addresses and hexadecimal keys; what does not pass its kind's validation is tried up to an earlier group
(IBANs of a country's length, telephone numbers) and as the kinds after it, else left alone.  A value is read as an
integer of its format's domain and permuted there by a keyed Feistel network (two halves of about the domain's root, ten rounds of keyed
BLAKE2b, walking on until the result is in the domain again).  So a pseudonym has the value's format (separators, letter case, check digits,
real days), equal values of a kind get equal pseudonyms in all documents, unlike values unlike ones, and who has the key can go back
(``restore``).

Values are compared without separators and case, so differently written copies stay linked.  Null texts stay null and empty ones empty; nothing but
the text column changes; repeated rows change alike; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.llm.scratch import fresh

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_KINDS = (
    ("email", r"(?<![\w.%+-])[\w%+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("key", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    ("date", r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d-])"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!-?\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,5}\)?(?:[ .-]\d{2,8}){1,5}|\(\d{2,5}\)[ .-]?\d{2,8}(?:[ .-]\d{2,8}){0,3}|0[1-9]\d{1,3}[ /-]\d{5,8})(?![\w-])|(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?(?:[ .-]\d{2,4}){2,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)"),
)


def _any(kinds: dict[str, str]) -> re.Pattern:
    """All kinds at a digit, plus or bracket, and those that may start with a letter at the start of a word."""
    at_digit = "|".join(f"(?P<{name}>{pattern})" for name, pattern in kinds.items())
    at_word = "|".join(f"(?P<{name}_>{kinds[name]})" for name in ("email", "iban", "key") if name in kinds)
    return re.compile(rf"(?=[0-9+(])(?:{at_digit})|(?<!\w)(?=[^\W0-9]|[%+-])(?:{at_word})")


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: int(n)
    for n, cs in (
        pair.split(":")
        for pair in "15:NO 16:BE 18:DK,FI,NL,FO,GL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS 23:AE,GI,IL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT 26:IS,TR 27:FR,GR,IT,MC,SM 28:AL,AZ,CY,DO,GT,HU,LB,PL 29:BR,PS,QA 30:JO,KW,MU 31:MT".split()
    )
    for c in cs.split(",")
}
_ONE = {k: re.compile(v) for k, v in _KINDS}
_ANY = {True: _any(dict(_KINDS)), False: _any({k: v for k, v in _KINDS if k != "email"})}


class Feistel:
    """A keyed permutation of ``range(n)`` for any ``n``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()[:64]

    def _round(self, kind: str, n: int, k: int, half: int, modulus: int) -> int:
        said = f"{kind}|{n}|{k}|{half}".encode()
        size = min(64, max(16, (modulus.bit_length() + 7) // 8 + 16))
        digest = hashlib.blake2b(said, key=self.key, digest_size=size).digest()
        while len(digest) * 8 < modulus.bit_length() + 64:
            digest += hashlib.blake2b(digest, key=self.key).digest()
        return int.from_bytes(digest, "big") % modulus

    def __call__(self, kind: str, n: int, x: int, back: bool = False) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        sign, rounds = (-1, range(ROUNDS - 1, -1, -1)) if back else (1, range(ROUNDS))
        while True:
            left, right = divmod(x, b)
            for k in rounds:
                if k % 2 == 0:
                    left = (left + sign * self._round(kind, n, k, right, a)) % a
                else:
                    right = (right + sign * self._round(kind, n, k, left, b)) % b
            x = left * b + right
            if x < n:
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _permute(text: str, alphabet: Callable[[str], str], kind: str, walk: Callable[[str, int, int], int]) -> str:
    """Permute the characters that have an alphabet among all texts of the same shape."""
    sets = [alphabet(c) for c in text]
    n, x = 1, 0
    for c, s in zip(text, sets):
        if s:
            n, x = n * len(s), x * len(s) + s.index(c)
    y = walk(kind, n, x)
    out = []
    for c, s in zip(reversed(text), reversed(sets)):
        if s:
            y, r = divmod(y, len(s))
            out.append(s[r])
        else:
            out.append(c)
    return "".join(reversed(out))


_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def _digit(c: str) -> str:
    return _DIGITS if c in _DIGITS else ""


def _hex(c: str) -> str:
    return _HEX


def _alphanumeric(c: str) -> str:
    return next((s for s in (_DIGITS, _LETTERS, _ACCENTED) if c in s), "")


def _into(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    left = iter(digits)
    return "".join(next(left) if c in _DIGITS else c for c in shape)


def _only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _date(value: str, walk) -> str | None:
    try:
        if value[4] == "-":
            day = datetime.date.fromisoformat(value)
        elif "/" in value:
            m, d, y = map(int, value.split("/"))
            day = datetime.date(y, m, d)
        else:
            d, m, y = map(int, value.split("."))
            day = datetime.date(y, m, d)
    except ValueError:
        return None
    n = day.toordinal() - FIRST_DAY
    if not 0 <= n <= LAST_DAY - FIRST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + walk("date", LAST_DAY - FIRST_DAY + 1, n))
    if value[4] == "-":
        return new.isoformat()
    return f"{new.month:02d}/{new.day:02d}/{new.year}" if "/" in value else f"{new.day:02d}.{new.month:02d}.{new.year}"


def _ip(value: str, walk) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or ".".join(map(str, parts)) != value:
        return None
    x = walk("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(value: str, walk) -> str | None:
    d = _only_digits(value)
    if not _ssn_valid(d):
        return None
    x = int(d)
    while True:
        x = walk("ssn", 10**9, x)
        if _ssn_valid(f"{x:09d}"):
            return _into(value, f"{x:09d}")


def _card(value: str, walk) -> str | None:
    d = _only_digits(value)
    if luhn_digit(d[:-1]) == d[-1]:
        body = _permute(d[:-1], _digit, "card", walk)
        return _into(value, body + luhn_digit(body))
    # of the other numbers of this length, onto one that is not valid either
    while True:
        d = _permute(d, _digit, "number", walk)
        if luhn_digit(d[:-1]) != d[-1]:
            return _into(value, d)


def _phone(value: str, walk) -> str | None:
    d = _only_digits(value)
    lead = re.match(r"\+\d{1,3}(?=[ .-])", value)
    keep = len(lead[0]) - 1 if lead else 0
    national = re.fullmatch(r"0[1-9]\d{1,3}[ /-]\d{5,8}", value) is not None
    if not 8 <= len(d) <= 15 or not (value[0] == "+" or "(" in value or len(d) == 10 or national):
        return None
    if not national:
        return _into(value, d[:keep] + _permute(d[keep:], _digit, "phone", walk))
    # the leading zero stays the only one
    while True:
        d = "0" + _permute(d[1:], _digit, "phone", walk)
        if d[1] != "0":
            return _into(value, d)


def _iban_valid(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def _registered(value: str) -> str | None:
    """The valid IBAN of the country's length that ``value`` starts with, up to the end of a group."""
    for end in (m.start() for m in re.finditer(r" |$", value)):
        plain = value[:end].replace(" ", "")
        if len(plain) == IBAN_LENGTHS.get(plain[:2]):
            return value[:end] if _iban_valid(plain) else None
    return None


def _iban(value: str, walk) -> str | None:
    plain = value.replace(" ", "")
    if not _iban_valid(plain):
        return None
    own = _registered(value)
    if own is not None and own != value:
        return None  # its start is the number
    while True:
        account = _permute(plain[4:].lower(), _alphanumeric, "iban" + plain[:2], walk).upper()
        plain = plain[:2] + iban_check(plain[:2], account) + account
        new = iter(plain)
        out = "".join(c if c == " " else next(new) for c in value)
        if _registered(out) in (None, out):
            return out


def _email(value: str, walk) -> str | None:
    local, domain = value.rsplit("@", 1)
    low = local.lower()
    new = _permute(low, _alphanumeric, "email", walk)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new)) + "@" + domain if len(low) == len(local) else None


def _key(value: str, walk) -> str | None:
    new = _permute(value.lower(), _hex, "key", walk)
    return new if value == value.lower() else new.upper()


_REPLACE = {"email": _email, "iban": _iban, "key": _key, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _readings(kind: str, value: str | None, text: str, start: int) -> Iterator[tuple[str, str]]:
    """A match, its shorter forms that end with a group, and the same of the kinds after it at this place."""
    later = list(_REPLACE)[list(_REPLACE).index(kind) + 1 :]
    for k, v in [(kind, value), *((k, None) for k in later)]:
        if v is None:
            m = _ONE[k].match(text, start)
            if m is None:
                continue
            v = m[0]
        yield k, v
        if k == "iban" and (own := _registered(v)) is not None:
            yield k, own
        if k == "phone":
            for end in reversed([m.start() for m in re.finditer(r"(?<=\d)[ .-]", v)]):
                yield k, v[:end]


def _reads_before(first: str, kind: str, text: str) -> bool:
    """Whether the start of ``text`` is valid as a kind from ``first`` on and before ``kind``."""
    m = _ONE[first].match(text)
    for k, v in _readings(first, m[0] if m else None, text, 0):
        if k == kind:
            return False
        if _REPLACE[k](v, lambda kind, n, x: x) is not None:
            return True
    return False


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in it."""
    out, spans, at, length = [], [], 0, 0

    def walk(kind: str, n: int, x: int) -> int:
        return feistel(kind, n, x, back)

    pattern, start = _ANY["@" in text], 0
    while (m := pattern.search(text, start)) is not None:
        first = m.lastgroup.rstrip("_")
        for kind, value in _readings(first, m[0], text, m.start()):
            new = _REPLACE[kind](value, walk)
            # on until it reads as the same kind again, or it could not be restored
            while new is not None and kind != first and _reads_before(first, kind, new + text[m.start() + len(value) :][:64]):
                new = _REPLACE[kind](new, walk)
            if new is not None:
                out += [text[at : m.start()], new]
                length += m.start() - at
                spans.append((kind, length, length + len(new)))
                length += len(new)
                at = start = m.start() + len(value)
                break
        else:
            # what follows the first group may still be something
            start = m.start() + max(1, re.match(r"\w*", m[0]).end())
    out.append(text[at:])
    return "".join(out), spans


def pseudonymise(documents: DataFrame, key: bytes, text_col: str = "text", found_col: str = "found", back: bool = False) -> DataFrame:
    """The documents with pseudonyms in their texts, and ``found_col``: kind, start and end (code points of the new text) of each.

    A column of that name that the documents have stays; the spans' name then gets underscores in front.
    """
    both, found = fresh(documents.columns, "replaced", found_col)

    @F.pandas_udf("text string, found array<struct<kind:string,start:int,end:int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        feistel = Feistel(key)
        for texts in parts:
            rows = [(None, []) if t is None else replace(t, feistel, back) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in rows], "found": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in rows]})

    done = documents.withColumn(both, run(F.col(text_col)))
    columns = [F.col(f"{both}.text").alias(c) if c == text_col else F.col(c) for c in documents.columns]
    return done.select(*columns, F.col(f"{both}.found").alias(found))


def restore(documents: DataFrame, key: bytes, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """What ``pseudonymise`` replaced, put back, with the spans in ``found_col`` anew (dates are written with two digits a day and month)."""
    return pseudonymise(documents.drop(found_col), key, text_col, found_col, back=True)
