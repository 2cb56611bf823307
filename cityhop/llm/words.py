"""Word and shingle hashing of whole texts, vectorised over the bytes of a batch.

Words are the runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return; ``A-Z`` count as ``a-z``.  The separators are all
ASCII, so cutting UTF-8 bytes cuts the text at the same places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEGMENT = 1 << 20
#: Longest word (bytes) that the vectorised polynomial hashes: modulo 2**64 it has known collisions between words of a
#: thousand letters, whatever its base.  Longer words go through XXH3 one by one.
SHORT = 32

_rng = np.random.default_rng(20_240_501)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors)
    return have


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of each word in ``data``.

    Long buffers are hashed in segments cut at separators, so that the power
    tables stay small.  Words of over ``SHORT`` bytes are hashed one by one.
    """
    raw = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    turn = np.diff(solid)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + SEGMENT, side="right")))
        stop = ends[last - 1]
        n = int(stop - at)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw[at:stop]] * _power(_BASE, n)[:n], out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mix((sums[e] - sums[s]) * _power(_INVERSE, n)[s] + (e - s).astype(np.uint64))
        first = last
    for k in np.flatnonzero(ends - starts > SHORT):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].lower(), seed=1)
    return starts, out


def batch_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the bounds of each text's words in them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=bounds[1:])
    starts, hashes = word_hashes(b" ".join(raw))
    return hashes, np.searchsorted(starts, bounds)


def batch_shingles(texts: Iterable[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words, all texts
    in one array, and the bounds of each text in it.  A text of fewer words has
    one hash, of the whole sequence; a text without words has none."""
    words, bounds = batch_words(texts)
    lengths = np.diff(bounds)
    n = len(words)
    runs = words * _STEP[0]
    for k in range(1, width):
        runs[: n - k] += words[k:] * _STEP[k]
    runs = mix(runs + np.uint64(width))
    for i in np.flatnonzero((lengths > 0) & (lengths < width)):
        a, b = bounds[i], bounds[i + 1]
        runs[a] = mix(np.array([(words[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], np.uint64))[0]
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    runs = runs[np.arange(n) - bounds[doc] < counts[doc]]
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    for a, b in zip(ends[:-1], ends[1:]):
        runs[a:b].sort()
    first = np.ones(len(runs), bool)
    first[1:] = runs[1:] != runs[:-1]
    first[ends[:-1][counts > 0]] = True
    kept = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(first, out=kept[1:])
    return runs[first], kept[ends]


def chunks(texts: list, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of ``texts`` of about ``limit`` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
