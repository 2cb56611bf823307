"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: class ``j`` holds pieces of
``capacity // j`` tokens and puts exactly ``j`` of them into a bin.  A document (its ids and
an end id) is cut into the longest class length that it still fills, again and again, so each of
its pieces has the exact length of its class and a bin misses at most ``capacity mod length``
tokens.  Every task fills the bins of every class on its own, without talking to others.

A task ends with less than one open bin per class.  Those open bins, whose size does not depend on
the data, are laid end to end over all tasks (a prefix sum over one row a task) and cut at the
capacity, so at most one sequence of the whole result is short.

Texts are tokenised once: pieces with their ids are written to the shared folder.  A byte-level BPE encodes
each of its pre-tokens by itself, so texts are cut between them (texts with unusual characters only before a single space between
two other characters, where it always breaks) and the ids of short cuts are remembered.

Null and empty texts are a document of the end id alone; ids may be null or repeat (each row
is a document); extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityhop.llm.scratch import written
from cityhop.llm.words import chunks

#: Pieces whose ids a worker remembers at once, and their characters.
REMEMBERED, REMEMBERED_CHARS = 700_000, 1 << 24
#: Pieces that the tokenizer gets as the words of one input, and inputs at once.
WORDS, INPUTS = 256, 16
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters alone, all of them in Windows-1252, are cut as the pre-tokeniser's published pattern does.
_PLAIN = re.compile(rf"[ -~\t\n\r{_LETTER}¿¡–—‘’“”…€]*")
_BREAK = re.compile(r"(?<=\S)(?= \S)")
_END, _LETTERS, _DIGITS, _SPACES, _OTHERS = range(5)
#: For each byte of Windows-1252 its class in the pattern (zero ends a text) and its length in UTF-8.
_CHARS = [bytes([b]).decode("cp1252", "replace") for b in range(256)]
_CLASS = np.array([_END if b == 0 else _LETTERS if c.isalpha() else _DIGITS if c.isdigit() else _SPACES if c.isspace() else _OTHERS for b, c in enumerate(_CHARS)], np.uint8)
_WIDTH = np.array([len(c.encode()) for c in _CHARS], np.int32)
_SUFFIXES = {1: [ord(a) for a in "stmd"], 2: [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]}


def pre_tokens(raw: np.ndarray) -> np.ndarray:
    """Where pieces begin in plain texts in Windows-1252, each ended by a zero, two more at the end (a zero is a piece).

    The published pattern: ``'(?:s|t|re|ve|m|ll|d)| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+`` for letters L, digits N, spaces s, others S.
    """
    kind = _CLASS[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    # the last of some spaces before other characters leaves its piece; a blank goes to theirs
    space = kind == _SPACES
    last = space[:-1] & ~space[1:] & (kind[1:] != _END)
    begins[:-1] |= last
    begins[1:] &= ~(last & (raw[:-1] == ord(" ")))
    quotes = np.flatnonzero(begins & (raw == ord("'")))
    one, two = raw[quotes + 1].astype(int), raw[quotes + 2].astype(int)
    for n, follows in ((1, one), (2, one << 8 | two)):
        found = quotes[np.isin(follows, _SUFFIXES[n])]
        begins[found + 1] = False
        begins[found + 1 + n] = True
    return np.flatnonzero(begins)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character stands for a byte
            self.n_bytes[i] = len(token)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        """Pieces get numbers; piece ``n`` has ``ids[bound[n]:bound[n + 1]]``.  Number 0, without ids, ends a text."""
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[""] = 0
        self.ids, self.bound, self.chars = np.empty(0, "<u4"), np.zeros(2, np.int64), 0

    def _numbers(self, texts: list[str], plain: bool) -> np.ndarray:
        """Numbers of all pieces, new ones too, of texts one after another."""
        if not plain:
            pieces = [p for t in texts for p in (*_BREAK.split(t), "")]
            return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        data = "".join([t + "\0" for t in texts]) + "\0\0"
        raw = np.frombuffer(data.encode("cp1252"), np.uint8)
        at = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_WIDTH[raw], out=at[1:])
        bounds = at[np.append(pre_tokens(raw), len(raw))]
        found = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data.encode())).dictionary_encode()
        index, words = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False)
        words[index[-1]] = ""
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[index[:-2]]

    def _learn(self) -> None:
        """Ids of the pieces numbered since the last time."""
        n = len(self.known) + 1 - len(self.bound)
        new = list(itertools.islice(reversed(self.known), n))[::-1]
        self.chars += sum(map(len, new))
        ids, bounds = [self.ids], [self.bound]
        for at in range(0, n, WORDS * INPUTS):
            part = new[at : at + WORDS * INPUTS]
            inputs = [part[k : k + WORDS] for k in range(0, len(part), WORDS)]
            encoded = self.tokenizer.encode_batch_fast(inputs, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.concatenate([np.array(e.ids, "<u4") for e in encoded]))
            # a piece has the tokens that end at its last byte or before
            token_ends, ends = np.cumsum(self.n_bytes[ids[-1]]), np.cumsum([len(p.encode()) for p in part])
            last = np.searchsorted(token_ends, ends)
            if token_ends[-1] != ends[-1] or (token_ends[last] != ends).any():
                raise ValueError("the tokens do not spell the text")
            bounds.append(bounds[-1][-1] + last + 1)
        self.ids, self.bound = np.concatenate(ids), np.concatenate(bounds)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        plain = [_PLAIN.fullmatch(t) is not None for t in texts]
        numbers = np.concatenate([self._numbers(list(itertools.compress(texts, [p == kind for p in plain])), kind) for kind in (True, False)])
        self._learn()
        begin = self.bound[numbers]
        n = self.bound[numbers + 1] - begin
        stop = np.cumsum(n)
        data = self.ids[np.repeat(begin - (stop - n), n) + np.arange(n.sum())].tobytes()
        stops = 4 * stop[numbers == 0]
        encoded = [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        each = {True: iter(encoded), False: iter(encoded[sum(plain) :])}
        return [next(each[p]) for p in plain]


def class_lengths(capacity: int) -> np.ndarray:
    """For each length up to the capacity, the longest class length within it."""
    lengths = np.unique(capacity // np.arange(1, capacity + 1))
    return lengths[np.searchsorted(lengths, np.arange(capacity + 1), side="right") - 1]


def _fill(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder.of(path)
        fit = class_lengths(capacity)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        number = (task + 1) << 32
        open_bins: dict[int, list] = {}
        out, size = [], 0
        columns = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "task", "at"]

        def table(rows: list) -> pd.DataFrame:
            pdf = pd.DataFrame(rows, columns=columns)
            pdf["sequence_id"] = pdf["sequence_id"].astype("Int64")
            return pdf

        for pdf in batches:
            texts = pdf["text"].tolist()
            encoded = itertools.chain.from_iterable(encode([t or "" for t in texts[a:b]]) for a, b in chunks(texts, 1 << 21))
            for key, ids in zip(pdf["id"], encoded):
                ids += end
                total = len(ids) // 4
                start = 0
                while start < total:
                    length = int(fit[min(capacity, total - start)])
                    row = [key, start, length, ids[4 * start : 4 * (start + length)], total, None, 0, task, 0]
                    size += 4 * length
                    start += length
                    held = open_bins.setdefault(length, [])
                    row[6] = length * len(held)
                    held.append(row)
                    if len(held) == capacity // length:
                        for r in held:
                            r[5] = number
                        number += 1
                        out += held
                        open_bins[length] = []
                if size > 1 << 23:
                    yield table(out)
                    out, size = [], 0
        at = 0
        for length in sorted(open_bins, reverse=True):
            for row in open_bins[length]:
                row[6], row[8] = 0, at
                at += length
                out.append(row)
        if out:
            yield table(out)

    return run


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The pieces of a sequence lie end to end from offset 0.
    """
    kind = documents.schema[id_col].dataType
    docs = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    pieces = written(
        docs.mapInPandas(
            _fill(tokenizer_path, end_id, capacity),
            "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task int, at long",
        )
    )
    rest = pieces.where("sequence_id is null")
    totals = rest.groupBy("task").agg(F.sum("length").alias("total"))
    base = totals.select("task", (F.sum("total").over(Window.orderBy("task")) - F.col("total")).alias("base"))
    begin = F.col("base") + F.col("at")
    laid = (
        rest.join(base, "task")
        .withColumn("begin", begin)
        .withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("begin") / capacity), F.floor((F.col("begin") + F.col("length") - 1) / capacity))))
        .withColumn("skip", F.greatest(F.lit(0), F.col("sequence_id") * capacity - F.col("begin")))
        .withColumn("end", F.least(F.col("begin") + F.col("length"), (F.col("sequence_id") + 1) * capacity))
        .withColumn("cut", F.col("end") - F.col("begin") - F.col("skip"))
        .select(
            "id",
            (F.col("start") + F.col("skip")).alias("start"),
            F.col("cut").alias("length"),
            F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * cut as int))").alias("ids"),
            "doc_tokens",
            "sequence_id",
            (F.col("begin") + F.col("skip") - F.col("sequence_id") * capacity).alias("offset"),
        )
    )
    out = pieces.where("sequence_id is not null").drop("task", "at").unionByName(laid)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
