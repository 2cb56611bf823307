"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors: 16 lanes modulo 2**64 of a keyless BLAKE2b digest, and 256 lanes modulo 2**32 of the paragraph's 8-byte
grams (each adds or subtracts one in the lane of its hash; a text that Spark can hold has fewer than 2**31 grams, so none wraps).  Sums do not depend on order, and a paragraph is
inserted or deleted by adding or subtracting its vector (``insert``, ``delete``, ``combine``).

Equal multisets of paragraphs have equal fingerprints; unlike ones differ in the digest lanes.  ``likeness`` is
the cosine of the gram lanes, not under 0: 1 for equal fingerprints, about 0 for unrelated texts.

Null and empty texts have one empty paragraph.  ``with_next`` orders rows by id (nulls first), then text; rows of equal ids
follow one another; a single row is its own next one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.llm.words import mix

EXACT, LANES, GRAM = 16, 256, 8
SEGMENT = 1 << 20
Print = tuple[np.ndarray, np.ndarray]


def _grams(raw: np.ndarray) -> np.ndarray:
    """Signed lane counts of the grams that cross no line feed."""
    total = np.zeros(2 * LANES, np.int64)
    for at in range(0, max(1, len(raw) - GRAM + 1), SEGMENT):
        b = raw[at : at + SEGMENT + GRAM - 1].astype(np.uint64)
        if len(b) < GRAM:
            break
        two = b[:-1] | (b[1:] << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        eight = four[:-4] | (four[4:] << np.uint64(32))
        feeds = np.zeros(len(b) + 1, np.int64)
        np.cumsum(b == 10, out=feeds[1:])
        h = mix(eight[feeds[GRAM:] == feeds[:-GRAM]])
        total += np.bincount((h & np.uint64(2 * LANES - 1)).astype(np.int64), minlength=2 * LANES)
    return total[:LANES] - total[LANES:]


def vector(text: str | None) -> Print:
    """The sum of the vectors of a text's paragraphs."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    exact = np.zeros(EXACT, np.uint64)
    lanes = _grams(np.frombuffer(raw, np.uint8))
    for p in raw.split(b"\n"):
        digest = hashlib.blake2b(p).digest() + hashlib.blake2b(p, salt=b"second").digest()
        part = np.frombuffer(digest, "<u8")
        exact += part
        if len(p) < GRAM:  # too short for a gram: itself is one
            k = int(part[0]) % (2 * LANES)
            lanes[k % LANES] += 1 if k < LANES else -1
    return exact, lanes.astype(np.int32)


def to_string(v: Print) -> str:
    return binascii.b2a_base64(v[0].astype("<u8").tobytes() + v[1].astype("<i4").tobytes(), newline=False).decode()


def from_string(s: str) -> Print:
    raw = binascii.a2b_base64(s)
    return np.frombuffer(raw[: 8 * EXACT], "<u8").copy(), np.frombuffer(raw[8 * EXACT :], "<i4").copy()


def combine(a: Print, b: Print, sign: int = 1) -> Print:
    """The fingerprint of both multisets together, or (sign -1) of ``a`` without ``b``."""
    return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def insert(fingerprint: str, paragraph: str) -> str:
    return to_string(combine(from_string(fingerprint), vector(paragraph)))


def delete(fingerprint: str, paragraph: str) -> str:
    return to_string(combine(from_string(fingerprint), vector(paragraph), -1))


def likeness(a: Print, b: Print) -> float:
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([to_string(vector(t)) for t in texts], dtype=object)

    return documents.select(F.col(id_col), of(F.col(text_col)).alias("fingerprint"))


def _edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # block, id, text, vector of the row before
    for pdf in batches:
        out = []
        for block, key, text in zip(pdf["block"], pdf["id"], pdf["text"]):
            text = text or ""
            own = vector(text)
            if held is not None and held[0] == block:
                _, before, said, print_ = held
                n = len(said)
                k = n // 4
                new = said[: n - k] + text[:k]
                changed = vector(new)
                out.append(
                    (
                        before,
                        n,
                        hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                        to_string(print_),
                        to_string(changed),
                        likeness(print_, changed),
                        likeness(print_, own),
                    )
                )
            held = (block, key, text, own)
        yield pd.DataFrame(out, columns=columns)


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edit by the next one; ids are integers.

    Ids are cut into blocks at ids of the table; the first rows of a block also go to the block before it
    (those of the first to the last one), so each block holds its rows' successors, and texts are shuffled once.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    docs = documents.select(order.alias("o"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.agg(F.min("o").alias("low"), F.percentile_approx("o", [i / blocks for i in range(1, blocks)]).alias("cuts")).first()
    schema = "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    starts = np.array(sorted({cut["low"], *(cut["cuts"] or [])}) if cut["low"] is not None else [0], np.int64)
    last = len(starts) - 1

    @F.pandas_udf("int")
    def block_of(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, o.to_numpy(np.int64), side="right") - 1)

    @F.pandas_udf("boolean")
    def opens(o: pd.Series) -> pd.Series:
        return pd.Series(np.isin(o.to_numpy(np.int64), starts))

    own = docs.withColumn("b", block_of("o")).withColumn("first", opens("o"))
    before = F.when(F.col("b") == 0, F.lit(last)).otherwise(F.col("b") - 1)
    places = F.array(F.struct(F.col("b").alias("block"), F.lit(False).alias("copy")), F.struct(before.alias("block"), F.lit(True).alias("copy")))
    placed = own.select(F.explode(F.slice(places, 1, F.when(F.col("first"), 2).otherwise(1))).alias("p"), "o", "id", "text").select("p.*", "o", "id", "text")
    rows = placed.repartition("block").sortWithinPartitions("block", "copy", "o", "text").select("block", "copy", "id", "text")
    # of the copies, the first row is the successor of the block's last one; the others have theirs in their own block
    out = rows.mapInPandas(_edit_blocks, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _edit_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def needed() -> Iterator[pd.DataFrame]:
        seen = None  # the block whose first copy was passed on
        for pdf in batches:
            copy, block = pdf["copy"].to_numpy(bool), pdf["block"].to_numpy()
            keep = np.ones(len(pdf), bool)
            for i in np.flatnonzero(copy):
                keep[i] = block[i] != seen
                seen = block[i]
            yield pdf[keep]

    return _edit(needed())
