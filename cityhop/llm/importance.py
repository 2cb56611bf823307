"""Importance resampling towards a target distribution, over hashed word runs.

An untrained regex Split of the tokenizers library cuts ASCII-lowered text into words with their byte offsets;
windows of one to ``max_run`` consecutive offset pairs give the features (the words of a run, joined by one space).
A feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.  Both corpora are counted into bucket
histograms; a bucket's gain is the floored, scaled logarithm of the two smoothed shares, a document's weight the
floored mean gain of its features, and its score the weight plus Gumbel noise that the id alone decides, so that
the highest scores are a draw without replacement, proportional to the weights, which reruns repeat.

Texts are cut into words once: what is kept of a document is the count of each of its buckets.  Histograms are summed
inside a task before they are shuffled, and only the gains (one integer a bucket) reach the driver.  Ranks come from
the number of documents of each score, so that no task sorts all documents.

Null and empty texts have no features and weight 0.  Long texts are cut in pieces between words.  A null id is drawn
as the empty string, and after the other ids where scores tie; rows that share an id and a score are ranked by weight,
then by number of features.  Repeated rows are documents of their own.  Extra columns are ignored.  An empty table gives
an empty result; with an empty target every gain is that of a count of 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from cityhop.llm.scratch import written

#: Words: runs of ASCII digits, lower-case letters and all code points beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SCALE = 1000
#: Bytes of text that go through the tokenizer at once, and distinct features whose bucket a task remembers.
PIECE = 1 << 16
REMEMBERED = 1 << 18
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_SPLIT = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def words(data: bytes) -> Iterator[tuple[str, tuple[int, int]]]:
    """Words of ASCII-lowered UTF-8 ``data`` with their byte offsets; pieces end at a byte that no word holds."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        piece = PreTokenizedString(data[at:end].decode("utf-8"))
        _SPLIT.pre_tokenize(piece)
        for word, (a, b), _ in piece.get_splits(offset_referential="original", offset_type="byte"):
            yield word, (at + a, at + b)
        at = end


class _Buckets:
    def __init__(self, buckets: int, max_run: int):
        self.buckets, self.max_run, self.known = buckets, max_run, {}

    def _of(self, feature: str) -> int:
        bucket = self.known.get(feature)
        if bucket is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            bucket = self.known[feature] = zlib.crc32(feature.encode("utf-8")) % self.buckets
        return bucket

    def count(self, text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Words, features, and the distinct buckets with their counts."""
        data = (text or "").encode("utf-8").lower()
        sums = np.zeros(0, np.int64)
        n_words = n_features = 0
        found: list[int] = []
        last: list[str] = []
        of = self._of
        for word, _ in words(data):
            n_words += 1
            last.append(word)
            if len(last) > self.max_run:
                del last[0]
            for k in range(1, len(last) + 1):
                found.append(of(word if k == 1 else " ".join(last[-k:])))
            if len(found) >= 1 << 16:
                sums, n_features, found = self._add(sums, found), n_features + len(found), []
        n_features += len(found)
        sums = self._add(sums, found)
        hit = np.flatnonzero(sums)
        return n_words, n_features, hit.astype(np.int32), sums[hit]

    def _add(self, sums: np.ndarray, found: list[int]) -> np.ndarray:
        more = np.bincount(np.array(found, np.int64), minlength=self.buckets)
        return more if len(sums) == 0 else sums + more


def features(df: DataFrame, id_col: str, text_col: str = "text", buckets: int = BUCKETS, max_run: int = 1) -> DataFrame:
    """One row per row: id, n_words, n_features, and its buckets with their counts."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType(
        [rows.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features")], T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucketing = _Buckets(buckets, max_run)
        for batch in batches:
            counted = [bucketing.count(t.as_py()) for t in batch.column("text")]
            ends = np.cumsum([0, *(len(c[2]) for c in counted)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype), *(c[k] for c in counted)]).astype(dtype)))
                for k, dtype in ((2, np.int32), (3, np.int64))
            ]
            numbers = [pa.array([c[k] for c in counted], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *numbers, *lists], names=["id", "n_words", "n_features", "hit", "times"])

    return rows.mapInArrow(cut, kind)


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of :func:`features`; a task hands on one row per bucket that it met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column("hit").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sums[hit])], names=["bucket", "n"])

    return counted.select("hit", "times").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket from the two histograms: ``buckets`` integers, whatever the input."""
    spark = source.sparkSession
    s, t = (h.select("bucket", F.col("n").alias(c)) for h, c in ((source, "s"), (target, "t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = (h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for h in (source, target))
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    gain = F.floor(F.lit(float(SCALE)) * F.log(up / down)).cast("long")
    return [r["gain"] for r in every.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def weigh(counted: DataFrame, gain: list[int]) -> DataFrame:
    """id, n_words, n_features, weight of each row of :func:`features`."""
    kind = T.StructType([*counted.schema.fields[:3], T.StructField("weight", T.LongType())])
    worth = np.array(gain, np.int64)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, times = batch.column("hit"), batch.column("times")
            ends = np.asarray(hit.offsets) - hit.offsets[0].as_py()
            sums = np.zeros(len(ends), np.int64)
            total = np.concatenate([[0], np.cumsum(worth[hit.flatten().to_numpy()] * times.flatten().to_numpy())])
            sums = total[ends[1:]] - total[ends[:-1]]
            n = batch.column("n_features").to_numpy()
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=kind.names)

    return counted.mapInArrow(mean, kind)


def noisy(weight: str, id_col: str, seed: str) -> F.Column:
    """The weight plus floored Gumbel noise from the first 32 bits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.col(weight) + F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: F.Column, percent: int, id_col: str) -> DataFrame:
    """``rank`` of the floor(percent * N / 100) highest scores among the N eligible rows, null elsewhere.

    Scores are whole numbers, so the rows above each score are known from one small table, of the scores that
    occur; rows are then ordered only among those of their own score.
    """
    cols = scored.columns
    per_score = written(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("_n")))
    n = per_score.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    drawn = n * percent // 100
    # runs of 256 scores first, so that no task needs more than those runs or one run's scores
    run = F.floor(F.col("score") / 256)
    in_run = per_score.withColumn("_run", run)
    runs = in_run.groupBy("_run").agg(F.sum("_n").alias("_n"))
    before_run = runs.select("_run", (F.sum("_n").over(Window.orderBy(F.desc("_run"))) - F.col("_n")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_run").orderBy(F.desc("score"))) - F.col("_n")
    above = in_run.select("_run", "score", inside.alias("_inside")).join(before_run, "_run").select("score", (F.col("_before") + F.col("_inside")).alias("_above"))
    flagged = scored.join(above.where(F.col("_above") < drawn), "score", "left").withColumn("_may", eligible & F.col("_above").isNotNull())
    order = [F.col(id_col).asc_nulls_last(), F.desc("weight"), F.desc("n_features")]
    place = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy(*order))
    tops = flagged.where("_may").select(*cols, place.cast("long").alias("rank"))
    tops = tops.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return tops.unionByName(flagged.where("not _may").select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 10,
    min_words: int = 20,
    max_run: int = 1,
    buckets: int = BUCKETS,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank (null: not drawn)."""
    counted = written(features(docs, id_col, text_col, buckets, max_run))
    aim = written(features(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text", buckets, max_run))
    gain = gains(written(histogram(counted, buckets)), written(histogram(aim, buckets)), buckets)
    scored = written(weigh(counted, gain).withColumn("score", noisy("weight", "id", seed)))
    out = ranked(scored, F.col("n_words") >= min_words, percent, "id")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
