"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of ``documents``.
Texts that a stage shortens get their ``n_chars`` anew.  Nulls, empty and repeated rows and empty tables: as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityhop.llm.line_dedup import dedup_lines
from cityhop.llm.mixing import mixed_documents
from cityhop.llm.near_dedup import near_rows
from cityhop.llm.packing import pack
from cityhop.llm.scratch import fresh, importable, written
from cityhop.llm.toxicity import clean_documents, fit

#: Rows (an id and a hash each) that are broadcast once they were counted to be no more.
BROADCAST_ROWS = 200_000
#: Characters of a part of an output shard, about; parts of the fewest.
PART_CHARS, LEAST_PARTS = 1 << 26, 64


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    importable(spark)
    return clean_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those of which no word is left go."""
    importable(spark)
    lines, removed = fresh(docs.columns, "n_lines", "removed")
    left = dedup_lines(docs, lines_col=lines, removed_col=removed)
    return _recounted(left.where((F.size(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    importable(spark)
    dropped = written(near_rows(docs).where("not stays").select("doc", "th"))
    few = dropped.count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(F.col("doc")) & (F.xxhash64(docs["text"]) == F.col("th"))
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row per drawn copy, shuffled inside each output shard."""
    mixed = mixed_documents(docs)
    shard, order = mixed.columns[-2:]
    shards = 16
    # the mix has 1.5 times the input's words: parts of a shard grow in number with the input, not in size
    chars = docs.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n")).first()["n"]
    parts = max(LEAST_PARTS, -(-3 * chars // (2 * shards * PART_CHARS)))
    mixed = mixed.repartition(shard, F.pmod(order, F.lit(parts))).sortWithinPartitions(shard, order)
    return _recounted(mixed, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    importable(spark)
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express none of the stages but the mix; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
