"""Exact deduplication by a stateful stream.

A stream over the table's files keeps, in RocksDB on disk and without expiry, one state row per SHA-256
digest: the number of rows, and of the row with the largest id that id (the stable identifier) and where its text
lies (file and row).  New files continue the stream from its checkpoint; nothing ever leaves the state.

A digest that was hit again is checked on full bytes: the texts of the hit digests are grouped by digest and
whole text.  Copies combine before the shuffle, so a group of copies is one row a task.  Should texts of one digest
differ, their rows are told apart by text.

Null texts count as empty.  Rows with equal texts and the largest id are all reported as kept (the id stays).
A null id stays only in a group without another.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityhop.llm.scratch import written
from cityhop.session import ensure_checkpoint_dir

#: Hit digests (64 characters and three longs) up to which they are broadcast; they are counted first.
BROADCAST_ROWS = 50_000
#: State on disk; without preallocated logs, since every shuffle partition has a store of its own.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _source(spark: SparkSession, path: str, files_per_trigger: int | None) -> DataFrame:
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = [f.rstrip("/").rpartition("/")[2] for f in table.inputFiles()] == [name]
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def run_stream(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_trigger: int | None = None,
    digest=sha256,
) -> DataFrame:
    """Take the files that the stream has not seen; the state after that: digest, keep_id, group_size, locator."""
    rows = _source(spark, path, files_per_trigger).select(
        digest(F.col(text_col)).alias("digest"),
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("kept"),
    )
    kept = rows.groupBy("digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    state = spark.read.format("statestore").load(checkpoint)
    held = state.schema["value"].dataType
    top = next(f.name for f in held if f.dataType.typeName() == "struct")
    count = next(f.name for f in held if f.dataType.typeName() == "long")
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.{top}.id").alias("keep_id"),
        F.col(f"value.{count}").alias("group_size"),
        F.struct(F.col(f"value.{top}.file"), F.col(f"value.{top}.row")).alias("locator"),
    )


def exact_duplicates(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    checkpoint: str | None = None,
    files_per_trigger: int | None = None,
    digest=sha256,
) -> DataFrame:
    """One row per row of the table: id, keep_id, group_size, kept, text_sha256."""
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/exact-{uuid.uuid4().hex}"
    docs = spark.read.parquet(path).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    if docs.isEmpty():
        return _result(docs.select("id", sha256(F.col("text")).alias("sha"), F.col("id").alias("keep_id"), F.lit(None).cast("long").alias("group_size")), id_col)
    state = run_stream(spark, path, checkpoint, id_col, text_col, files_per_trigger, digest)
    hits = written(state.where("group_size > 1").select("digest", "keep_id", "group_size"))
    few = hits.count() <= BROADCAST_ROWS
    small = F.broadcast(hits) if few else hits
    texts = docs.join(F.broadcast(hits.select("digest")) if few else hits.select("digest"), "digest", "left_semi")
    distinct = texts.groupBy("digest", "text").agg(F.max("id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
    unlike = written(distinct.withColumn("n", F.lit(1)).groupBy("digest").agg(F.sum("n").alias("texts")).where("texts > 1").select("digest"))
    rows = docs.select("id", "text", "digest")
    if unlike.isEmpty():
        out = rows.select("id", "digest", sha256(F.col("text")).alias("sha")).join(small, "digest", "left")
    else:
        told = distinct.join(unlike, "digest", "left_semi")
        out = (
            rows.join(small, "digest", "left")
            .join(told, ["digest", "text"], "left")
            .select("id", sha256(F.col("text")).alias("sha"), F.coalesce("own_id", "keep_id").alias("keep_id"), F.coalesce("own_size", "group_size").alias("group_size"))
        )
    return _result(out, id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
