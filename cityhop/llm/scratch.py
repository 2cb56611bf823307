"""Intermediate tables in the session's shared folder."""

from __future__ import annotations

import functools
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityhop.session import ensure_checkpoint_dir

#: Arrow batches of whole texts, where the session has Spark's defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there.

    The plan is cut here: what follows reads files that every executor sees, so
    losing an executor costs at most the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns, *wanted: str) -> list[str]:
    """Names for internal columns that clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def heavy_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per key and in ``weight`` the number of ``rows`` with that key.

    Keys with over a thousandth of the weight, fewer than a thousand, are broadcast; their rows, and those with a null in
    the key, then go through the shuffle of the others dealt out by a hash of the columns ``spread`` instead of their key.
    """
    columns = [c for c in table.columns if c not in on and c != weight]
    is_heavy, by, low = fresh([*rows.columns, *table.columns], "heavy", "by", "low")
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    heavy = F.col(weight) * 1000 > total
    top = table.where(heavy).select(*on, *[F.col(c).alias(f"{low}_{c}") for c in columns], F.lit(True).alias(is_heavy))
    rest = table.where(~heavy).select(*on, *columns, F.lit(-1).alias(by))
    blank = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    dealt = F.when(F.col(is_heavy) | blank, F.pmod(F.xxhash64(*spread), F.lit(1 << 16)).cast("int")).otherwise(F.lit(-1))
    met = rows.join(F.broadcast(top), on, "left").withColumn(by, dealt).join(rest, [*on, by], "left")
    return met.select(*rows.columns, *[F.coalesce(c, f"{low}_{c}").alias(c) for c in columns])


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``rows`` with ``number``, from 1 in the order of ``by``: counted range by range, so that no task orders them all."""
    ranged = written(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # a row per range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    joined = ranged.withColumn("place", place).join(F.broadcast(before), "range")
    return joined.select(*rows.columns, (F.col("before") + F.col("place")).alias("number"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    cluster without shared code folders gets it by ``--py-files``), and bound their batches."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*filter(None, paths), root])
    # whole texts go to Python: Spark's default batch of 10,000 rows has no bound in bytes
    for name, value in BATCH.items():
        if spark.conf.get(name, None) in (None, "10000", "-1", "9223372036854775807", "2147483647"):
            spark.conf.set(name, value)
