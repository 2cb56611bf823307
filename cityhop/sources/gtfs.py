"""GTFS feeds -> Network (S1-S5), Parquet round trip (S8), transports.

Each feed is a directory of CSV files with a header.  All feeds' files of one GTFS table are read by **one** scan:
``_metadata.file_path`` says which feed a row is from, and a small table (a row per feed) says at which position that
feed's header has each column, so feeds may order, add or leave out columns as they like and the plan does not grow with
the number of feeds.  A table may be one file or a folder of part files (that share a header).

Every value is read as a string and typed explicitly -- never inferred, so ``"001"`` stays ``"001"``.  Unread columns
(``arrival_time`` may be malformed) are never parsed.  What cannot be typed is reported by :func:`rejects` (P2) with
feed, table, column, row key, raw value and reason; no row goes unreported.
"""

from __future__ import annotations

import csv
import functools
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityhop import schema
from cityhop.functions.timefmt import parse_gtfs_clock, parse_yyyymmdd
from cityhop.model import Network
from cityhop.operators.calls import hub_stops
from cityhop.operators.service import running_days

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
TABLES = ["feeds", "stops", "stop_times", "trips", "calendar", "calendar_dates"]

#: GTFS columns that are read of each file; the first ones are the row's key in reports.
READ_COLUMNS = {
    "agency": ["agency_timezone"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone", "parent_station"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "departure_time"],
    "trips": ["trip_id", "service_id", "route_id"],
    "calendar": ["service_id", *WEEKDAYS, "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}
#: Headers read at a time by the driver.
HEADER_THREADS = 16


@dataclass(frozen=True)
class FeedSpec:
    feed_id: str
    path: str
    priority: int
    kind: str | None = None  # CALENDAR / DATES / STATION; None = detect


# --- reading ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _File:
    """Where a feed has a table, and the columns of its header."""

    feed_id: str
    path: str
    folder: str  # folder that holds the CSV files, as rows' file paths spell it
    header: tuple[str, ...]


def _spelled(uri: str) -> str:
    return re.sub(r"^file:/+", "file:/", uri)


def _header(spark: SparkSession, feed_id: str, path: str) -> _File | None:
    """The header of ``path`` (its first line, of the first part file of a folder); None if there is no such table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    if not system.exists(at):
        return None
    at = system.makeQualified(at)
    if system.getFileStatus(at).isDirectory():
        folder = at
        parts = sorted(s.getPath().toString() for s in system.listStatus(at) if s.isFile() and s.getPath().getName()[0] not in "._")
        if not parts:
            return None
        at = jvm.org.apache.hadoop.fs.Path(parts[0])
    else:
        folder = at.getParent()
    stream = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(at), "UTF-8"))
    try:
        line = stream.readLine() or ""
    finally:
        stream.close()
    names = next(csv.reader([line.lstrip("\ufeff")]), [])
    return _File(feed_id, path, _spelled(folder.toUri().toString()), tuple(n.strip() for n in names))


def find_tables(spark: SparkSession, specs: list[FeedSpec]) -> dict[str, list[_File]]:
    """Per GTFS table, the feeds that have it.  Only first lines are read here."""
    wanted = [(table, s.feed_id, f"{s.path.rstrip('/')}/{table}.txt") for s in specs for table in READ_COLUMNS]
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        found = list(pool.map(lambda w: (w[0], _header(spark, w[1], w[2])), wanted))
    return {table: [f for t, f in found if t == table and f] for table in READ_COLUMNS}


def read_table(spark: SparkSession, table: str, files: list[_File]) -> DataFrame:
    """feed_id, pos (orders a feed's rows) and the raw strings of the table's read columns, for all feeds in one scan.

    A column that a feed's header lacks is null.  Blank lines are skipped; a row shorter than its header ends in nulls.
    """
    columns = READ_COLUMNS[table]
    if not files:
        return spark.createDataFrame([], ", ".join(["feed_id string", "pos struct<block:bigint,row:bigint>", *(f"{c} string" for c in columns)]))
    at = {f.folder: [f.header.index(c) if c in f.header else None for c in columns] for f in files}
    positions = sorted({i for places in at.values() for i in places if i is not None})
    width = max(len(f.header) for f in files)
    raw = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .schema(", ".join(f"c{i} string" for i in range(width)))
        .csv(sorted({f.path for f in files}))
    )
    # a row per feed: as bounded as the list of feeds
    places = spark.createDataFrame(
        [(f.folder, f.feed_id, [None if i is None else positions.index(i) + 1 for i in at[f.folder]]) for f in files],
        "folder string, feed_id string, places array<int>",
    )
    # spelled as in _spelled, without the file's name; of every row, so without patterns
    at_file = F.col("_metadata.file_path")
    spelled = F.when(at_file.startswith("file:/"), F.concat(F.lit("file:/"), F.ltrim(F.substr(at_file, F.lit(6)), F.lit("/")))).otherwise(at_file)
    folder = F.substr(spelled, F.lit(1), F.length(spelled) - F.length(F.substring_index(spelled, "/", -1)) - 1)
    rows = raw.select(
        F.array(*[F.col(f"c{i}") for i in positions]).alias("values") if positions else F.array().cast("array<string>").alias("values"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"),
        folder.alias("folder"),
    )
    rows = rows.join(F.broadcast(places), "folder")
    value = [F.try_element_at("values", F.element_at("places", F.lit(k + 1))).alias(c) for k, c in enumerate(columns)]
    return rows.select("feed_id", "pos", *value)


# --- typing -------------------------------------------------------------------------------------------------------


def _blank(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _int(c: str) -> Column:
    return F.trim(c).try_cast("int")


def _double(c: str) -> Column:
    return F.trim(c).try_cast("double")


#: Typed columns that can fail, per table: (column, typed value, reason, does a bad value reject the row).
TYPED = {
    "stops": [("stop_lat", _double, "bad_number", False), ("stop_lon", _double, "bad_number", False)],
    "stop_times": [("stop_sequence", _int, "bad_number", False), ("departure_time", parse_gtfs_clock, "bad_clock", False)],
    "calendar": [*[(d, _int, "bad_number", False) for d in WEEKDAYS], ("start_date", parse_yyyymmdd, "bad_date", True), ("end_date", parse_yyyymmdd, "bad_date", True)],
    "calendar_dates": [("date", parse_yyyymmdd, "bad_date", True), ("exception_type", _int, "bad_number", False)],
}


def _typed(table: str, raw: DataFrame) -> DataFrame:
    """The rows of a table with their typed columns; rows that are rejected are still there."""
    if table == "stops":
        out = ["stop_id", "stop_name", _double("stop_lat").alias("stop_lat"), _double("stop_lon").alias("stop_lon"), "stop_timezone"]
        return raw.select("feed_id", *out, _blank("parent_station").alias("parent_station"))
    if table == "stop_times":
        return raw.select("feed_id", "trip_id", "stop_id", _int("stop_sequence").alias("stop_sequence"), parse_gtfs_clock("departure_time").alias("departure_s"))
    if table == "trips":
        return raw.select("feed_id", "trip_id", "service_id", "route_id")
    if table == "calendar":
        days = F.array(*[_int(d) for d in WEEKDAYS]).alias("days")
        return raw.select("feed_id", "service_id", days, *[parse_yyyymmdd(c).alias(c) for c in ("start_date", "end_date")])
    return raw.select("feed_id", "service_id", parse_yyyymmdd("date").alias("date"), _int("exception_type").alias("exception_type"))


def _accepted(table: str, typed: DataFrame) -> DataFrame:
    """Without the rows that :func:`rejects` reports as rejected: no readable date, or a validity that ends before it starts."""
    if table == "calendar":
        return typed.where(F.col("start_date") <= F.col("end_date"))
    return typed.where(F.col("date").isNotNull()) if table == "calendar_dates" else typed


REJECTS = "feed_id string, table string, column string, row_key string, raw string, reason string, rejected boolean"


def _table_rejects(table: str, raw: DataFrame) -> DataFrame:
    """Values of a table that could not be typed.  A rejected row is reported once per bad column; of a date
    that is missing, too, since the row is lost without it.  Other missing values are no fault."""
    faults, any_bad = [], []
    for column, parse, reason, needed in TYPED[table]:
        given = _blank(column)
        bad = parse(column).isNull() & (F.lit(needed) | given.isNotNull())
        any_bad.append(bad)
        faults.append(F.when(bad, F.struct(F.lit(column).alias("column"), F.col(column).alias("raw"), F.when(given.isNull(), F.lit("missing")).otherwise(F.lit(reason)).alias("reason"), F.lit(needed).alias("rejected"))))
    if table == "calendar":
        span = F.concat_ws("..", F.trim("start_date"), F.trim("end_date"))
        turned = parse_yyyymmdd("start_date") > parse_yyyymmdd("end_date")
        any_bad.append(F.coalesce(turned, F.lit(False)))
        faults.append(F.when(turned, F.struct(F.lit("end_date").alias("column"), span.alias("raw"), F.lit("end_before_start").alias("reason"), F.lit(True).alias("rejected"))))
    keys = [c for c in READ_COLUMNS[table][:2] if c.endswith("_id")]
    row_key = F.concat_ws("/", *keys).alias("row_key")
    # rows without a fault, which nearly all are, leave before any report is built
    found = raw.where(functools.reduce(Column.__or__, any_bad)).select("feed_id", row_key, F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("f"))
    return found.select("feed_id", F.lit(table).alias("table"), "f.column", "row_key", "f.raw", "f.reason", "f.rejected")


def rejects(spark: SparkSession, specs: list[FeedSpec], tables: dict[str, list[_File]] | None = None) -> DataFrame:
    """Every value of the feeds' files that could not be typed (:data:`REJECTS`).

    ``rejected``: the row is left out of the network; else it is there with a null in that place.
    """
    tables = tables or find_tables(spark, specs)
    return functools.reduce(DataFrame.unionByName, [_table_rejects(t, read_table(spark, t, tables[t])) for t in TYPED])


def load_feeds(spark: SparkSession, specs: list[FeedSpec], tables: dict[str, list[_File]] | None = None) -> Network:
    """All feeds, one scan per GTFS table, and the feeds dimension.

    Kind detection when not declared: a calendar file -> CALENDAR; else any stop with a parent station -> STATION; else
    DATES.  Feed zone = first agency row.  ``Network.files`` lists which feeds have which tables.
    """
    tables = tables or find_tables(spark, specs)
    frames = {t: _accepted(t, _typed(t, read_table(spark, t, tables[t]))) for t in TABLES[1:]}
    agency = read_table(spark, "agency", tables["agency"]).groupBy("feed_id").agg(F.min_by("agency_timezone", "pos").alias("agency_timezone"))
    has_calendar = {f.feed_id for f in tables["calendar"]}
    declared = spark.createDataFrame(
        [(s.feed_id, int(s.priority), s.kind, s.feed_id in has_calendar) for s in specs],
        "feed_id string, feed_priority int, declared_kind string, has_calendar boolean",
    )
    has_parent = frames["stops"].groupBy("feed_id").agg(F.max(F.col("parent_station").isNotNull()).alias("has_parent"))
    feeds = (
        declared.join(has_parent, "feed_id", "left")
        .join(agency, "feed_id", "left")
        .select(
            "feed_id",
            "feed_priority",
            F.coalesce(
                F.col("declared_kind"),
                F.when(F.col("has_calendar"), F.lit("CALENDAR"))
                .when(F.coalesce(F.col("has_parent"), F.lit(False)), F.lit("STATION"))
                .otherwise(F.lit("DATES")),
            ).alias("feed_kind"),
            F.coalesce(F.col("agency_timezone"), F.lit("UTC")).alias("timezone"),
        )
    )
    files = spark.createDataFrame([(f.feed_id, t) for t in READ_COLUMNS for f in tables[t]], schema.FILES)
    return Network(feeds=feeds, files=files, **frames)


#: What each table is sorted by in its files; row-group statistics then prune a feed filter.
SORTED_BY = {"stops": "stop_id", "stop_times": "trip_id", "trips": "trip_id", "calendar": "service_id", "calendar_dates": "service_id"}


def write_network(net: Network, out_dir: str, mode: str = "overwrite") -> None:
    """Persist every table, the running days and the hub stops, if any, as Parquet, sorted by feed inside its files.

    There are no partition folders per feed: every join uses ``feed_id``, and a partition
    column would make Spark nest a pruning subquery, a copy of the other side, at each.
    """
    for name in TABLES:
        df = getattr(net, name)
        if name in SORTED_BY:
            df = df.sortWithinPartitions("feed_id", SORTED_BY[name])
        df.write.mode(mode).parquet(f"{out_dir.rstrip('/')}/{name}")
    running_days(net).sortWithinPartitions("feed_id", "service_id").write.mode(mode).parquet(f"{out_dir.rstrip('/')}/days")
    hubs = hub_stops(net.stop_times.sparkSession.read.schema(schema.STOP_TIMES).parquet(f"{out_dir.rstrip('/')}/stop_times"))
    if hubs.limit(1).count():
        hubs.write.mode(mode).parquet(f"{out_dir.rstrip('/')}/hubs")
    if net.files is not None:
        net.files.write.mode(mode).parquet(f"{out_dir.rstrip('/')}/files")


def read_network(spark: SparkSession, in_dir: str) -> Network:
    """Read a network written by :func:`write_network`."""
    base = in_dir.rstrip("/")
    frames = {}
    for name in TABLES:
        target = getattr(schema, name.upper())
        df = spark.read.schema(target).parquet(f"{base}/{name}")
        frames[name] = df.select(*[F.col(f.name) for f in target.fields])
    for name in ("files", "days", "hubs"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            frames[name] = spark.read.schema(getattr(schema, name.upper())).parquet(f"{base}/{name}")
    return Network(**frames)


def transports(net: Network) -> DataFrame:
    """Feeds that hold data, in priority order."""
    loaded = net.trips.select("feed_id").distinct()
    return net.feeds.join(loaded, "feed_id", "left_semi").select("feed_id", "feed_priority").orderBy("feed_priority")
