"""Binding of the benchmark tables (TPC-H-like star schema + events) to GTFS shape.

The benchmark data holds no timetables, so its tables are mapped:

* feeds: F0 CALENDAR (UTC), F1 DATES (Europe/Paris), F2 STATION
  (Europe/Paris); a trip (order) belongs to feed ``o_orderkey % 3``.
* stops: one per supplier in every feed, placed on a grid by nation with a
  small per-supplier offset; in F2 suppliers are platforms whose parent is
  a station per nation.
* trips: orders (service = customer, route = customer % 50).
* stop_times: lineitems ordered inside their order; departure grows along
  the trip by 25 minutes per stop and sometimes exceeds 24h.
* calendar (F0): one row per customer; calendar_dates: F1/F2 run on the
  days a user has events, F0 cancels one day of every third customer.

Arithmetic is spelled with explicit DOUBLE casts so the same IEEE
operations can be written in any SQL engine.  The same mapping in SQL lives
in :mod:`cityhop.sources.testbind_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityhop.model import Network
from cityhop.sources.gtfs import WEEKDAYS, FeedSpec

# Fixed feed declarations of the binding.
FEED_ROWS = [("F0", 0, "CALENDAR", "UTC"), ("F1", 1, "DATES", "Europe/Paris"), ("F2", 2, "STATION", "Europe/Paris")]

NATION_LAT = "CAST(44.0 AS DOUBLE) + CAST({k} DIV 5 AS DOUBLE) * CAST(0.9 AS DOUBLE)"
NATION_LON = "CAST(-1.0 AS DOUBLE) + CAST({k} % 5 AS DOUBLE) * CAST(1.2 AS DOUBLE)"
SUPP_LAT = "(" + NATION_LAT.format(k="s_nationkey") + ") + CAST(s_suppkey % 7 AS DOUBLE) * CAST(0.02 AS DOUBLE)"
SUPP_LON = "(" + NATION_LON.format(k="s_nationkey") + ") + CAST(s_suppkey % 11 AS DOUBLE) * CAST(0.03 AS DOUBLE)"
# Centre of the supplier spread of a nation (used for request places).
PLACE_LAT = "(" + NATION_LAT.format(k="n_nationkey") + ") + CAST(0.06 AS DOUBLE)"
PLACE_LON = "(" + NATION_LON.format(k="n_nationkey") + ") + CAST(0.15 AS DOUBLE)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEED_ROWS, "feed_id string, feed_priority int, feed_kind string, timezone string")


def _feed_of(key: str):
    return F.concat(F.lit("F"), (F.col(key) % 3).cast("string"))


def bind(spark: SparkSession, sf_dir: str) -> Network:
    rd = lambda t: read_table(spark, sf_dir, t)
    nation = rd("nation").select("n_nationkey", "n_name")
    supplier = rd("supplier").select("s_suppkey", "s_nationkey")

    # nation is a fixed 25-row dimension: broadcasting it is bounded.
    sup = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
    platforms = sup.select(
        F.explode(F.array(F.lit("F0"), F.lit("F1"), F.lit("F2"))).alias("feed_id"),
        F.col("s_suppkey").cast("string").alias("stop_id"),
        F.concat(F.lit("Gare de "), F.col("n_name"), F.lit(" "), (F.col("s_suppkey") % 20).cast("string")).alias("stop_name"),
        F.expr(SUPP_LAT).alias("stop_lat"),
        F.expr(SUPP_LON).alias("stop_lon"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("_station"),
    ).select(
        "feed_id",
        "stop_id",
        "stop_name",
        "stop_lat",
        "stop_lon",
        F.when(F.col("feed_id") == "F0", F.lit("Europe/Paris")).alias("stop_timezone"),
        F.when(F.col("feed_id") == "F2", F.col("_station")).alias("parent_station"),
    )
    stations = nation.select(
        F.lit("F2").alias("feed_id"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("stop_id"),
        F.concat(F.lit("Gare de "), F.col("n_name")).alias("stop_name"),
        F.expr(NATION_LAT.format(k="n_nationkey")).alias("stop_lat"),
        F.expr(NATION_LON.format(k="n_nationkey")).alias("stop_lon"),
        F.lit(None).cast("string").alias("stop_timezone"),
        F.lit(None).cast("string").alias("parent_station"),
    )
    stops = platforms.unionByName(stations)

    orders = rd("orders").select("o_orderkey", "o_custkey")
    trips = orders.select(
        _feed_of("o_orderkey").alias("feed_id"),
        F.col("o_orderkey").cast("string").alias("trip_id"),
        F.col("o_custkey").cast("string").alias("service_id"),
        (F.col("o_custkey") % 50).cast("string").alias("route_id"),
    )

    li = rd("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    seq = F.row_number().over(w)
    stop_times = li.select("l_orderkey", "l_suppkey", seq.alias("seq")).select(
        _feed_of("l_orderkey").alias("feed_id"),
        F.col("l_orderkey").cast("string").alias("trip_id"),
        F.col("l_suppkey").cast("string").alias("stop_id"),
        F.col("seq").cast("int").alias("stop_sequence"),
        (((F.col("l_orderkey") * 37) % 1380) * 60 + F.col("seq") * 1500).cast("int").alias("departure_s"),
    )

    cust = rd("customer").select("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 20).cast("int"))
    calendar = cust.select(
        F.lit("F0").alias("feed_id"),
        F.col("c_custkey").cast("string").alias("service_id"),
        F.array(*[(F.shiftright(F.col("c_custkey") % 128, i) % 2).cast("int") for i in range(7)]).alias("days"),
        start.alias("start_date"),
        F.date_add(start, (F.col("c_custkey") % 13).cast("int")).alias("end_date"),
    )

    ev = rd("events").select("user_id", "ts")
    running = ev.select(F.col("user_id").cast("string").alias("service_id"), F.to_date("ts").alias("date")).distinct()
    dated = running.select(
        F.explode(F.array(F.lit("F1"), F.lit("F2"))).alias("feed_id"), "service_id", "date", F.lit(1).alias("exception_type")
    )
    cancelled = cust.where(F.col("c_custkey") % 3 == 0).select(
        F.lit("F0").alias("feed_id"),
        F.col("c_custkey").cast("string").alias("service_id"),
        F.date_add(start, (F.col("c_custkey") % 7).cast("int")).alias("date"),
        F.lit(2).alias("exception_type"),
    )
    calendar_dates = dated.unionByName(cancelled)
    return Network(feeds(spark), stops, stop_times, trips, calendar, calendar_dates)


def nation_places(spark: SparkSession, sf_dir: str, max_distance: float = 0.2) -> DataFrame:
    """One request place per nation, at the centre of its suppliers."""
    nation = read_table(spark, sf_dir, "nation")
    return nation.select(
        F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("query_id"),
        F.expr(PLACE_LAT).alias("lat"),
        F.expr(PLACE_LON).alias("lon"),
        F.lit(float(max_distance)).alias("max_distance"),
    )


def with_period(places: DataFrame, start: str, end: str, transports: list[str] | None = None) -> DataFrame:
    t = F.array(*[F.lit(x) for x in transports]) if transports else F.lit(None).cast("array<string>")
    return places.select(
        "*", F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"), t.alias("transports")
    )


# --- the bound tables as GTFS text, with values that cannot be read ------------------------------------------------

#: Column order of each feed's files: as declared, backwards with a further column, rotated.
_ORDERS = {"F0": lambda c: c, "F1": lambda c: ["note", *reversed(c)], "F2": lambda c: [*c[1:], c[0]]}
BAD_START, BAD_CLOCK, BAD_SEQUENCE, BAD_LAT, BAD_TYPE = "20241301", "7h30", "two", "n/a", "x"


def clock_of(second: Column) -> Column:
    """``H:MM:SS`` of seconds, as ``format_string('%d:%02d:%02d')`` writes it (of a null: three times null)."""
    two = lambda c: F.when(c.between(0, 9), F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    hours, minutes = F.floor(second / 3600).cast("int"), (F.floor(second / 60) % 60).cast("int")
    text = F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two((second % 60).cast("int")))
    return F.coalesce(text, F.lit("null:null:null"))


def text_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw strings of each GTFS table of the binding (with feed_id), some of them malformed by rule:

    services 3 (mod 17) start on a 13th month, 5 (mod 19) have their validity turned round; dates of services 7 (mod 23)
    are not YYYYMMDD, types of 1 (mod 29) no numbers; second stops of trips 11 (mod 41) have no clock time, first ones of
    5 (mod 43) no number; stops 4 (mod 13) of F1 no latitude.  Arrival times, never read, are all malformed.
    """
    net = bind(spark, sf_dir)
    key = lambda c, m, r: F.coalesce(F.col(c).try_cast("long") % m == r, F.lit(False))
    text = lambda c: F.col(c).cast("string").alias(c)
    second = F.col("departure_s")
    clock = clock_of(second)
    start, end = (F.date_format(c, "yyyyMMdd") for c in ("start_date", "end_date"))
    turned = key("service_id", 19, 5)
    return {
        "agency": net.feeds.select("feed_id", F.lit("a").alias("agency_id"), F.col("timezone").alias("agency_timezone")),
        "stops": net.stops.select(
            "feed_id",
            "stop_id",
            F.when(F.col("feed_id") == "F2", F.concat("stop_name", F.lit(', "quai"'))).otherwise(F.col("stop_name")).alias("stop_name"),
            F.when((F.col("feed_id") == "F1") & key("stop_id", 13, 4), F.lit(BAD_LAT)).otherwise(F.col("stop_lat").cast("string")).alias("stop_lat"),
            text("stop_lon"),
            "stop_timezone",
            "parent_station",
        ),
        "stop_times": net.stop_times.select(
            "feed_id",
            "trip_id",
            F.lit("07:34:00:").alias("arrival_time"),
            F.when(key("trip_id", 41, 11) & (F.col("stop_sequence") == 2), F.lit(BAD_CLOCK)).otherwise(clock).alias("departure_time"),
            "stop_id",
            F.when(key("trip_id", 43, 5) & (F.col("stop_sequence") == 1), F.lit(BAD_SEQUENCE)).otherwise(F.col("stop_sequence").cast("string")).alias("stop_sequence"),
        ),
        "trips": net.trips.select("feed_id", "trip_id", "service_id", "route_id"),
        "calendar": net.calendar.select(
            "feed_id",
            "service_id",
            *[F.element_at("days", i + 1).cast("string").alias(d) for i, d in enumerate(WEEKDAYS)],
            F.when(key("service_id", 17, 3), F.lit(BAD_START)).when(turned, end).otherwise(start).alias("start_date"),
            F.when(turned, start).otherwise(end).alias("end_date"),
        ),
        "calendar_dates": net.calendar_dates.select(
            "feed_id",
            "service_id",
            F.date_format("date", "yyyyMMdd").alias("day"),
            F.when(key("service_id", 23, 7), F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyyMMdd")).alias("date"),
            F.when(key("service_id", 29, 1), F.lit(BAD_TYPE)).otherwise(F.col("exception_type").cast("string")).alias("exception_type"),
        ),
    }


def write_gtfs_text(spark: SparkSession, sf_dir: str, out: str) -> list[FeedSpec]:
    """Write :func:`text_tables` as one folder of GTFS files per feed; their specs."""
    tables = text_tables(spark, sf_dir)
    specs = [FeedSpec(f, f"{out.rstrip('/')}/{f}", priority) for f, priority, _, _ in FEED_ROWS]
    for spec in specs:
        for name, df in tables.items():
            if name == "calendar" and spec.feed_id != "F0":
                continue
            columns = [c for c in df.columns if c != "feed_id"]
            rows = df.where(F.col("feed_id") == spec.feed_id).withColumn("note", F.lit("x, y"))
            ordered = rows.select(*_ORDERS[spec.feed_id](columns))
            ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{spec.path}/{name}.txt")
    return specs
