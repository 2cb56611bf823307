"""Request validation (F10) and feed freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityhop.functions.timefmt import parse_iso_request_time, parse_request_clock, parse_yyyymmdd
from cityhop.operators.cities import snap_to_city

# What a request that leaves a field out asks for.
REQUEST_DEFAULTS = {
    "start": "2024-10-10T00:00:00",
    "end": "2024-10-11T00:00:00",
    "dep_time": "06:00:00",
    "lat": 48.8566,
    "lon": 2.3522,
}
#: Columns of a reported request: which field was refused, its value as given, and why.
REJECT_COLUMNS = ["query_id", "field", "raw", "reason"]

STALE_BELOW = 0.8  # a feed needs refreshing when < 80 % of its service dates lie ahead


def validate_period(raw: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Parse ``yyyy-MM-ddTHH:mm:ss`` period strings into DATE bounds.

    Adds start_date, end_date and ``error``: 'bad_time' when a bound does
    not parse, 'end_before_start' when end < start, NULL when valid.  The
    time of day is dropped: bounds are whole days, inclusive.
    """
    s, e = parse_iso_request_time(F.col(start)), parse_iso_request_time(F.col(end))
    err = F.when(s.isNull() | e.isNull(), F.lit("bad_time")).when(e < s, F.lit("end_before_start"))
    return raw.withColumn("start_date", F.to_date(s)).withColumn("end_date", F.to_date(e)).withColumn("error", err)


def flag_unknown_place(req: DataFrame, snapped: DataFrame, error_col: str = "error") -> DataFrame:
    """Set ``error='unknown_place'`` on valid requests with no city (left anti on the snap)."""
    has = snapped.select("query_id").distinct().withColumn("_has", F.lit(True))
    return (
        req.join(has.hint("merge"), "query_id", "left")
        .withColumn(error_col, F.coalesce(F.col(error_col), F.when(F.col("_has").isNull(), F.lit("unknown_place"))))
        .drop("_has")
    )


def with_defaults(raw: DataFrame, places: tuple[str, ...]) -> DataFrame:
    """Null or absent fields of requests filled with :data:`REQUEST_DEFAULTS`.

    ``places`` are the prefixes of the coordinate columns (``"dep_"``, ``"arr_"``; ``""`` for a single place); a place is
    filled as a whole.  Absent ``transports`` mean every feed.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None)

    fields = {c: F.coalesce(given(c).cast("string"), F.lit(REQUEST_DEFAULTS[c])) for c in ("start", "end")}
    if len(places) > 1:
        fields["dep_time"] = F.coalesce(given("dep_time").cast("string"), F.lit(REQUEST_DEFAULTS["dep_time"]))
    for p in places:
        lat, lon = given(f"{p}lat").cast("double"), given(f"{p}lon").cast("double")
        none = lat.isNull() & lon.isNull()
        fields[f"{p}lat"] = F.when(none, F.lit(REQUEST_DEFAULTS["lat"])).otherwise(lat)
        fields[f"{p}lon"] = F.when(none, F.lit(REQUEST_DEFAULTS["lon"])).otherwise(lon)
    fields["transports"] = given("transports").cast("array<string>")
    return raw.withColumns(fields)


def _faults(places: tuple[str, ...]) -> Column:
    """The first fault of a request (field, raw, reason), or null: times first, then places."""
    s, e = parse_iso_request_time(F.col("start")), parse_iso_request_time(F.col("end"))

    def fault(field: str, raw: Column, reason: str) -> Column:
        return F.struct(F.lit(field).alias("field"), raw.cast("string").alias("raw"), F.lit(reason).alias("reason"))

    first = F.when(s.isNull(), fault("start", F.col("start"), "bad_time")).when(e.isNull(), fault("end", F.col("end"), "bad_time"))
    first = first.when(e < s, fault("end", F.concat_ws("..", "start", "end"), "end_before_start"))
    if len(places) > 1:
        first = first.when(parse_request_clock("dep_time").isNull(), fault("dep_time", F.col("dep_time"), "bad_time"))
    for p in places:
        first = first.when(F.col(f"{p}city").isNull(), fault(f"{p}place", F.concat_ws(",", f"{p}lat", f"{p}lon"), "unknown_place"))
    return first


def _checked(raw: DataFrame, cities: DataFrame, places: tuple[str, ...], **snap) -> DataFrame:
    full = with_defaults(raw, places)
    for p in places:
        found = snap_to_city(full.select("query_id", F.col(f"{p}lat").alias("lat"), F.col(f"{p}lon").alias("lon")), cities, **snap)
        # as many as the requests: never sent to the driver to be broadcast
        full = full.join(found.select("query_id", F.col("city_id").alias(f"{p}city")).hint("merge"), "query_id", "left")
    dates = {"start_date": F.to_date(parse_iso_request_time("start")), "end_date": F.to_date(parse_iso_request_time("end"))}
    if len(places) > 1:
        dates["min_departure_s"] = parse_request_clock("dep_time")
    return full.withColumns({"fault": _faults(places), **dates})


def check_destination_requests(raw: DataFrame, cities: DataFrame, **snap) -> DataFrame:
    """F10 for O11: raw requests (query_id, lat, lon, start, end[, transports]) with defaults, typed bounds, ``city`` and ``fault``."""
    return _checked(raw, cities, ("",), **snap)


def check_trip_requests(raw: DataFrame, cities: DataFrame, **snap) -> DataFrame:
    """F10 for O12: raw requests (query_id, dep_lat, dep_lon, arr_lat, arr_lon, start, end, dep_time[, transports])
    with defaults, typed bounds, ``min_departure_s``, ``dep_city``, ``arr_city`` and ``fault``.

    Both places must be known; ``dep_time`` is ``HH:mm:ss``.
    """
    return _checked(raw, cities, ("dep_", "arr_"), **snap)


def accepted(checked: DataFrame) -> DataFrame:
    """The typed requests without a fault, as O11 and O12 take them."""
    return checked.where(F.col("fault").isNull()).drop("fault", "start", "end", "dep_time")


def rejected(checked: DataFrame) -> DataFrame:
    """The other requests: :data:`REJECT_COLUMNS`."""
    return checked.where(F.col("fault").isNotNull()).select("query_id", "fault.*")


def feed_freshness(net, as_of, rejects: DataFrame | None = None) -> DataFrame:
    """Per feed, share of service dates strictly after ``as_of`` and a stale flag.

    Dates are calendar end dates for CALENDAR feeds and calendar_dates dates otherwise.  With ``rejects`` (of
    :func:`cityhop.sources.gtfs.rejects`) the end dates of calendar rows that were refused for ending before they start count too.
    A feed that has no such file is stale; one whose file has no rows is not (there is nothing to outdate).  Where the network does not
    know its files, a feed without rows counts as one without file.
    Output: feed_id, n_dates, share_future, stale.
    """
    as_of = F.lit(as_of).cast("date") if not isinstance(as_of, F.Column) else as_of
    kinds = net.feed_info().select("feed_id", "feed_kind")
    ends = net.calendar.select("feed_id", F.col("end_date").alias("d"))
    if rejects is not None:
        turned = rejects.where("table = 'calendar' and reason = 'end_before_start'")
        ends = ends.unionByName(turned.select("feed_id", parse_yyyymmdd(F.substring_index("raw", "..", -1)).alias("d")))
    cal = ends.join(kinds.where(F.col("feed_kind") == "CALENDAR"), "feed_id")
    cd = net.calendar_dates.select("feed_id", F.col("date").alias("d")).join(kinds.where(F.col("feed_kind") != "CALENDAR"), "feed_id")
    dates = cal.select("feed_id", "d").unionByName(cd.select("feed_id", "d"))
    agg = dates.groupBy("feed_id").agg(
        F.count("*").alias("n_dates"), F.avg(F.when(F.col("d") > as_of, 1.0).otherwise(0.0)).alias("share_future")
    )
    out = net.feeds.select("feed_id", "feed_kind").join(agg, "feed_id", "left")
    if net.files is None:
        has_file = F.col("share_future").isNotNull()
    else:
        dated = net.files.where("file in ('calendar', 'calendar_dates')").groupBy("feed_id").agg(F.collect_set("file").alias("dated"))
        out = out.join(dated, "feed_id", "left")
        needed = F.when(F.col("feed_kind") == "CALENDAR", F.lit("calendar")).otherwise(F.lit("calendar_dates"))
        has_file = F.coalesce(F.array_contains("dated", needed), F.lit(False))
    return out.select(
        "feed_id",
        F.coalesce(F.col("n_dates"), F.lit(0)).cast("long").alias("n_dates"),
        "share_future",
        (~has_file | F.coalesce(F.col("share_future") < F.lit(STALE_BELOW), F.lit(False))).alias("stale"),
    )
