"""Fixed schemas of the engine's tables (never inferred)."""

from pyspark.sql import types as T

S, D, I, L, DT = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.DateType()

FEED_KINDS = ("CALENDAR", "DATES", "STATION")

FEEDS = T.StructType(
    [
        T.StructField("feed_id", S, False),
        T.StructField("feed_priority", I, False),
        T.StructField("feed_kind", S, True),
        T.StructField("timezone", S, True),
    ]
)

STOPS = T.StructType(
    [
        T.StructField("feed_id", S, False),
        T.StructField("stop_id", S, False),
        T.StructField("stop_name", S, True),
        T.StructField("stop_lat", D, True),
        T.StructField("stop_lon", D, True),
        T.StructField("stop_timezone", S, True),
        T.StructField("parent_station", S, True),
    ]
)

STOP_TIMES = T.StructType(
    [
        T.StructField("feed_id", S, False),
        T.StructField("trip_id", S, False),
        T.StructField("stop_id", S, False),
        T.StructField("stop_sequence", I, True),
        T.StructField("departure_s", I, True),
    ]
)

TRIPS = T.StructType(
    [
        T.StructField("feed_id", S, False),
        T.StructField("trip_id", S, False),
        T.StructField("service_id", S, True),
        T.StructField("route_id", S, True),
    ]
)

CALENDAR = T.StructType(
    [
        T.StructField("feed_id", S, False),
        T.StructField("service_id", S, False),
        T.StructField("days", T.ArrayType(I), True),
        T.StructField("start_date", DT, True),
        T.StructField("end_date", DT, True),
    ]
)

CALENDAR_DATES = T.StructType(
    [
        T.StructField("feed_id", S, False),
        T.StructField("service_id", S, False),
        T.StructField("date", DT, True),
        T.StructField("exception_type", I, True),
    ]
)

FILES = T.StructType([T.StructField("feed_id", S, True), T.StructField("file", S, True)])
DAYS = T.StructType(
    [T.StructField(n, S, True) for n in ("feed_id", "service_id")] + [T.StructField(n, L, True) for n in ("block", "flags", "listed", "added", "removed")]
)
HUBS = T.StructType([T.StructField("feed_id", S, True), T.StructField("stop_id", S, True), T.StructField("slices", I, True)])

# Requests (batch API).  ``transports`` NULL means every feed.
PLACES = T.StructType(
    [
        T.StructField("query_id", S, False),
        T.StructField("lat", D, True),
        T.StructField("lon", D, True),
        T.StructField("max_distance", D, True),
    ]
)

REQUESTS_DEST = T.StructType(
    PLACES.fields
    + [
        T.StructField("start_date", DT, True),
        T.StructField("end_date", DT, True),
        T.StructField("transports", T.ArrayType(S), True),
    ]
)

REQUESTS_TRIP = T.StructType(
    [
        T.StructField("query_id", S, False),
        T.StructField("dep_lat", D, True),
        T.StructField("dep_lon", D, True),
        T.StructField("dep_max_distance", D, True),
        T.StructField("arr_lat", D, True),
        T.StructField("arr_lon", D, True),
        T.StructField("arr_max_distance", D, True),
        T.StructField("start_date", DT, True),
        T.StructField("end_date", DT, True),
        T.StructField("min_departure_s", I, True),
        T.StructField("transports", T.ArrayType(S), True),
    ]
)

CITIES = T.StructType(
    [
        T.StructField("city_id", S, False),
        T.StructField("city_name", S, True),
        T.StructField("stop_lat", D, True),
        T.StructField("stop_lon", D, True),
        T.StructField("max_distance", D, True),
        T.StructField("n_stops", L, True),
    ]
)
