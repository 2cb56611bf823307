"""Independent SQL (DuckDB dialect) for every benchmark query.

Written from the operator semantics, not from the Spark plans: windows with
``row_number()`` where Spark uses ``min(struct)``, ``EXISTS`` where Spark
uses semi/anti joins, cross joins where Spark uses grid joins.
"""

from __future__ import annotations

import re

from cityhop.functions.text import NOISE_WORDS
from cityhop.plans.benchmark_queries import ARRIVAL_OFFSETS, CITY_EPS_KM, DENSE_EPS_KM, DENSE_SAMPLES, MIN_DEPARTURE_S, MIN_RADIUS, PERIOD, PLACE_RADIUS, WEEK
from cityhop.sources.testbind_sql import PLACE_LAT, PLACE_LON, weekday_bit, with_ctes


def _d(x: str) -> str:
    return f"DATE '{x}'"


def exact_mean(col: str) -> str:
    """Mean of a DOUBLE column as Spark's avg(DECIMAL(19,15)) computes it:
    exact decimal sum, quotient rounded half-up to 19 decimals, then the
    correctly rounded DOUBLE of that decimal (via its text form; DuckDB's
    numeric DECIMAL<->DOUBLE casts scale in floating point)."""
    si = f"CAST(sum(CAST(CAST({col} AS VARCHAR) AS DECIMAL(38,15))) * 1000000000000000 AS HUGEINT)"
    n = "CAST(count(*) AS HUGEINT)"
    q = f"((2 * abs({si}) * 10000 + {n}) // (2 * {n}))"
    e19 = "CAST('10000000000000000000' AS HUGEINT)"
    txt = (
        f"(CASE WHEN {si} < 0 THEN '-' ELSE '' END || CAST({q} // {e19} AS VARCHAR) || '.' "
        f"|| lpad(CAST({q} % {e19} AS VARCHAR), 19, '0'))"
    )
    return f"CAST({txt} AS DOUBLE)"


def _dist(lat1, lon1, lat2, lon2) -> str:
    return f"sqrt(({lat1} - {lat2}) * ({lat1} - {lat2}) + ({lon1} - {lon2}) * ({lon1} - {lon2}))"


def nearby_cte(places: str = "g_nation_places", radius: str = f"CAST({PLACE_RADIUS} AS DOUBLE)", transports=None) -> str:
    feed_filter = "" if not transports else " AND s.feed_id IN (" + ", ".join(f"'{t}'" for t in transports) + ")"
    return f"""
nearby AS (
  SELECT p.query_id, s.* FROM {places} p JOIN g_sk s
    ON s.boardable{feed_filter}
   AND {_dist('s.stop_lat', 's.stop_lon', 'p.lat', 'p.lon')} < CAST(1.05 AS DOUBLE) * {radius}
)"""


BOARDS_CTE = """
boards AS (
  SELECT query_id, feed_id, trip_id, stop_id AS board_stop_id, stop_sequence AS board_sequence,
         departure_s AS board_departure_s
  FROM (SELECT n.query_id, st.feed_id, st.trip_id, st.stop_id, st.stop_sequence, st.departure_s,
               row_number() OVER (PARTITION BY n.query_id, st.feed_id, st.trip_id
                                  ORDER BY st.stop_sequence, st.departure_s, st.stop_id) AS rn
        FROM g_stop_times st JOIN (SELECT DISTINCT query_id, feed_id, stop_id FROM nearby) n
          ON st.feed_id = n.feed_id AND st.stop_id = n.stop_id) x
  WHERE rn = 1
)"""


def active_cte(start: str, end: str, strict: bool = False) -> str:
    lo = f"greatest(c.start_date, {_d(start)})"
    hi = f"least(c.end_date, {_d(end)})"
    return f"""
period_days AS (
  SELECT CAST(d AS DATE) AS d FROM generate_series({_d(start)}, {_d(end)}, INTERVAL 1 DAY) t(d)
),
svc AS (
  SELECT b.*, t.service_id, f.feed_kind FROM boards b
  JOIN g_trips t ON t.feed_id = b.feed_id AND t.trip_id = b.trip_id
  JOIN g_feeds f ON f.feed_id = b.feed_id
),
active AS (
  SELECT * FROM svc WHERE
    (feed_kind = 'CALENDAR' AND EXISTS (
       SELECT 1 FROM g_calendar c
       WHERE c.feed_id = svc.feed_id AND c.service_id = svc.service_id
         AND c.start_date <= {_d(end)} AND c.end_date >= {_d(start)}
         AND ({'false' if strict else f"date_diff('day', {lo}, {hi}) >= 6"}
              OR EXISTS (SELECT 1 FROM period_days p
                         WHERE p.d BETWEEN c.start_date AND c.end_date AND {weekday_bit('c.mask', 'p.d')} = 1))))
    OR (feed_kind <> 'CALENDAR' AND EXISTS (
       SELECT 1 FROM g_calendar_dates cd
       WHERE cd.feed_id = svc.feed_id AND cd.service_id = svc.service_id
         AND cd.date BETWEEN {_d(start)} AND {_d(end)}))
)"""


def reach_ctes(start: str, end: str, transports=None, places: str = "g_nation_places",
               radius: str = f"CAST({PLACE_RADIUS} AS DOUBLE)", strict: bool = False) -> tuple:
    return (
        nearby_cte(places=places, radius=radius, transports=transports),
        BOARDS_CTE,
        active_cte(start, end, strict),
        """
reached AS (
  SELECT DISTINCT a.query_id, st.feed_id, st.stop_id
  FROM g_stop_times st JOIN active a ON st.feed_id = a.feed_id AND st.trip_id = a.trip_id
  WHERE st.departure_s > a.board_departure_s
),
reached_areas AS (
  SELECT DISTINCT r.query_id, r.feed_id, s.area_id
  FROM reached r JOIN g_sk s ON s.feed_id = r.feed_id AND s.stop_id = r.stop_id AND s.boardable
),
dest AS (
  SELECT * FROM reached_areas ra
  WHERE NOT EXISTS (SELECT 1 FROM nearby o
                    WHERE o.query_id = ra.query_id AND o.feed_id = ra.feed_id AND o.area_id = ra.area_id)
),
dest_stops AS (
  SELECT d.query_id, d.feed_id, s.stop_id, s.stop_name, s.stop_lat, s.stop_lon, s.stop_timezone
  FROM dest d JOIN g_sk s
    ON s.feed_id = d.feed_id AND s.stop_id = d.area_id AND (s.feed_kind <> 'STATION' OR s.parent_station IS NULL)
)""",
    )


def reachable_sql(start: str, end: str, transports=None) -> str:
    return with_ctes(*reach_ctes(start, end, transports)) + """
SELECT query_id, feed_id, stop_id, stop_name, round(stop_lat, 6) AS stop_lat,
       round(stop_lon, 6) AS stop_lon, stop_timezone
FROM dest_stops
"""


def run_dates_cte(start: str, end: str) -> str:
    """Running (feed, service, date) in a period, both calendar kinds."""
    return f"""
run_days AS (
  SELECT CAST(d AS DATE) AS d FROM generate_series({_d(start)}, {_d(end)}, INTERVAL 1 DAY) t(d)
),
run_dates AS (
  SELECT c.feed_id, c.service_id, p.d AS date
  FROM g_calendar c JOIN run_days p ON p.d BETWEEN c.start_date AND c.end_date
  WHERE {weekday_bit('c.mask', 'p.d')} = 1
    AND NOT EXISTS (SELECT 1 FROM g_calendar_dates x
                    WHERE x.feed_id = c.feed_id AND x.service_id = c.service_id AND x.date = p.d)
  UNION
  SELECT cd.feed_id, cd.service_id, cd.date
  FROM g_calendar_dates cd JOIN g_feeds f ON f.feed_id = cd.feed_id
  WHERE f.feed_kind <> 'CALENDAR' AND cd.date BETWEEN {_d(start)} AND {_d(end)}
)"""


def trip_requests_cte() -> str:
    offs = ", ".join(f"({o})" for o in ARRIVAL_OFFSETS)
    lat = PLACE_LAT.replace("n_nationkey", "{k}")
    lon = PLACE_LON.replace("n_nationkey", "{k}")
    return f"""
trip_req AS (
  SELECT 'q' || CAST(dep_k AS VARCHAR) || '-' || CAST(arr_k AS VARCHAR) AS query_id,
         {lat.format(k="dep_k")} AS dep_lat, {lon.format(k="dep_k")} AS dep_lon,
         {lat.format(k="arr_k")} AS arr_lat, {lon.format(k="arr_k")} AS arr_lon
  FROM (SELECT n.n_nationkey AS dep_k, (n.n_nationkey + o.off) % 25 AS arr_k
        FROM nation n CROSS JOIN (VALUES {offs}) o(off)) x
  WHERE arr_k IN (SELECT n_nationkey FROM nation)
)"""


def direct_trips_sql(
    start: str,
    end: str,
    requests_cte: str | None = None,
    after_s: int = MIN_DEPARTURE_S,
    dep_r: str = f"CAST({PLACE_RADIUS} AS DOUBLE)",
    arr_r: str = f"CAST({PLACE_RADIUS} AS DOUBLE)",
    pre: tuple = (),
    recursive: bool = False,
) -> str:
    dep_radius = f"CAST(1.05 AS DOUBLE) * {dep_r}"
    arr_radius = f"CAST(1.05 AS DOUBLE) * {arr_r}"
    hour = (after_s // 3600) * 3600
    return with_ctes(
        *pre,
        requests_cte or trip_requests_cte(),
        run_dates_cte(start, end),
        f"""
dep_near AS (
  SELECT DISTINCT r.query_id, s.feed_id, s.stop_id, s.feed_kind FROM trip_req r JOIN g_sk s
    ON s.boardable AND {_dist('s.stop_lat', 's.stop_lon', 'r.dep_lat', 'r.dep_lon')} < {dep_radius}
),
arr_near AS (
  SELECT DISTINCT r.query_id, s.feed_id, s.stop_id FROM trip_req r JOIN g_sk s
    ON s.boardable AND {_dist('s.stop_lat', 's.stop_lon', 'r.arr_lat', 'r.arr_lon')} < {arr_radius}
),
board_all AS (
  SELECT d.query_id, st.feed_id, st.trip_id, st.stop_id, st.stop_sequence, st.departure_s, d.feed_kind
  FROM g_stop_times st JOIN dep_near d ON st.feed_id = d.feed_id AND st.stop_id = d.stop_id
  WHERE st.departure_s > {hour}
),
board AS (
  SELECT query_id, feed_id, trip_id, stop_id, departure_s FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, feed_id, trip_id
                                 ORDER BY stop_sequence, departure_s, stop_id) AS rn
    FROM board_all WHERE feed_kind = 'CALENDAR') x WHERE rn = 1
  UNION ALL
  SELECT query_id, feed_id, trip_id, stop_id, departure_s FROM board_all WHERE feed_kind <> 'CALENDAR'
),
alight AS (
  SELECT a.query_id, st.feed_id, st.trip_id, st.stop_id, st.departure_s
  FROM g_stop_times st JOIN arr_near a ON st.feed_id = a.feed_id AND st.stop_id = a.stop_id
),
legs AS (
  SELECT b.query_id, b.feed_id, b.trip_id, b.stop_id AS stop_id_x, b.departure_s AS departure_s_x,
         a.stop_id AS stop_id_y, a.departure_s AS departure_s_y
  FROM board b JOIN alight a ON a.query_id = b.query_id AND a.feed_id = b.feed_id AND a.trip_id = b.trip_id
  WHERE b.departure_s < a.departure_s
),
dated AS (
  SELECT l.*, t.service_id, t.route_id, r.date, f.timezone, f.feed_kind, f.feed_priority,
         timezone(f.timezone, CAST(r.date AS TIMESTAMP) + to_seconds(l.departure_s_x)) AS dep_tz,
         timezone(f.timezone, CAST(r.date AS TIMESTAMP) + to_seconds(l.departure_s_y)) AS arr_tz
  FROM legs l
  JOIN g_trips t ON t.feed_id = l.feed_id AND t.trip_id = l.trip_id
  JOIN g_feeds f ON f.feed_id = l.feed_id
  JOIN run_dates r ON r.feed_id = l.feed_id AND r.service_id = t.service_id
),
trips_out AS (
  SELECT d.query_id, d.trip_id, d.service_id, d.route_id, d.date,
         d.stop_id_x, sx.stop_name AS stop_name_x, sx.stop_lat AS stop_lat_x, sx.stop_lon AS stop_lon_x,
         CASE WHEN d.feed_kind = 'CALENDAR' THEN sx.stop_timezone ELSE d.timezone END AS stop_timezone_x,
         d.departure_s_x,
         d.stop_id_y, sy.stop_name AS stop_name_y, sy.stop_lat AS stop_lat_y, sy.stop_lon AS stop_lon_y,
         CASE WHEN d.feed_kind = 'CALENDAR' THEN sy.stop_timezone ELSE d.timezone END AS stop_timezone_y,
         d.departure_s_y,
         timezone('UTC', d.dep_tz) AS dep_time, timezone('UTC', d.arr_tz) AS arr_time,
         d.feed_id AS transport_type, d.feed_priority
  FROM dated d
  JOIN g_sk sx ON sx.feed_id = d.feed_id AND sx.stop_id = d.stop_id_x
  JOIN g_sk sy ON sy.feed_id = d.feed_id AND sy.stop_id = d.stop_id_y
)""",
        recursive=recursive,
    )


TRIP_SELECT = """
SELECT query_id, trip_id, service_id, route_id, strftime(date, '%Y-%m-%d') AS date,
       stop_id_x, stop_name_x, round(stop_lat_x, 6) AS stop_lat_x, round(stop_lon_x, 6) AS stop_lon_x,
       stop_timezone_x, CAST(departure_s_x AS BIGINT) AS departure_s_x,
       stop_id_y, stop_name_y, round(stop_lat_y, 6) AS stop_lat_y, round(stop_lon_y, 6) AS stop_lon_y,
       stop_timezone_y, CAST(departure_s_y AS BIGINT) AS departure_s_y,
       strftime(dep_time, '%Y-%m-%d %H:%M:%S') AS dep_time, strftime(arr_time, '%Y-%m-%d %H:%M:%S') AS arr_time,
       transport_type
FROM trips_out"""


ACTIVITY_CTE = """
counts AS (SELECT feed_id, stop_id, count(*) AS n FROM g_stop_times WHERE trip_id IS NOT NULL GROUP BY feed_id, stop_id),
act AS (
  SELECT s.feed_id, s.stop_id, s.stop_name, s.stop_lat, s.stop_lon, s.stop_timezone, c.n AS number_of_appearance
  FROM g_sk s LEFT JOIN counts c ON c.feed_id = s.feed_id AND c.stop_id = s.stop_id
  WHERE s.feed_kind <> 'STATION'
  UNION ALL
  SELECT s.feed_id, s.stop_id, s.stop_name, s.stop_lat, s.stop_lon, s.stop_timezone, r.n
  FROM g_sk s LEFT JOIN (
      SELECT p.feed_id, p.parent_station AS stop_id, sum(c.n) AS n
      FROM counts c JOIN g_sk p ON p.feed_id = c.feed_id AND p.stop_id = c.stop_id
      WHERE p.feed_kind = 'STATION' AND p.parent_station IS NOT NULL
      GROUP BY p.feed_id, p.parent_station) r
    ON r.feed_id = s.feed_id AND r.stop_id = s.stop_id
  WHERE s.feed_kind = 'STATION' AND s.parent_station IS NULL
)"""

RANKED_CTE = """
first_feed AS (
  SELECT * FROM (
    SELECT a.*, f.feed_priority,
           row_number() OVER (PARTITION BY a.stop_id
                              ORDER BY f.feed_priority, a.feed_id, a.stop_name, a.stop_lat, a.stop_lon) AS rn
    FROM act a JOIN g_feeds f ON f.feed_id = a.feed_id) x WHERE rn = 1
),
totals AS (SELECT stop_id, CAST(sum(coalesce(number_of_appearance, 0)) AS BIGINT) AS total FROM act GROUP BY stop_id),
ranked AS (
  SELECT stop_id, stop_name, stop_lat, stop_lon, feed_id, total AS number_of_appearance FROM (
    SELECT ff.stop_id, ff.stop_name, ff.stop_lat, ff.stop_lon, ff.feed_id, t.total,
           row_number() OVER (PARTITION BY ff.stop_name
                              ORDER BY t.total DESC, ff.stop_id, ff.stop_lat, ff.stop_lon, ff.feed_id) AS rn
    FROM first_feed ff JOIN totals t ON t.stop_id = ff.stop_id) x WHERE rn = 1
)"""


def _hav(a: str, b: str) -> str:
    return (
        f"2 * asin(least(1, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
    )


def cluster_cte(eps_km: float = CITY_EPS_KM) -> str:
    return f"""
pts AS (SELECT stop_id AS id, stop_lat AS lat, stop_lon AS lon FROM ranked),
edges AS (
  SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b
    ON a.id <> b.id AND {_hav('a', 'b')} <= CAST({eps_km!r} AS DOUBLE) / CAST(6371.0 AS DOUBLE)
),
reach(a, b) AS (
  SELECT id, id FROM pts
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
),
comp AS (SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a)"""


def dense_cte(eps_km: float, min_samples: int) -> str:
    """Density clustering from its definition: core points by counting, components of core points, border points."""
    return f"""
pts AS (SELECT stop_id AS id, stop_lat AS lat, stop_lon AS lon FROM ranked),
near AS (
  SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b
    ON a.id = b.id OR {_hav('a', 'b')} <= CAST({eps_km!r} AS DOUBLE) / CAST(6371.0 AS DOUBLE)
),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {min_samples}),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (
  SELECT id, id FROM core
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
comp AS (SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a),
dense AS (
  SELECT id, cluster_id FROM comp
  UNION ALL
  SELECT n.a, min(c.cluster_id) FROM near n JOIN comp c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a
)"""


def cities_cte() -> str:
    noise = ", ".join(f"'{w}'" for w in NOISE_WORDS)
    return f"""
members AS (SELECT r.*, c.cluster_id AS city_id FROM ranked r JOIN comp c ON c.id = r.stop_id),
centre AS (
  SELECT city_id, {exact_mean('stop_lat')} AS clat,
         {exact_mean('stop_lon')} AS clon, count(*) AS n_stops
  FROM members GROUP BY city_id
),
radius AS (
  SELECT m.city_id, max({_dist('m.stop_lat', 'm.stop_lon', 'c.clat', 'c.clon')}) AS max_distance
  FROM members m JOIN centre c ON c.city_id = m.city_id GROUP BY m.city_id
),
mw0 AS (
  SELECT city_id, stop_id, number_of_appearance, regexp_split_to_array(lower(stop_name), '\\s+') AS ws FROM members
),
mwords AS (
  SELECT * FROM (SELECT city_id, stop_id, number_of_appearance, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM mw0) x
  WHERE word <> '' AND word NOT IN ({noise})
),
wc AS (
  SELECT city_id, word, count(*) AS freq,
         arg_min(struct_pack(neg := -number_of_appearance, sid := stop_id, pos := pos),
                 struct_pack(neg := -number_of_appearance, sid := stop_id, pos := pos)) AS f
  FROM mwords GROUP BY city_id, word
),
nn AS (SELECT city_id, count(*) AS n_names FROM members GROUP BY city_id),
top AS (
  SELECT city_id, stop_name FROM (
    SELECT city_id, stop_name, row_number() OVER (PARTITION BY city_id ORDER BY number_of_appearance DESC, stop_id) AS rn
    FROM members) x WHERE rn = 1
),
kept AS (
  SELECT wc.city_id, string_agg(wc.word, ' ' ORDER BY wc.f.neg, wc.f.sid, wc.f.pos, wc.word) AS joined
  FROM wc JOIN nn ON nn.city_id = wc.city_id
  WHERE wc.freq >= floor(nn.n_names * CAST(0.5 AS DOUBLE))
  GROUP BY wc.city_id
),
cities AS (
  SELECT c.city_id,
         CASE WHEN coalesce(k.joined, '') = '' THEN t.stop_name
              ELSE upper(substr(k.joined, 1, 1)) || lower(substr(k.joined, 2)) END AS city_name,
         c.clat AS stop_lat, c.clon AS stop_lon, r.max_distance, c.n_stops
  FROM centre c JOIN radius r ON r.city_id = c.city_id JOIN top t ON t.city_id = c.city_id
  LEFT JOIN kept k ON k.city_id = c.city_id
)"""


CITY_CTES = (ACTIVITY_CTE, RANKED_CTE)


def customer_points_cte() -> str:
    lat = PLACE_LAT.replace("n_nationkey", "c_nationkey")
    lon = PLACE_LON.replace("n_nationkey", "c_nationkey")
    return f"""
cpoints AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS query_id,
         ({lat}) + CAST(c_custkey % 9 - 4 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS lat,
         ({lon}) + CAST(c_custkey % 7 - 3 AS DOUBLE) * CAST(0.03 AS DOUBLE) AS lon
  FROM customer
)"""


def snap_cte(points: str = "cpoints", name: str = "snap") -> str:
    return f"""
{name} AS (
  SELECT query_id, city_id, city_name, lat, lon, max_distance, distance FROM (
    SELECT p.query_id, c.city_id, c.city_name, c.stop_lat AS lat, c.stop_lon AS lon, c.max_distance,
           {_dist('c.stop_lat', 'c.stop_lon', 'p.lat', 'p.lon')} AS distance,
           row_number() OVER (PARTITION BY p.query_id
                              ORDER BY {_dist('c.stop_lat', 'c.stop_lon', 'p.lat', 'p.lon')}, c.city_id) AS rn
    FROM {points} p JOIN cities c
      ON {_dist('c.stop_lat', 'c.stop_lon', 'p.lat', 'p.lon')} < CAST(0.1 AS DOUBLE)) x
  WHERE rn = 1
)"""


SNAP_CTE = snap_cte()
CITY_ALL = (ACTIVITY_CTE, RANKED_CTE, cluster_cte(), cities_cte())


def matched_cte() -> str:
    return f"""
matched AS (
  SELECT query_id, city_id, transport FROM (
    SELECT ds.query_id, c.city_id, ds.feed_id AS transport,
           row_number() OVER (PARTITION BY ds.query_id, c.city_id ORDER BY f.feed_priority, ds.feed_id) AS rn
    FROM dest_stops ds JOIN cities c
      ON {_dist('ds.stop_lat', 'ds.stop_lon', 'c.stop_lat', 'c.stop_lon')} <= c.max_distance
    JOIN g_feeds f ON f.feed_id = ds.feed_id) x
  WHERE rn = 1
)"""


CITY_OUT = """round(c.stop_lat, 6) AS stop_lat, round(c.stop_lon, 6) AS stop_lon,
       round(c.max_distance, 6) AS max_distance, m.transport"""


def reachable_cities_sql(strict: bool = False, radius: str = "p.max_distance") -> str:
    places = """
dep_places AS (SELECT DISTINCT city_id AS query_id, lat, lon, max_distance FROM snap)"""
    return with_ctes(
        *CITY_ALL, customer_points_cte(), SNAP_CTE, places,
        *reach_ctes(*WEEK, places="dep_places", radius=radius, strict=strict), matched_cte(), recursive=True,
    ) + f"""
SELECT s.query_id, m.city_id, c.city_name, {CITY_OUT}
FROM snap s JOIN matched m ON m.query_id = s.city_id JOIN cities c ON c.city_id = m.city_id"""


def reachability_matrix_sql() -> str:
    pts = """
city_pts AS (SELECT city_id AS query_id, stop_lat AS lat, stop_lon AS lon FROM cities)"""
    places = """
dep_places AS (SELECT DISTINCT city_id AS query_id, lat, lon, max_distance FROM snap)"""
    return with_ctes(
        *CITY_ALL, pts, snap_cte("city_pts"), places,
        *reach_ctes(*WEEK, places="dep_places", radius="p.max_distance"), matched_cte(), recursive=True,
    ) + f"""
SELECT s.query_id AS dep_city_id, m.city_id, c.city_name, {CITY_OUT}
FROM snap s JOIN matched m ON m.query_id = s.city_id JOIN cities c ON c.city_id = m.city_id"""


def customer_trips_ctes() -> tuple:
    lat = PLACE_LAT.replace("n_nationkey", "{k}")
    lon = PLACE_LON.replace("n_nationkey", "{k}")
    dlat = "CAST(c_custkey % 9 - 4 AS DOUBLE) * CAST(0.02 AS DOUBLE)"
    dlon = "CAST(c_custkey % 7 - 3 AS DOUBLE) * CAST(0.03 AS DOUBLE)"
    return (
        f"""
creq AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS query_id,
         ({lat.format(k="c_nationkey")}) + {dlat} AS dep_lat, ({lon.format(k="c_nationkey")}) + {dlon} AS dep_lon,
         ({lat.format(k="((c_nationkey + 1) % 25)")}) + {dlat} AS arr_lat,
         ({lon.format(k="((c_nationkey + 1) % 25)")}) + {dlon} AS arr_lon
  FROM customer
)""",
        "dpts AS (SELECT query_id, dep_lat AS lat, dep_lon AS lon FROM creq)",
        "apts AS (SELECT query_id, arr_lat AS lat, arr_lon AS lon FROM creq)",
        snap_cte("dpts", "snap_d"),
        snap_cte("apts", "snap_a"),
        """
creq_keyed AS (
  SELECT c.query_id, d.city_id || '|' || a.city_id AS pair, d.lat AS dep_lat, d.lon AS dep_lon, d.max_distance AS dep_r,
         a.lat AS arr_lat, a.lon AS arr_lon, a.max_distance AS arr_r
  FROM creq c JOIN snap_d d ON d.query_id = c.query_id JOIN snap_a a ON a.query_id = c.query_id
)""",
    )


TRIP_REQ_FROM_PAIRS = """
trip_req AS (SELECT DISTINCT pair AS query_id, dep_lat, dep_lon, dep_r, arr_lat, arr_lon, arr_r FROM creq_keyed)"""

W3_CTE = """
w3 AS (
  SELECT * FROM (
    SELECT t.*, row_number() OVER (PARTITION BY query_id, dep_time
                                   ORDER BY feed_priority, trip_id, stop_id_x, stop_id_y, arr_time) AS rn3
    FROM trips_out t) x
  WHERE rn3 = 1
)"""


def search_trips_ctes() -> str:
    return direct_trips_sql(
        *PERIOD, requests_cte=TRIP_REQ_FROM_PAIRS, dep_r="r.dep_r", arr_r="r.arr_r",
        pre=CITY_ALL + customer_trips_ctes(), recursive=True,
    ).rstrip() + ",\n" + W3_CTE.strip() + ",\n" + """found AS (
  SELECT k.query_id AS cq, w.* FROM creq_keyed k JOIN w3 w ON w.query_id = k.pair
)
"""


def search_trips_sql() -> str:
    return search_trips_ctes() + TRIP_SELECT.replace("FROM trips_out", "FROM (SELECT * EXCLUDE (query_id) RENAME (cq AS query_id) FROM found) t")


def ordered_trips_sql() -> str:
    """Trips that agree in both instants are one; their place in the order of departure."""
    both = search_trips_sql().replace("PARTITION BY query_id, dep_time\n", "PARTITION BY query_id, dep_time, arr_time\n")
    head, select = both[: both.rindex("SELECT query_id")], both[both.rindex("SELECT query_id") :]
    return head + f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dep_time, arr_time, trip_id, stop_id_x, stop_id_y) AS place
FROM ({select}) o"""


PRESENT_SELECT = """
SELECT query_id, CAST(rank AS BIGINT) AS rank, trip_id, transport_type, stop_name_x, stop_name_y,
       strftime(dep_time, '%Y-%m-%d %H:%M:%S') AS dep_time, strftime(arr_time, '%Y-%m-%d %H:%M:%S') AS arr_time,
       strftime(timezone(stop_timezone_x, timezone('UTC', dep_time)), '%Hh%M') AS dep_clock,
       strftime(timezone(stop_timezone_y, timezone('UTC', arr_time)), '%Hh%M') AS arr_clock,
       strftime(timezone(feed_tz, timezone('UTC', dep_time)), '%d-%m') AS dep_day,
       strftime(timezone(feed_tz, timezone('UTC', arr_time)), '%d-%m') AS arr_day,
       CAST(day(timezone(feed_tz, timezone('UTC', dep_time))) <> day(timezone(feed_tz, timezone('UTC', arr_time))) AS BIGINT) AS overnight,
       CAST(dur AS BIGINT) AS duration_s, CAST(floor(dur / 86400) AS BIGINT) AS duration_days,
       printf('%02dh%02d', CAST((dur // 3600) % 24 AS INTEGER), CAST((dur // 60) % 60 AS INTEGER)) AS duration_hhmm,
       CAST((off_x <> off_y) OR (off_x <> off_display) AS BIGINT) AS show_timezone
FROM (
  SELECT f.*, g.timezone AS feed_tz, date_diff('second', f.dep_time, f.arr_time) AS dur,
         date_diff('second', f.dep_time, timezone(f.stop_timezone_x, timezone('UTC', f.dep_time))) AS off_x,
         date_diff('second', f.arr_time, timezone(f.stop_timezone_y, timezone('UTC', f.arr_time))) AS off_y,
         date_diff('second', TIMESTAMP '{as_of}', timezone('Europe/Paris', timezone('UTC', TIMESTAMP '{as_of}'))) AS off_display,
         row_number() OVER (PARTITION BY f.cq ORDER BY f.dep_time, f.arr_time, f.trip_id, f.stop_id_x, f.stop_id_y) AS rank
  FROM found f JOIN g_feeds g ON g.feed_id = f.transport_type
) x
WHERE rank <= 10"""


def present_trips_sql(as_of: str) -> str:
    return search_trips_ctes() + PRESENT_SELECT.replace("SELECT query_id,", "SELECT cq AS query_id,", 1).format(as_of=as_of)


def od_frequency_sql() -> str:
    hour = (MIN_DEPARTURE_S // 3600) * 3600
    radius = "CAST(1.05 AS DOUBLE) * c.max_distance"
    body = f"""
near AS (
  SELECT DISTINCT c.city_id, s.feed_id, s.stop_id, s.feed_kind FROM cities c JOIN g_sk s
    ON s.boardable AND {_dist('s.stop_lat', 's.stop_lon', 'c.stop_lat', 'c.stop_lon')} < {radius}
),
board_all AS (
  SELECT n.city_id, st.feed_id, st.trip_id, st.stop_id, st.stop_sequence, st.departure_s, n.feed_kind
  FROM g_stop_times st JOIN near n ON st.feed_id = n.feed_id AND st.stop_id = n.stop_id
  WHERE st.departure_s > {hour}
),
board AS (
  SELECT city_id, feed_id, trip_id, stop_id, departure_s FROM (
    SELECT *, row_number() OVER (PARTITION BY city_id, feed_id, trip_id ORDER BY stop_sequence, departure_s, stop_id) AS rn
    FROM board_all WHERE feed_kind = 'CALENDAR') x WHERE rn = 1
  UNION ALL
  SELECT city_id, feed_id, trip_id, stop_id, departure_s FROM board_all WHERE feed_kind <> 'CALENDAR'
),
alight AS (
  SELECT n.city_id, st.feed_id, st.trip_id, st.stop_id, st.departure_s
  FROM g_stop_times st JOIN near n ON st.feed_id = n.feed_id AND st.stop_id = n.stop_id
),
legs AS (
  SELECT b.city_id AS dep_city, a.city_id AS arr_city, b.feed_id, b.trip_id, b.stop_id AS stop_id_x,
         b.departure_s AS departure_s_x, a.stop_id AS stop_id_y, a.departure_s AS departure_s_y
  FROM board b JOIN alight a ON a.feed_id = b.feed_id AND a.trip_id = b.trip_id
  WHERE b.departure_s < a.departure_s
),
dated AS (
  SELECT l.*, t.service_id, r.date, f.feed_priority,
         timezone('UTC', timezone(f.timezone, CAST(r.date AS TIMESTAMP) + to_seconds(l.departure_s_x))) AS dep_time,
         timezone('UTC', timezone(f.timezone, CAST(r.date AS TIMESTAMP) + to_seconds(l.departure_s_y))) AS arr_time
  FROM legs l
  JOIN g_trips t ON t.feed_id = l.feed_id AND t.trip_id = l.trip_id
  JOIN g_feeds f ON f.feed_id = l.feed_id
  JOIN run_dates r ON r.feed_id = l.feed_id AND r.service_id = t.service_id
),
w3 AS (
  SELECT * FROM (
    SELECT d.*, row_number() OVER (PARTITION BY dep_city, arr_city, dep_time
                                   ORDER BY feed_priority, trip_id, stop_id_x, stop_id_y, arr_time) AS rn3
    FROM dated d) x
  WHERE rn3 = 1
)"""
    return with_ctes(*CITY_ALL, run_dates_cte(*PERIOD), body, recursive=True) + """
SELECT dep_city AS dep_city_id, arr_city AS arr_city_id, strftime(date, '%Y-%m-%d') AS date,
       CAST(count(*) AS BIGINT) AS n_trips, CAST(min(date_diff('second', dep_time, arr_time)) AS BIGINT) AS min_duration_s,
       strftime(min(dep_time), '%Y-%m-%d %H:%M:%S') AS first_dep_time
FROM w3 GROUP BY dep_city, arr_city, date"""


def feed_freshness_sql(as_of: str) -> str:
    return with_ctes(f"""
fdates AS (
  SELECT c.feed_id, c.end_date AS d FROM g_calendar c JOIN g_feeds f ON f.feed_id = c.feed_id WHERE f.feed_kind = 'CALENDAR'
  UNION ALL
  SELECT cd.feed_id, cd.date FROM g_calendar_dates cd JOIN g_feeds f ON f.feed_id = cd.feed_id WHERE f.feed_kind <> 'CALENDAR'
),
agg AS (
  SELECT feed_id, count(*) AS n, avg(CASE WHEN d > {_d(as_of)} THEN 1.0 ELSE 0.0 END) AS share FROM fdates GROUP BY feed_id
)""") + """
SELECT f.feed_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_dates, round(CAST(a.share AS DOUBLE), 6) AS share_future,
       CAST(a.share IS NULL OR a.share < 0.8 AS BIGINT) AS stale
FROM g_feeds f LEFT JOIN agg a ON a.feed_id = f.feed_id"""


def request_validation_sql() -> str:
    raw = """
raw AS (
  SELECT 'o' || CAST(o.o_orderkey AS VARCHAR) AS query_id, p.lat, p.lon,
         CASE WHEN o.o_orderkey % 11 = 0 THEN strftime(o.o_orderdate, '%Y/%m/%d %H:%M')
              ELSE strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS s_raw,
         strftime(o.o_orderdate + to_days(CAST(o.o_orderkey % 5 - 1 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS e_raw
  FROM orders o JOIN cpoints p ON p.query_id = 'c' || CAST(o.o_custkey AS VARCHAR)
),
rpts AS (SELECT query_id, lat, lon FROM raw),
parsed AS (
  SELECT query_id, try_strptime(s_raw, '%Y-%m-%dT%H:%M:%S') AS s, try_strptime(e_raw, '%Y-%m-%dT%H:%M:%S') AS e FROM raw
)"""
    return with_ctes(*CITY_ALL, customer_points_cte(), raw, snap_cte("rpts", "rsnap"), recursive=True) + """
SELECT p.query_id, strftime(CAST(p.s AS DATE), '%Y-%m-%d') AS start_date, strftime(CAST(p.e AS DATE), '%Y-%m-%d') AS end_date,
       CASE WHEN p.s IS NULL OR p.e IS NULL THEN 'bad_time'
            WHEN p.e < p.s THEN 'end_before_start'
            WHEN r.city_id IS NULL THEN 'unknown_place' END AS error,
       r.city_id
FROM parsed p LEFT JOIN rsnap r ON r.query_id = p.query_id"""


def load_feeds_csv_sql() -> str:
    """The bound tables less what the text feeds' malformed values take away."""
    turned = "CAST(service_id AS BIGINT) % 19 = 5"
    low, high = f"CASE WHEN {turned} THEN end_date ELSE start_date END", f"CASE WHEN {turned} THEN start_date ELSE end_date END"
    return with_ctes() + f"""
SELECT feed_id, 'feeds' AS table_name, feed_kind AS key, timezone AS other, CAST(feed_priority AS BIGINT) AS first_number,
       CAST(NULL AS BIGINT) AS second_number, CAST(NULL AS VARCHAR) AS text FROM g_feeds
UNION ALL
SELECT feed_id, 'stops', stop_id, parent_station,
       CASE WHEN feed_id = 'F1' AND TRY_CAST(stop_id AS BIGINT) % 13 = 4 THEN NULL ELSE CAST(round(stop_lat * 1000000) AS BIGINT) END,
       CAST(round(stop_lon * 1000000) AS BIGINT),
       concat_ws('|', stop_name || CASE WHEN feed_id = 'F2' THEN ', "quai"' ELSE '' END, CASE WHEN feed_id = 'F0' THEN stop_timezone END) FROM g_stops
UNION ALL
SELECT feed_id, 'stop_times', trip_id, stop_id,
       CASE WHEN CAST(trip_id AS BIGINT) % 43 = 5 AND stop_sequence = 1 THEN NULL ELSE stop_sequence END,
       CASE WHEN CAST(trip_id AS BIGINT) % 41 = 11 AND stop_sequence = 2 THEN NULL ELSE departure_s END, NULL FROM g_stop_times
UNION ALL
SELECT feed_id, 'trips', trip_id, service_id, NULL, NULL, route_id FROM g_trips
UNION ALL
SELECT feed_id, 'calendar', service_id, array_to_string(list_transform(range(7), lambda i: (mask >> i) & 1), ''), NULL, NULL,
       strftime(start_date, '%Y-%m-%d') || '..' || strftime(end_date, '%Y-%m-%d')
FROM g_calendar WHERE CAST(service_id AS BIGINT) % 17 <> 3 AND {low} <= {high}
UNION ALL
SELECT feed_id, 'calendar_dates', service_id, strftime(date, '%Y-%m-%d'), CASE WHEN CAST(service_id AS BIGINT) % 29 <> 1 THEN exception_type END, NULL, NULL
FROM g_calendar_dates WHERE CAST(service_id AS BIGINT) % 23 <> 7"""


def load_rejects_sql() -> str:
    day = "strftime({}, '%Y%m%d')"
    return with_ctes() + f"""
SELECT feed_id, 'stops' AS table_name, 'stop_lat' AS column_name, stop_id AS row_key, 'n/a' AS raw, 'bad_number' AS reason, CAST(0 AS BIGINT) AS rejected
FROM g_stops WHERE feed_id = 'F1' AND TRY_CAST(stop_id AS BIGINT) % 13 = 4
UNION ALL
SELECT feed_id, 'stop_times', 'departure_time', trip_id || '/' || stop_id, '7h30', 'bad_clock', 0
FROM g_stop_times WHERE CAST(trip_id AS BIGINT) % 41 = 11 AND stop_sequence = 2
UNION ALL
SELECT feed_id, 'stop_times', 'stop_sequence', trip_id || '/' || stop_id, 'two', 'bad_number', 0
FROM g_stop_times WHERE CAST(trip_id AS BIGINT) % 43 = 5 AND stop_sequence = 1
UNION ALL
SELECT feed_id, 'calendar', 'start_date', service_id, '20241301', 'bad_date', 1 FROM g_calendar WHERE CAST(service_id AS BIGINT) % 17 = 3
UNION ALL
SELECT feed_id, 'calendar', 'end_date', service_id, {day.format('end_date')} || '..' || {day.format('start_date')}, 'end_before_start', 1
FROM g_calendar WHERE CAST(service_id AS BIGINT) % 17 <> 3 AND CAST(service_id AS BIGINT) % 19 = 5 AND end_date > start_date
UNION ALL
SELECT feed_id, 'calendar_dates', 'date', service_id, strftime(date, '%Y/%m/%d'), 'bad_date', 1
FROM g_calendar_dates WHERE CAST(service_id AS BIGINT) % 23 = 7
UNION ALL
SELECT feed_id, 'calendar_dates', 'exception_type', service_id, 'x', 'bad_number', 0 FROM g_calendar_dates WHERE CAST(service_id AS BIGINT) % 29 = 1"""


def trip_request_validation_sql() -> str:
    iso = "'%Y-%m-%dT%H:%M:%S'"
    raw = f"""
raw AS (
  SELECT 'o' || CAST(o.o_orderkey AS VARCHAR) AS query_id, p.dep_lat, p.dep_lon,
         CASE WHEN o_orderkey % 10 = 9 THEN CAST(48.8566 AS DOUBLE) ELSE p.arr_lat + CASE WHEN o_orderkey % 7 = 3 THEN 30 ELSE 0 END END AS arr_lat,
         CASE WHEN o_orderkey % 10 = 9 THEN CAST(2.3522 AS DOUBLE) ELSE p.arr_lon END AS arr_lon,
         CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M') ELSE strftime(o_orderdate, {iso}) END AS s_raw,
         strftime(o_orderdate + to_days(CAST(o_orderkey % 6 - 1 AS INTEGER)), {iso}) AS e_raw,
         CASE WHEN o_orderkey % 13 = 1 THEN '6h30' WHEN o_orderkey % 13 = 2 THEN '06:00:00'
              ELSE printf('%02d:%02d:00', o_orderkey % 24, o_orderkey % 60) END AS t_raw
  FROM orders o JOIN creq p ON p.query_id = 'c' || CAST(o.o_custkey AS VARCHAR)
),
tdep AS (SELECT query_id, dep_lat AS lat, dep_lon AS lon FROM raw),
tarr AS (SELECT query_id, arr_lat AS lat, arr_lon AS lon FROM raw),
parsed AS (
  SELECT query_id, s_raw, e_raw, t_raw, try_strptime(s_raw, {iso}) AS s, try_strptime(e_raw, {iso}) AS e,
         try_strptime('2000-10-10T' || t_raw, {iso}) AS t FROM raw
)"""
    creq = customer_trips_ctes()[0]
    return with_ctes(*CITY_ALL, creq, raw, snap_cte("tdep", "dsnap"), snap_cte("tarr", "asnap"), recursive=True) + """
, judged AS (
  SELECT p.*, d.city_id AS dep_city, a.city_id AS arr_city,
         CASE WHEN s IS NULL THEN 'start' WHEN e IS NULL THEN 'end' WHEN e < s THEN 'end' WHEN t IS NULL THEN 'dep_time'
              WHEN d.city_id IS NULL THEN 'dep_place' WHEN a.city_id IS NULL THEN 'arr_place' END AS field,
         CASE WHEN s IS NULL OR e IS NULL THEN 'bad_time' WHEN e < s THEN 'end_before_start' WHEN t IS NULL THEN 'bad_time'
              WHEN d.city_id IS NULL OR a.city_id IS NULL THEN 'unknown_place' END AS reason
  FROM parsed p LEFT JOIN dsnap d ON d.query_id = p.query_id LEFT JOIN asnap a ON a.query_id = p.query_id
)
SELECT query_id, strftime(CAST(s AS DATE), '%Y-%m-%d') AS start_date, strftime(CAST(e AS DATE), '%Y-%m-%d') AS end_date,
       CAST(hour(t) * 3600 + minute(t) * 60 + second(t) AS BIGINT) AS min_departure_s, dep_city, arr_city, field, reason,
       CASE WHEN reason = 'end_before_start' THEN s_raw || '..' || e_raw
            WHEN reason = 'bad_time' THEN CASE field WHEN 'start' THEN s_raw WHEN 'end' THEN e_raw ELSE t_raw END END AS raw
FROM judged"""


SQL = {
    "load_stop_times": with_ctes()
    + """
SELECT feed_id, trip_id, stop_id, CAST(stop_sequence AS BIGINT) AS stop_sequence,
       CAST(departure_s AS BIGINT) AS departure_s
FROM g_stop_times""",
    "load_calendar": with_ctes()
    + """
SELECT feed_id, service_id,
       concat_ws(',', mask & 1, (mask >> 1) & 1, (mask >> 2) & 1, (mask >> 3) & 1, (mask >> 4) & 1,
                 (mask >> 5) & 1, (mask >> 6) & 1) AS days,
       strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date
FROM g_calendar""",
    "nearby_stops": with_ctes(nearby_cte())
    + """
SELECT query_id, feed_id, stop_id, stop_name, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, area_id
FROM nearby""",
    "trips_nearby": with_ctes(nearby_cte(), BOARDS_CTE)
    + """
SELECT query_id, feed_id, trip_id, board_stop_id, CAST(board_sequence AS BIGINT) AS board_sequence,
       CAST(board_departure_s AS BIGINT) AS board_departure_s
FROM boards""",
    "trips_in_period": with_ctes(nearby_cte(), BOARDS_CTE, active_cte(*PERIOD))
    + """
SELECT query_id, feed_id, trip_id, board_stop_id, CAST(board_sequence AS BIGINT) AS board_sequence,
       CAST(board_departure_s AS BIGINT) AS board_departure_s, service_id
FROM active""",
    "reachable_stops": reachable_sql(*PERIOD),
    "reachable_stops_week": reachable_sql(*WEEK),
    "reachable_stops_calendar": reachable_sql("2024-01-03", "2024-01-05", ["F0"]),
    "reachable_stops_station": reachable_sql("2024-01-20", "2024-01-20", ["F2"]),
    "service_dates": with_ctes(run_dates_cte(*WEEK))
    + """
SELECT r.feed_id, r.service_id, strftime(r.date, '%Y-%m-%d') AS date
FROM run_dates r WHERE EXISTS (SELECT 1 FROM g_trips t WHERE t.feed_id = r.feed_id AND t.service_id = r.service_id)""",
    "direct_trips": direct_trips_sql(*PERIOD) + TRIP_SELECT,
    "direct_trips_week": direct_trips_sql(*WEEK) + TRIP_SELECT,
    "stop_activity": with_ctes(ACTIVITY_CTE)
    + """
SELECT feed_id, stop_id, stop_name, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, stop_timezone,
       CAST(number_of_appearance AS BIGINT) AS number_of_appearance
FROM act""",
    "ranked_stops": with_ctes(*CITY_CTES)
    + """
SELECT stop_id, stop_name, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, feed_id,
       CAST(number_of_appearance AS BIGINT) AS number_of_appearance
FROM ranked""",
    "cluster_stops": with_ctes(*CITY_CTES, cluster_cte(), recursive=True)
    + """
SELECT r.stop_id, r.stop_name, c.cluster_id AS city_id FROM ranked r JOIN comp c ON c.id = r.stop_id""",
    "cluster_stops_dense": with_ctes(*CITY_CTES, dense_cte(DENSE_EPS_KM, DENSE_SAMPLES), recursive=True)
    + """
SELECT r.stop_id, r.stop_name, d.cluster_id AS city_id FROM ranked r LEFT JOIN dense d ON d.id = r.stop_id""",
    "cities": with_ctes(*CITY_CTES, cluster_cte(), cities_cte(), recursive=True)
    + """
SELECT city_id, city_name, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon,
       round(max_distance, 6) AS max_distance, CAST(n_stops AS BIGINT) AS n_stops
FROM cities""",
    "city_center": with_ctes(*CITY_CTES, cluster_cte(), cities_cte(), recursive=True)
    + f"""
SELECT round({exact_mean('stop_lat')}, 6) AS x,
       round({exact_mean('stop_lon')}, 6) AS y
FROM (SELECT DISTINCT stop_lat, stop_lon FROM cities) d""",
    "snap_to_city": with_ctes(*CITY_CTES, cluster_cte(), cities_cte(), customer_points_cte(), snap_cte(), recursive=True)
    + """
SELECT query_id, city_id, city_name, round(lat, 6) AS lat, round(lon, 6) AS lon,
       round(max_distance, 6) AS max_distance, round(distance, 6) AS distance
FROM snap""",
    "reachable_cities": reachable_cities_sql(),
    "reachability_matrix": reachability_matrix_sql(),
    "search_trips": search_trips_sql(),
    "present_trips": present_trips_sql("2024-01-20 12:00:00"),
    "od_frequency": od_frequency_sql(),
    "feed_freshness": feed_freshness_sql("2024-01-20"),
    "transports": with_ctes()
    + """
SELECT feed_id, CAST(feed_priority AS BIGINT) AS feed_priority FROM g_feeds f
WHERE EXISTS (SELECT 1 FROM g_trips t WHERE t.feed_id = f.feed_id)""",
    "request_validation": request_validation_sql(),
    "load_feeds_csv": load_feeds_csv_sql(),
    "load_rejects": load_rejects_sql(),
    "trip_request_validation": trip_request_validation_sql(),
    "reachable_cities_strict": reachable_cities_sql(strict=True, radius=f"CASE WHEN 1.05 * p.max_distance < {MIN_RADIUS} THEN CAST({MIN_RADIUS} AS DOUBLE) / CAST(1.05 AS DOUBLE) ELSE p.max_distance END"),
    "ordered_trips": ordered_trips_sql(),
}


def _materialized(sql: str) -> str:
    """Shared CTEs evaluated once: DuckDB would otherwise inline each reference and never finish the deep ones."""
    return re.sub(r"(?m)(^|,\s|WITH\s)(\w+) AS \((?=\s*SELECT)", r"\1\2 AS MATERIALIZED (", sql)


SQL = {name: sql if "RECURSIVE" in sql else _materialized(sql) for name, sql in SQL.items()}
