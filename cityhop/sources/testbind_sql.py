"""The benchmark-table binding of :mod:`cityhop.sources.testbind`, in ANSI SQL.

Used as the independent oracle: DuckDB runs these CTEs over the same
parquet tables (registered as views named after the tables).  Integer
division is ``//``; decimal literals are cast to DOUBLE so both engines run
the same IEEE operations.
"""

from __future__ import annotations

NATION_LAT = "CAST(44.0 AS DOUBLE) + CAST({k} // 5 AS DOUBLE) * CAST(0.9 AS DOUBLE)"
NATION_LON = "CAST(-1.0 AS DOUBLE) + CAST({k} % 5 AS DOUBLE) * CAST(1.2 AS DOUBLE)"
SUPP_LAT = "(" + NATION_LAT.format(k="s_nationkey") + ") + CAST(s_suppkey % 7 AS DOUBLE) * CAST(0.02 AS DOUBLE)"
SUPP_LON = "(" + NATION_LON.format(k="s_nationkey") + ") + CAST(s_suppkey % 11 AS DOUBLE) * CAST(0.03 AS DOUBLE)"
PLACE_LAT = "(" + NATION_LAT.format(k="n_nationkey") + ") + CAST(0.06 AS DOUBLE)"
PLACE_LON = "(" + NATION_LON.format(k="n_nationkey") + ") + CAST(0.15 AS DOUBLE)"

BASE_CTES = f"""
g_feeds AS (
  SELECT * FROM (VALUES ('F0', 0, 'CALENDAR', 'UTC'), ('F1', 1, 'DATES', 'Europe/Paris'),
                        ('F2', 2, 'STATION', 'Europe/Paris')) t(feed_id, feed_priority, feed_kind, timezone)
),
g_plat AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS stop_id,
         'Gare de ' || n_name || ' ' || CAST(s_suppkey % 20 AS VARCHAR) AS stop_name,
         {SUPP_LAT} AS stop_lat, {SUPP_LON} AS stop_lon,
         'N' || CAST(s_nationkey AS VARCHAR) AS station
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
g_stops AS (
  SELECT 'F0' AS feed_id, stop_id, stop_name, stop_lat, stop_lon, 'Europe/Paris' AS stop_timezone,
         CAST(NULL AS VARCHAR) AS parent_station FROM g_plat
  UNION ALL SELECT 'F1', stop_id, stop_name, stop_lat, stop_lon, NULL, NULL FROM g_plat
  UNION ALL SELECT 'F2', stop_id, stop_name, stop_lat, stop_lon, NULL, station FROM g_plat
  UNION ALL SELECT 'F2', 'N' || CAST(n_nationkey AS VARCHAR), 'Gare de ' || n_name,
                   {NATION_LAT.format(k="n_nationkey")}, {NATION_LON.format(k="n_nationkey")}, NULL, NULL
            FROM nation
),
g_sk AS (
  SELECT s.feed_id, s.stop_id, s.stop_name, s.stop_lat, s.stop_lon,
         COALESCE(NULLIF(TRIM(s.stop_timezone), ''), f.timezone) AS stop_timezone,
         s.parent_station, f.feed_kind, f.feed_priority, f.timezone,
         (f.feed_kind <> 'STATION' OR s.parent_station IS NOT NULL) AS boardable,
         CASE WHEN f.feed_kind = 'STATION' THEN s.parent_station ELSE s.stop_id END AS area_id
  FROM g_stops s JOIN g_feeds f USING (feed_id)
),
g_trips AS (
  SELECT 'F' || CAST(o_orderkey % 3 AS VARCHAR) AS feed_id, CAST(o_orderkey AS VARCHAR) AS trip_id,
         CAST(o_custkey AS VARCHAR) AS service_id, CAST(o_custkey % 50 AS VARCHAR) AS route_id
  FROM orders
),
g_stop_times AS (
  SELECT 'F' || CAST(l_orderkey % 3 AS VARCHAR) AS feed_id, CAST(l_orderkey AS VARCHAR) AS trip_id,
         CAST(l_suppkey AS VARCHAR) AS stop_id, CAST(seq AS INTEGER) AS stop_sequence,
         CAST(((l_orderkey * 37) % 1380) * 60 + seq * 1500 AS INTEGER) AS departure_s
  FROM (SELECT l_orderkey, l_suppkey,
               row_number() OVER (PARTITION BY l_orderkey
                                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
        FROM lineitem) x
),
g_calendar AS (
  SELECT 'F0' AS feed_id, CAST(c_custkey AS VARCHAR) AS service_id, CAST(c_custkey % 128 AS INTEGER) AS mask,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) + CAST(c_custkey % 13 AS INTEGER) AS DATE) AS end_date
  FROM customer
),
g_calendar_dates AS (
  SELECT f.feed_id, e.service_id, e.date, 1 AS exception_type
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS service_id, CAST(ts AS DATE) AS date FROM events) e
  CROSS JOIN (VALUES ('F1'), ('F2')) f(feed_id)
  UNION ALL
  SELECT 'F0', CAST(c_custkey AS VARCHAR),
         CAST(DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) + CAST(c_custkey % 7 AS INTEGER) AS DATE), 2
  FROM customer WHERE c_custkey % 3 = 0
),
g_nation_places AS (
  SELECT 'q' || CAST(n_nationkey AS VARCHAR) AS query_id, {PLACE_LAT} AS lat, {PLACE_LON} AS lon
  FROM nation
)"""


def weekday_bit(mask: str, date: str) -> str:
    """Flag of ``date`` in a Mon..Sun bit mask (bit 0 = Monday)."""
    return f"((({mask}) >> (isodow({date}) - 1)) & 1)"


def with_ctes(*extra: str, recursive: bool = False) -> str:
    """``WITH`` + the binding CTEs + any query-specific CTEs."""
    parts = [BASE_CTES] + [e.strip().rstrip(",") for e in extra if e.strip()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"
