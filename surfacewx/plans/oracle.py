"""DuckDB twins of the registered queries (same column names and types).

The tables ``supplier``, ``events``, ``lineitem`` ... are views over the same
Parquet files. Float literals carry ``e0`` so that both engines read them as
DOUBLE (a plain ``600000.0`` is a DECIMAL).
"""

from __future__ import annotations

STATIONS = """
stations AS (
  SELECT printf('%06d', 720000 + s_suppkey) || '-' || printf('%05d', s_nationkey) AS station_id,
         printf('%06d', 720000 + s_suppkey) AS usaf,
         printf('%05d', s_nationkey) AS wban,
         s_name AS station_name,
         CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'US' END AS country,
         CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE 'TX' END AS state,
         CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE printf('K%03d', s_suppkey % 1000) END AS icao,
         CASE WHEN s_suppkey % 17 = 16 THEN NULL
              ELSE CAST(25000 + (s_suppkey * 7919) % 10000 AS DOUBLE) / 1000 END AS latitude,
         CAST(-100000 + (s_suppkey * 6113) % 10000 AS DOUBLE) / 1000 AS longitude,
         CASE WHEN s_suppkey % 11 = 10 THEN NULL
              ELSE CAST((s_suppkey * 131) % 5000 AS DOUBLE) / 10 END AS elevation,
         make_date(CAST(1970 + s_suppkey % 40 AS INTEGER), CAST(1 + s_suppkey % 12 AS INTEGER),
                   CAST(1 + s_suppkey % 28 AS INTEGER)) AS "begin",
         DATE '2018-05-01' AS "end",
         s_suppkey
  FROM supplier)"""

OBS_RAW = """
obs_raw AS (
  SELECT event_id, user_id % (SELECT count(*) FROM supplier) AS k,
         CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
         CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
         CASE WHEN event_id % 17 = 3 THEN -9999 ELSE CAST((user_id * 7 + event_id) % 400 - 100 AS INTEGER) END AS air_temperature_raw,
         CASE WHEN event_id % 19 = 5 THEN -9999 ELSE CAST((event_id * 3) % 300 - 50 AS INTEGER) END AS dew_point_temperature_raw,
         CASE WHEN event_id % 23 = 7 THEN -9999 ELSE CAST((event_id * 11) % 600 + 9800 AS INTEGER) END AS sea_level_pressure_raw,
         CASE WHEN event_id % 29 = 11 THEN -9999 ELSE CAST((event_id * 37) % 360 AS INTEGER) END AS wind_direction_raw,
         CASE WHEN event_id % 13 = 0 THEN -9999 ELSE CAST(floor(value * 10) AS INTEGER) END AS wind_speed_raw,
         CASE WHEN event_id % 31 = 13 THEN -9999 ELSE CAST(event_id % 20 AS INTEGER) END AS total_cloud_cover_raw,
         CASE WHEN event_id % 7 = 1 THEN -1 WHEN event_id % 3 = 0 THEN -9999
              ELSE CAST((event_id * 5) % 120 AS INTEGER) END AS one_hour_precipitation_raw,
         CASE WHEN event_id % 11 = 2 THEN -1 WHEN event_id % 4 = 0 THEN -9999
              ELSE CAST((event_id * 13) % 400 AS INTEGER) END AS six_hour_precipitation_raw,
         event_type
  FROM events)"""

OBS = """
obs AS (
  SELECT event_id, k, year, month, day, hour,
         CAST(nullif(air_temperature_raw, -9999) AS DOUBLE) / 10 AS air_temperature,
         CAST(nullif(dew_point_temperature_raw, -9999) AS DOUBLE) / 10 AS dew_point_temperature,
         CAST(nullif(sea_level_pressure_raw, -9999) AS DOUBLE) / 10 AS sea_level_pressure,
         nullif(wind_direction_raw, -9999) AS wind_direction,
         CAST(nullif(wind_speed_raw, -9999) AS DOUBLE) / 10 AS wind_speed,
         nullif(wind_speed_raw, -9999) AS wind_speed_x10,
         nullif(total_cloud_cover_raw, -9999) AS total_cloud_cover,
         CAST(nullif(one_hour_precipitation_raw, -9999) AS DOUBLE) / 10 AS one_hour_precipitation,
         CAST(nullif(six_hour_precipitation_raw, -9999) AS DOUBLE) / 10 AS six_hour_precipitation,
         event_type
  FROM obs_raw)"""

SELECTION = """
hav AS (
  SELECT *, sin(radians(latitude - 29.761993e0) / 2) * sin(radians(latitude - 29.761993e0) / 2)
            + cos(radians(29.761993e0)) * cos(radians(latitude))
            * sin(radians(longitude + 95.366302e0) / 2) * sin(radians(longitude + 95.366302e0) / 2) AS a
  FROM stations),
near AS (
  SELECT *, sqrt(pow(6371e0 * (2 * atan2(sqrt(a), sqrt(1 - a))) * 1000, 2) + pow(12e0 - elevation, 2)) AS distance_m
  FROM hav),
sel AS (
  SELECT * FROM near
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND elevation IS NOT NULL AND distance_m <= 600000e0)"""

BASE = "WITH" + STATIONS + "," + OBS_RAW + "," + OBS
BASE_SEL = BASE + "," + SELECTION

# Report projection over a relation with year..hour, wind_speed_x10 and station columns.
REPORT_SELECT = """
  CAST(year AS VARCHAR) AS year, CAST(month AS VARCHAR) AS month, CAST(day AS VARCHAR) AS day,
  CAST(hour AS VARCHAR) AS hour, coalesce(CAST(wind_speed_x10 AS VARCHAR), '') AS wind_speed_x10,
  station_id, coalesce(station_name, '') AS station_name, coalesce(country, '') AS country,
  coalesce(state, '') AS state,
  CASE WHEN latitude IS NULL THEN '' ELSE printf('%+07.3f', latitude) END AS latitude,
  CASE WHEN longitude IS NULL THEN '' ELSE printf('%+08.3f', longitude) END AS longitude,
  CASE WHEN elevation IS NULL THEN '' ELSE printf('%+07.1f', elevation) END AS elevation"""

SEL_OBS = """,
o AS (
  SELECT obs.*, sel.station_id, sel.station_name, sel.country, sel.state, sel.latitude, sel.longitude,
         sel.elevation, sel.station_id || '-' || CAST(obs.year AS VARCHAR) AS observation_id
  FROM obs JOIN sel ON obs.k = sel.s_suppkey),
st AS (SELECT count(wind_speed) AS n, avg(wind_speed) AS m, stddev_samp(wind_speed) AS s FROM o)"""

ALL_STATS = """,
st_all AS (SELECT avg(wind_speed) AS m, stddev_samp(wind_speed) AS s FROM obs),
outl AS (SELECT * FROM obs WHERE wind_speed > (SELECT m + 3e0 * s FROM st_all))"""

# Outliers of which some have a station that the catalogue lacks, with the id of their own record.
SOME_UNKNOWN = """,
unk AS (
  SELECT * REPLACE (k2 AS k), printf('%06d', 720000 + k2) || '-00000' AS record_id
  FROM (SELECT *, CASE WHEN event_id % 41 = 5 THEN k + 10000000 ELSE k END AS k2 FROM outl))"""

# Rendered observation lines (mirror of the Spark rendering + variations).
LINES = """,
lines0 AS (
  SELECT event_id,
         printf('%06d', 720000 + k) || '-99999-' || CAST(year AS VARCHAR) AS observation_id,
         printf('%04d %02d %02d %02d%6d%6d%6d%6d%6d%6d%6d%6d', year, month, day, hour,
                air_temperature_raw, dew_point_temperature_raw, sea_level_pressure_raw, wind_direction_raw,
                wind_speed_raw, total_cloud_cover_raw, one_hour_precipitation_raw, six_hour_precipitation_raw) AS v0
  FROM obs_raw),
lines1 AS (
  SELECT event_id, observation_id,
         CASE WHEN event_id % 9 = 4 THEN v1 || ' 17' ELSE v1 END AS value
  FROM (SELECT *, CASE WHEN event_id % 5 = 1 THEN '  ' || v0 || chr(9) || ' ' ELSE v0 END AS v1 FROM lines0)),
damaged AS (
  SELECT event_id, observation_id,
         CASE WHEN event_id % 7 <> 0 THEN value
              WHEN event_id % 2 = 0 THEN regexp_replace(value, '\\s+\\S+\\s+\\S+\\s*$', '')
              ELSE value || ' x' END AS value
  FROM lines1)"""

PARSED_COLS = """
  obs.event_id, l.observation_id, regexp_extract(l.observation_id, '^(.*)-', 1) AS station_id,
  obs.year, obs.month, obs.day, obs.hour, obs.air_temperature, obs.dew_point_temperature,
  obs.sea_level_pressure, obs.wind_direction, obs.wind_speed, obs.total_cloud_cover,
  obs.one_hour_precipitation, obs.six_hour_precipitation, obs.wind_speed_x10"""

FILE_NAMES = """,
files AS (
  SELECT event_id,
         '/data/isd-lite/' || CAST(year AS VARCHAR) || '/' ||
         CASE WHEN event_id % 10 = 9 THEN 'README'
              ELSE printf('%06d', 720000 + k) || '-99999-' || CAST(year AS VARCHAR) ||
                   CASE event_id % 3 WHEN 0 THEN '.gz' WHEN 1 THEN '' ELSE '.txt.gz' END END AS path
  FROM obs),
keys AS (
  SELECT event_id, path,
         regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS observation_id
  FROM files)"""

STATION_COLS = (
    'station_id, usaf, wban, station_name, country, state, icao, latitude, longitude, elevation, "begin", "end"'
)


def _stats_cols(src: str = "") -> str:
    return "n, round(m, 6) AS mean, round(s, 6) AS stddev"


ORACLE: dict[str, str] = {
    "flagship_outliers": BASE_SEL + SEL_OBS + f"""
SELECT {REPORT_SELECT}
FROM o WHERE wind_speed > (SELECT m + 3e0 * s FROM st)""",
    "selected_stats": BASE_SEL + SEL_OBS + "\nSELECT " + _stats_cols() + " FROM st",
    "sorted_report": BASE_SEL + SEL_OBS + f"""
SELECT {REPORT_SELECT}, event_id,
       row_number() OVER (ORDER BY year, month, day, hour, observation_id, event_id) AS position
FROM o WHERE wind_speed > (SELECT m + 3e0 * s FROM st)""",
    "parse_observations": BASE + LINES + f"""
SELECT {PARSED_COLS}
FROM obs JOIN lines1 l ON obs.event_id = l.event_id""",
    "parse_malformed_dropped": BASE + LINES + f"""
SELECT {PARSED_COLS}
FROM obs JOIN damaged l ON obs.event_id = l.event_id
WHERE obs.event_id % 7 <> 0""",
    "parse_malformed_permissive": BASE + LINES + """
SELECT obs.event_id, l.observation_id, regexp_extract(l.observation_id, '^(.*)-', 1) AS station_id,
       CASE WHEN bad THEN NULL ELSE obs.year END AS year,
       CASE WHEN bad THEN NULL ELSE obs.month END AS month,
       CASE WHEN bad THEN NULL ELSE obs.day END AS day,
       CASE WHEN bad THEN NULL ELSE obs.hour END AS hour,
       CASE WHEN bad THEN NULL ELSE obs.air_temperature END AS air_temperature,
       CASE WHEN bad THEN NULL ELSE obs.dew_point_temperature END AS dew_point_temperature,
       CASE WHEN bad THEN NULL ELSE obs.sea_level_pressure END AS sea_level_pressure,
       CASE WHEN bad THEN NULL ELSE obs.wind_direction END AS wind_direction,
       CASE WHEN bad THEN NULL ELSE obs.wind_speed END AS wind_speed,
       CASE WHEN bad THEN NULL ELSE obs.total_cloud_cover END AS total_cloud_cover,
       CASE WHEN bad THEN NULL ELSE obs.one_hour_precipitation END AS one_hour_precipitation,
       CASE WHEN bad THEN NULL ELSE obs.six_hour_precipitation END AS six_hour_precipitation,
       CASE WHEN bad THEN NULL ELSE obs.wind_speed_x10 END AS wind_speed_x10,
       CASE WHEN bad THEN l.value END AS _corrupt_record
FROM obs JOIN (SELECT *, event_id % 7 = 0 AS bad FROM damaged) l ON obs.event_id = l.event_id""",
    "parse_stations": BASE + f"""
SELECT {STATION_COLS} FROM (
  SELECT * REPLACE (CASE WHEN s_suppkey % 6 = 2 THEN station_name || chr(92) ELSE station_name END AS station_name) FROM stations)""",
    "observation_key": BASE + FILE_NAMES + "\nSELECT event_id, path, observation_id FROM keys",
    "station_key": BASE + FILE_NAMES + """
SELECT event_id, observation_id,
       CASE WHEN contains(observation_id, '-') THEN regexp_extract(observation_id, '^(.*)-', 1) END AS station_id
FROM keys""",
    "stations_last_wins": BASE + """,
lines AS (
  SELECT station_id, station_name, s_suppkey * 2 AS line_no FROM stations
  UNION ALL
  SELECT station_id, station_name || ' (moved)' AS station_name,
         CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 2 + 1 ELSE s_suppkey * 2 - 1 END AS line_no
  FROM stations WHERE s_suppkey % 3 <> 2)
SELECT station_id, station_name, line_no FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY line_no DESC) AS rn FROM lines)
WHERE rn = 1""",
    "station_lookup": BASE + f"""
SELECT {STATION_COLS} FROM stations
WHERE station_id IN (SELECT station_id FROM stations ORDER BY s_suppkey LIMIT 3)""",
    "station_label": BASE + """
SELECT station_id,
       station_id || ': ' || coalesce(station_name, '') || ',' || coalesce(country, '') || ','
       || coalesce(state, '') || ',' || coalesce(icao, '') || ', ('
       || coalesce(CAST(latitude AS VARCHAR), '') || ',' || coalesce(CAST(longitude AS VARCHAR), '') || ','
       || coalesce(CAST(elevation AS VARCHAR), '') || '), ['
       || strftime("begin", '%Y%m%d') || '-' || strftime("end", '%Y%m%d') || ']' AS label
FROM stations""",
    "distance": BASE_SEL + "\nSELECT station_id, round(distance_m, 3) AS distance_m FROM near",
    "within_radius": BASE_SEL + "\nSELECT station_id, round(distance_m, 3) AS distance_m FROM sel",
    "within_radius_any_coordinates": BASE_SEL.replace("FROM stations),", "FROM moved),").replace(
        "hav AS (",
        """moved AS (
  SELECT * REPLACE (CASE WHEN s_suppkey % 4 = 2 THEN 180e0 - latitude ELSE latitude END AS latitude,
    CASE s_suppkey % 4 WHEN 1 THEN longitude + 360e0 WHEN 2 THEN longitude + 180e0 ELSE longitude END AS longitude) FROM stations),
hav AS (""",
    ) + "\nSELECT station_id, latitude, longitude, round(distance_m, 3) AS distance_m FROM sel",
    "selected_ids": BASE_SEL + "\nSELECT DISTINCT station_id FROM sel",
    "semi_join_stations": BASE_SEL + """
SELECT event_id, k, wind_speed FROM obs WHERE k IN (SELECT s_suppkey FROM sel)""",
    "semi_join_prefiltered": BASE_SEL + """
SELECT o.event_id, o.k, o.wind_speed FROM obs o JOIN (SELECT DISTINCT s_suppkey FROM sel) s ON o.k = s.s_suppkey""",
    "pooled_stats": BASE + """
SELECT count(wind_speed) AS n, round(avg(wind_speed), 6) AS mean, round(stddev_samp(wind_speed), 6) AS stddev
FROM obs""",
    "measure_stats": BASE + """,
long AS (
  UNPIVOT (SELECT CAST(air_temperature AS DOUBLE) AS air_temperature,
                  CAST(dew_point_temperature AS DOUBLE) AS dew_point_temperature,
                  CAST(sea_level_pressure AS DOUBLE) AS sea_level_pressure,
                  CAST(wind_direction AS DOUBLE) AS wind_direction,
                  CAST(wind_speed AS DOUBLE) AS wind_speed,
                  CAST(total_cloud_cover AS DOUBLE) AS total_cloud_cover,
                  CAST(one_hour_precipitation AS DOUBLE) AS one_hour_precipitation,
                  CAST(six_hour_precipitation AS DOUBLE) AS six_hour_precipitation FROM obs)
  ON COLUMNS(*) INTO NAME measure VALUE value)
SELECT measure, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev
FROM long GROUP BY measure""",
    "partial_stats": BASE + """
SELECT k, year, count(wind_speed) AS n, round(avg(wind_speed), 6) AS mean,
       round(var_pop(wind_speed) * count(wind_speed), 4) AS m2
FROM obs GROUP BY k, year HAVING count(wind_speed) > 0""",
    "partial_stats_merged": BASE + """
SELECT count(wind_speed) AS n, round(avg(wind_speed), 6) AS mean, round(stddev_samp(wind_speed), 6) AS stddev
FROM obs""",
    "threshold": BASE + """,
st AS (SELECT avg(wind_speed) AS m, stddev_samp(wind_speed) AS s FROM obs)
SELECT d.delta, round(st.m + d.delta * st.s, 6) AS threshold
FROM st, (VALUES (1e0), (2e0), (3e0)) AS d(delta)""",
    "find_outliers": BASE + ALL_STATS + "\nSELECT event_id, k, wind_speed FROM outl",
    "find_outliers_lineitem": """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice > (SELECT avg(l_extendedprice) + 1e0 * stddev_samp(l_extendedprice) FROM lineitem)""",
    "union_observations": BASE + """,
more AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(day(o_orderdate) AS INTEGER) AS day, 0 AS hour, CAST(o_totalprice AS DOUBLE) AS wind_speed FROM orders)
SELECT event_id AS id, year, month, day, hour, wind_speed FROM obs
UNION ALL SELECT * FROM more UNION ALL SELECT * FROM more""",
    "enrich_outliers": BASE_SEL + ALL_STATS + SOME_UNKNOWN + """
SELECT outl.event_id, outl.k, outl.record_id, outl.wind_speed, sel.station_id, sel.station_name, sel.latitude, sel.longitude,
       sel.elevation
FROM unk outl LEFT JOIN sel ON outl.k = sel.s_suppkey""",
    "format_report": BASE + ALL_STATS + f""",
r AS (
  SELECT outl.*, s.station_id, s.station_name, s.country, s.state, s.latitude, s.longitude, s.elevation
  FROM outl LEFT JOIN stations s ON outl.k = s.s_suppkey)
SELECT {REPORT_SELECT}, event_id FROM r""",
}
# The K3 body: as P2, but with the record's own id, and some stations unknown.
ORACLE["outlier_report"] = BASE + ALL_STATS + SOME_UNKNOWN + f""",
r AS (
  SELECT o.*, o.record_id AS station_id, s.station_name, s.country, s.state, s.latitude, s.longitude, s.elevation
  FROM unk o LEFT JOIN stations s ON o.k = s.s_suppkey)
SELECT {REPORT_SELECT}, event_id FROM r"""

# The same rows through files: the catalogue, the selected stations' readings, the whole job.
ORACLE["station_scan"] = BASE + f"\nSELECT {STATION_COLS} FROM stations"
ORACLE["observation_scan"] = BASE_SEL + """
SELECT sel.station_id || '-' || CAST(year AS VARCHAR) AS observation_id, sel.station_id, year, month, day, hour, air_temperature,
       dew_point_temperature, sea_level_pressure, wind_direction, wind_speed, total_cloud_cover, one_hour_precipitation,
       six_hour_precipitation, wind_speed_x10
FROM obs JOIN sel ON obs.k = sel.s_suppkey"""
ORACLE["detect_files"] = ORACLE["flagship_outliers"]
ORACLE["manifest_scan"] = ORACLE["observation_scan"]
ORACLE["detect_manifest"] = ORACLE["flagship_outliers"]

# The whole job around another centre (Dallas, 139 m), 300 km, delta 2.
ORACLE["detect_dallas"] = (
    BASE
    + """,
hav AS (
  SELECT *, sin(radians(latitude - 32.776664e0) / 2) * sin(radians(latitude - 32.776664e0) / 2)
            + cos(radians(32.776664e0)) * cos(radians(latitude))
            * sin(radians(longitude + 96.796988e0) / 2) * sin(radians(longitude + 96.796988e0) / 2) AS a
  FROM stations),
near AS (
  SELECT *, sqrt(pow(6371e0 * (2 * atan2(sqrt(a), sqrt(1 - a))) * 1000, 2) + pow(139e0 - elevation, 2)) AS distance_m
  FROM hav),
sel AS (
  SELECT * FROM near
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND elevation IS NOT NULL AND distance_m <= 300000e0)"""
    + SEL_OBS
    + f"""
SELECT {REPORT_SELECT}, event_id
FROM o WHERE wind_speed > (SELECT m + 2e0 * s FROM st)"""
)

# Queries that reach the same rows by another way: from the ingested table, from a report file.
ORACLE["ingested_detect"] = ORACLE["flagship_outliers"]
ORACLE["report_file"] = ORACLE["flagship_outliers"]
ORACLE["ingested_stats"] = BASE_SEL + SEL_OBS + "\nSELECT " + _stats_cols() + ", (SELECT max(wind_speed) FROM o) AS high FROM st"
ORACLE["ingest_counts"] = """
SELECT CASE WHEN event_id % 2 = 0 THEN 'kept' ELSE 'dropped' END AS batch, count(*) AS lines,
       count(*) FILTER (WHERE event_id % 7 = 0) AS bad, count(*) FILTER (WHERE event_id % 7 <> 0) AS n_rows
FROM events GROUP BY ALL"""
ORACLE["ingest_quarantine"] = BASE + LINES + """
SELECT 'kept' AS batch, observation_id, regexp_extract(observation_id, '^(.*)-', 1) AS station_id, value AS line
FROM damaged WHERE event_id % 7 = 0 AND event_id % 2 = 0"""
ORACLE["sql_distance"] = ORACLE["distance"]
ORACLE["sql_keys"] = BASE + FILE_NAMES + """
SELECT event_id, observation_id, CASE WHEN contains(observation_id, '-') THEN regexp_extract(observation_id, '^(.*)-', 1) END AS station_id,
       CAST(floor(event_id / 16e0 * 10e0 + 0.5e0) AS BIGINT) AS tenths
FROM keys"""
