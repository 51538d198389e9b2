"""SQL of the tables that stand in for station data, as ``sources`` derives them; one place for all."""

OBS = """obs AS (SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS date, user_id % 10 AS station_id,
  CASE WHEN user_id % 3 = 0 THEN 'ows' ELSE 'cws' END AS network, round(avg(value), 4) AS temp FROM events GROUP BY 1, 2, 3)"""
META = """meta AS (SELECT s_suppkey AS station_id, 47 + (s_suppkey * 7919 % 1000) / 4000.0::DOUBLE AS lat, 8 + (s_suppkey * 104729 % 1000) / 4000.0::DOUBLE AS long,
  CAST(400 + s_suppkey * 31 % 300 AS DOUBLE) AS elev, CAST(s_nationkey % 5 AS INTEGER) AS lcz FROM supplier)"""
SCORED = """scored AS (SELECT l_suppkey AS station_id, l_orderkey AS row_key, l_linenumber AS line, round(l_discount * 8 + l_tax * 2, 4) AS p,
  (l_extendedprice / l_quantity - 1500) / 100 AS resid, CAST(l_returnflag = 'R' AS INTEGER) AS y,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_returnflag = 'A' AS INTEGER) END AS lenient, CAST(l_linenumber > 4 AS INTEGER) AS strict,
  CASE WHEN CAST(l_shipdate AS DATE) < DATE '1999-01-01' THEN 'train' WHEN CAST(l_shipdate AS DATE) < DATE '2000-06-01' THEN 'valid' ELSE 'test' END AS split FROM lineitem)"""
S = "PARTITION BY station_id, network ORDER BY date"
DAY = "strftime(date, '%Y-%m-%d %H:%M:%S') AS date"
RAW = "raw AS (SELECT CAST(ts AS TIMESTAMP) AS date, user_id % 10 AS station_id, CASE WHEN user_id % 3 = 0 THEN 'ows' ELSE 'cws' END AS network, value AS temp FROM events)"
#: What is known of a scored row's surroundings, as ``sources.context`` derives it.
CONTEXT = SCORED.replace("scored AS", "context AS", 1).replace(
    " FROM lineitem)",
    """, CAST(l_shipdate AS DATE) AS day, CAST(month(l_shipdate) AS INTEGER) AS month, l_quantity * 20 AS solar, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 100 END AS wind, CAST(l_linenumber % 2 AS INTEGER) AS is_day,
  CAST(l_suppkey % 12 AS DOUBLE) AS km, CAST(l_orderkey % 9 AS INTEGER) AS n_refs, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount * 60 END AS spread, CAST(l_orderkey % 4 AS DOUBLE) / 3 AS lcz_differs,
  CAST(l_orderkey % 5 AS DOUBLE) / 4 AS cover_differs, CAST(l_partkey % 300 AS DOUBLE) AS elev_gap, CAST(l_partkey % 25 AS DOUBLE) AS building_gap, CAST(l_partkey % 17 AS DOUBLE) - 8 AS lst_diff, CAST(l_partkey % 301 AS DOUBLE) - 150 AS elev_diff,
  CAST(l_partkey % 15 AS DOUBLE) / 10 - 0.7 AS ndvi_diff FROM lineitem)""",
)
