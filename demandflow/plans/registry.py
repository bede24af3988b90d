"""Query registry shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def R(expr: str) -> str:
    """SQL twin of ``functions.numeric.r6``."""
    return f"(round(({expr}) * 1e6) / 1e6 + 0.0)"


# The observation view in SQL (runs unchanged in DuckDB and Spark SQL).
OBS_SQL = """obs AS (
  SELECT event_id AS idx,
         translate(substr(md5(cast(user_id AS varchar)), 1, 6), 'a', 'g') AS geohash,
         cast(extract(day FROM ts) AS int) AS day,
         concat(cast(extract(hour FROM ts) AS int), ':', cast(floor(extract(minute FROM ts) / 15) AS int) * 15) AS timestamp,
         value / 500 AS demand,
         CASE WHEN k % 10 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Residential'
              WHEN k % 3 = 1 THEN 'Commercial' ELSE 'Highway' END AS road_type,
         CASE WHEN k % 17 = 0 THEN NULL ELSE cast(1 + k % 5 AS double) END AS number_of_lanes,
         CASE WHEN k % 2 = 0 THEN 'Allowed' ELSE 'Not Allowed' END AS large_vehicles,
         CASE WHEN k % 7 = 0 THEN 'Yes' ELSE 'No' END AS landmarks,
         CASE WHEN k % 13 = 0 THEN NULL ELSE k * 0.5e0 - 5 END AS temperature,
         CASE event_type WHEN 'view' THEN 'Sunny' WHEN 'click' THEN 'Cloudy'
              WHEN 'purchase' THEN 'Rainy' WHEN 'signup' THEN 'Snowy' ELSE NULL END AS weather
  FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events) e
)"""

# Common derived views used by many oracle queries.
OBS_T_SQL = """obs_t AS (
  SELECT *, cast(split_part(timestamp, ':', 1) AS int) AS hour,
            cast(split_part(timestamp, ':', 2) AS int) AS minute,
            cast(split_part(timestamp, ':', 1) AS int) * 4
              + cast(floor(cast(split_part(timestamp, ':', 2) AS int) / 15) AS int) AS slot
  FROM obs
)"""


def with_obs(body: str, *extra: str) -> str:
    ctes = ",\n".join([OBS_SQL, OBS_T_SQL, *extra])
    return f"WITH {ctes}\n{body}"


# Deterministic base predictions (pa smoothed geohash, pb road x slot, pc geohash x hour),
# fit on the reference period, applied to the target period.
BP_SQL = [
    "rf AS (SELECT * FROM obs_t WHERE day <= 20)",
    "tg AS (SELECT * FROM obs_t WHERE day > 20)",
    "ga AS (SELECT avg(demand) AS g FROM rf)",
    """bp AS (SELECT t.idx, t.demand, coalesce((a.m * a.n + ga.g * 10) / (a.n + 10), ga.g) AS pa,
       coalesce(b.m, ga.g) AS pb, coalesce(c.m, ga.g) AS pc
     FROM tg t
     LEFT JOIN (SELECT geohash, avg(demand) AS m, count(demand) AS n FROM rf GROUP BY geohash) a ON t.geohash = a.geohash
     LEFT JOIN (SELECT coalesce(road_type, 'MISSING') AS road, slot, avg(demand) AS m FROM rf GROUP BY 1, 2) b
       ON coalesce(t.road_type, 'MISSING') = b.road AND t.slot = b.slot
     LEFT JOIN (SELECT geohash, hour, avg(demand) AS m FROM rf GROUP BY geohash, hour) c
       ON t.geohash = c.geohash AND t.hour = c.hour
     CROSS JOIN ga)""",
]
