"""Views with the shapes of field-trial data over the benchmark tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "events", "embeddings")

VIEWS = {
    "plots": """
SELECT DISTINCT o_orderkey % 40 + 1 AS bed,
  CAST(floor((o_orderkey % 560) / CAST(40 AS DOUBLE)) AS BIGINT) + 1 AS tier,
  CAST(-121.78 AS DOUBLE) + (o_orderkey % 40) * CAST(0.0000175 AS DOUBLE) AS min_lon,
  CAST(-121.78 AS DOUBLE) + (o_orderkey % 40) * CAST(0.0000175 AS DOUBLE) + CAST(0.0000155 AS DOUBLE) AS max_lon,
  CAST(38.53 AS DOUBLE) + floor((o_orderkey % 560) / CAST(40 AS DOUBLE)) * CAST(0.00004 AS DOUBLE) AS min_lat,
  CAST(38.53 AS DOUBLE) + floor((o_orderkey % 560) / CAST(40 AS DOUBLE)) * CAST(0.00004 AS DOUBLE) + CAST(0.0000346 AS DOUBLE) AS max_lat
FROM orders""",
    "plants": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  10 + 20 * (l_orderkey % 5) AS dap, l_suppkey % 40 + 1 AS bed, l_partkey % 14 + 1 AS tier,
  l_linenumber AS set_id,
  (l_quantity - CAST(25.5 AS DOUBLE)) / CAST(50 AS DOUBLE) * CAST(1.35 AS DOUBLE) AS x,
  (l_discount * 10 - CAST(0.5 AS DOUBLE)) * CAST(3.84 AS DOUBLE) AS y,
  l_tax AS crop_height,
  CASE l_returnflag WHEN 'A' THEN 'Cowpea' WHEN 'N' THEN 'Common Beans' ELSE 'Sorghum' END AS crop_type
FROM lineitem""",
    "boxes": """
SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
  (l_linenumber - 1) % 6 AS category_id,
  l_quantity / CAST(51 AS DOUBLE) AS x_c, l_discount * 9 + CAST(0.05 AS DOUBLE) AS y_c,
  l_tax + CAST(0.01 AS DOUBLE) AS w, (l_partkey % 100) / CAST(100 AS DOUBLE) AS h
FROM lineitem""",
    "raster": """
SELECT CAST(floor(event_id / CAST(100 AS DOUBLE)) AS BIGINT) AS row, event_id % 100 AS col,
  CAST(least(CAST(255 AS DOUBLE), floor(value)) AS INT) AS v
FROM events""",
    "arrivals": """
SELECT event_id, user_id AS plot, event_type AS kind, ts AS arrived_at, value AS size_kb FROM events""",
    "artifacts": """
SELECT DISTINCT concat('dap_', CAST(10 + 20 * (l_orderkey % 5) AS VARCHAR(10)), '_plot_',
  CAST(l_suppkey % 40 + 1 AS VARCHAR(10)), '_', CAST(l_partkey % 14 + 1 AS VARCHAR(10)), '_0000_',
  CASE l_linenumber WHEN 1 THEN 'depth' WHEN 2 THEN 'temperature' WHEN 3 THEN 'masks'
    WHEN 4 THEN 'boxes' WHEN 5 THEN 'params' WHEN 6 THEN 'rad' ELSE 'vis' END, '.jpeg') AS file_name
FROM lineitem""",
    "primitives": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 40 + 1 AS bed, l_partkey % 14 + 1 AS tier,
  CASE WHEN l_linenumber = 1 THEN 'ground' ELSE 'leaf' END AS surface,
  l_quantity * 3 AS flux_red, l_quantity * 4 AS flux_green,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS flux_blue,
  l_discount * 4000 AS latent_flux, l_tax * 200 AS net_photosynthesis,
  CAST(300 AS DOUBLE) + l_discount * 100 AS temperature,
  l_quantity / CAST(1000 AS DOUBLE) AS area
FROM lineitem""",
    "weather": """
SELECT date_trunc('hour', ts) AS hour_ts, CAST(290 AS DOUBLE) + min(value) AS air_temperature,
  max(value) / CAST(1000 AS DOUBLE) AS et0, count(*) AS n
FROM events GROUP BY date_trunc('hour', ts)""",
    "scenes": """
SELECT o_orderkey AS scene_id, o_orderkey % 40 + 1 AS bed,
  CAST(floor((o_orderkey % 560) / CAST(40 AS DOUBLE)) AS BIGINT) + 1 AS tier,
  CAST(1.0 AS DOUBLE) + (o_orderkey % 90) / CAST(10 AS DOUBLE) AS camera_height,
  CAST(o_orderkey % 91 AS DOUBLE) AS sun_elevation,
  CAST(1.2 AS DOUBLE) + (o_orderkey % 7) / CAST(20 AS DOUBLE) AS plot_size_x,
  CAST(3.5 AS DOUBLE) + (o_orderkey % 11) / CAST(20 AS DOUBLE) AS plot_size_y,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS chlorophyll
FROM orders""",
    "vertices": """
SELECT l_orderkey AS object_id, l_linenumber, l_partkey, l_suppkey,
  l_quantity / CAST(10 AS DOUBLE) AS x, l_discount * 10 AS y, l_tax * 10 - CAST(0.2 AS DOUBLE) AS z,
  (l_linenumber - 1) % 6 AS organ, l_quantity / CAST(1000 AS DOUBLE) AS area
FROM lineitem""",
}
_PIXELS = """
SELECT CAST(floor(vec_id / CAST(3 AS DOUBLE)) AS BIGINT) AS image_id, vec_id % 3 AS band,
  CAST(floor(p / CAST(8 AS DOUBLE)) AS BIGINT) AS row, CAST(p % 8 AS BIGINT) AS col,
  CAST(floor((CAST(v AS DOUBLE) + 1) * CAST(127.5 AS DOUBLE)) AS INT) AS v
FROM (SELECT vec_id, {explode} FROM embeddings)"""
SPARK_PIXELS = _PIXELS.format(explode="posexplode(embedding) AS (p, v)")
DUCK_PIXELS = _PIXELS.format(explode="unnest(range(len(embedding))) AS p, unnest(embedding) AS v")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the Parquet tables in `sf_dir`."""
    sql = SPARK_PIXELS if name == "pixels" else VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"FROM {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **tables)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL of `body` with the named views (and `pixels`) in front."""
    ctes = ", ".join(f"{n} AS ({DUCK_PIXELS if n == 'pixels' else VIEWS[n]})" for n in names)
    body = body.strip()
    if not body.upper().startswith("WITH "):
        return f"WITH {ctes} {body}"
    rest = body[5:].lstrip()
    if rest.upper().startswith("RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[10:]}"
    return f"WITH {ctes}, {rest}"
