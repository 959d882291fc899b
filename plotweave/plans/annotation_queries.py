"""Queries of the annotation, geospatial and camera operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions import projection as P
from plotweave.operators import annotations as N
from plotweave.operators import geo as G
from plotweave.sources import readers as S
from plotweave.sources import writers as K
from plotweave.sources.parts import read_document_parts

from .registry import query
from .staging import shared_dir

BOX = "l_linenumber, l_partkey, l_suppkey"


def rounded(df: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in cols])


def sums(df: DataFrame, keys: list[str], *cols: str, digits: int = 4) -> DataFrame:
    """Counts and rounded sums, so that repeated keys don't matter."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), digits).alias(c) for c in cols])


@query("n1_coco_to_yolo", "boxes", sql="""
SELECT image_id, count(*) AS n, round(sum((x_c * 640 + h * 100 / 2) / 1280), 7) AS x_c, round(sum((y_c * 720 + w * 100 / 2) / 720), 7) AS y_c, round(sum(h * 100 / 1280), 7) AS w_n, round(sum(w * 100 / 720), 7) AS h_n FROM boxes GROUP BY image_id""")
def _n1(boxes):
    anns = boxes.select("image_id", (F.col("x_c") * 640).alias("x"), (F.col("y_c") * 720).alias("y"), (F.col("h") * 100).alias("w"), (F.col("w") * 100).alias("h"))
    images = boxes.select("image_id").distinct().withColumns({"width": F.lit(1280), "height": F.lit(720)})
    return sums(N.coco_to_yolo(anns, images), ["image_id"], "x_c", "y_c", "w_n", "h_n", digits=7)


@query("n2_yolo_to_pixels", "boxes", sql="""
SELECT category_id, count(*) AS n, round(sum(least(greatest((x_c - w / 2) * 1280, 0), 1280)), 2) AS x1, round(sum(least(greatest((y_c - h / 2) * 720, 0), 720)), 2) AS y1,
  round(sum(least(greatest((x_c + w / 2) * 1280, 0), 1280)), 2) AS x2, round(sum(least(greatest((y_c + h / 2) * 720, 0), 720)), 2) AS y2 FROM boxes GROUP BY category_id""")
def _n2(boxes):
    return sums(N.yolo_to_pixels(boxes, F.lit(1280), F.lit(720), clamp=True), ["category_id"], "x1", "y1", "x2", "y2", digits=2)


@query("n3_yolo_flip_to_coco", "boxes", sql="""
SELECT category_id, sum(CAST(trunc((x_c - w / 2) * 1280) AS BIGINT)) AS x_min, sum(CAST(trunc(((1 - y_c) - h / 2) * 720) AS BIGINT)) AS y_min, sum(CAST(trunc(w * 1280) AS BIGINT)) AS box_w, sum(CAST(trunc(h * 720) AS BIGINT)) AS box_h FROM boxes GROUP BY category_id""")
def _n3(boxes):
    out = N.yolo_flip_to_coco(boxes, F.lit(1280), F.lit(720))
    return out.groupBy("category_id").agg(*[F.sum(c).alias(c) for c in ("x_min", "y_min", "box_w", "box_h")])


LAYOUT = "SELECT b.range + 1 AS bed, t.range + 1 AS tier, b.range AS col, 13 - t.range AS row FROM range(40) b, range(14) t"


def _layout(df: DataFrame) -> DataFrame:
    return N.grid_layout(df.sparkSession, (1, 40), (1, 14), 640, 480)


def _placed(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"bed": F.col("l_suppkey") % 40 + 1, "tier": F.col("l_partkey") % 14 + 1})


@query("n4_stitch_coco", "boxes", sql=f"""
WITH lay AS ({LAYOUT}), b AS (SELECT *, l_suppkey % 40 + 1 AS bed, l_partkey % 14 + 1 AS tier, CASE WHEN l_linenumber = 1 THEN 640 ELSE 1280 END AS aw,
  row_number() OVER (ORDER BY l_suppkey % 40 + 1, l_partkey % 14 + 1, image_id, l_linenumber, l_partkey, l_suppkey, x_c, y_c, w, h) - 1 AS id FROM boxes)
SELECT b.bed, b.tier, min(id) AS first_id, max(id) AS last_id, 0 AS image_id, 'c1-c2' AS names, count(*) AS n, round(sum(x_c * 640 / aw * 640 + col * 640), 3) AS x, round(sum(y_c * 480 + row * 480), 3) AS y, round(sum(w * 100 * 640 / aw), 3) AS w, round(sum(2 * (x_c * 640 / aw * 640 + col * 640) + w * 100 * 640 / aw), 3) AS ring_x
FROM b JOIN lay USING (bed, tier) GROUP BY b.bed, b.tier""")
def _n4(boxes):
    x, y, w = F.col("x_c") * 640, F.col("y_c") * 480, F.col("w") * 100
    order = ["image_id", "l_linenumber", "l_partkey", "l_suppkey", "x_c", "y_c", "w", "h"]
    anns = _placed(boxes).select("bed", "tier", *order, F.array(x, y, w, F.col("h")).alias("bbox"), F.array(F.array(x, y, x + w, y)).alias("segmentation"), F.when(F.col("l_linenumber") != 1, 1280).alias("width"), F.lit(None).cast("int").alias("height"))
    anns = anns.withColumn("source", F.col("image_id"))
    # the first file has categories 1 and 2, the others more
    cats = _placed(boxes).select("bed", "tier").distinct().select("bed", "tier", F.explode(F.sequence(F.lit(1), F.when((F.col("bed") == 1) & (F.col("tier") == 1), 2).otherwise(3))).alias("id"))
    field = N.stitch_field(anns, cats.withColumn("name", F.concat(F.lit("c"), "id")), _layout(boxes), 640, 480, order, "field.jpeg", 25600, 6720)
    path = f"{shared_dir(boxes.sparkSession)}/plotweave/field-coco-{uuid.uuid4().hex}"
    K.write_field_coco({**field, "annotations": field["annotations"].select("id", "image_id", "bed", "tier", "bbox", "segmentation", F.struct("bed", "tier").alias("plot"))}, path, "gzip")
    # each line but the first and last is an annotation, after a comma or none
    lines = boxes.sparkSession.read.text(path)
    d = F.from_json(F.regexp_replace("value", "^,", ""), "id bigint, image_id int, bbox array<double>, segmentation array<array<double>>, plot struct<bed:bigint,tier:bigint>")
    found = lines.where(F.col("value").rlike('^,?[{]"id"')).select(d.alias("d")).select("d.*")
    names = lines.where(F.col("value").startswith('{"images"')).select(F.array_join(F.from_json(F.concat("value", F.lit("]}")), "categories array<struct<id:int,name:string>>")["categories"]["name"], "-").alias("names"))
    ring = F.col("segmentation")[0]
    totals = {"x": F.col("bbox")[0], "y": F.col("bbox")[1], "w": F.col("bbox")[2], "ring_x": ring[0] + ring[2]}
    out = found.groupBy("plot.bed", "plot.tier").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("image_id").alias("image_id"), F.count(F.lit(1)).alias("n"), *[F.round(F.sum(v), 3).alias(n) for n, v in totals.items()])
    return out.join(F.broadcast(names))


@query("n5_stitch_yolo", "boxes", sql=f"""
WITH lay AS ({LAYOUT}), b AS (SELECT *, l_suppkey % 40 + 1 AS bed, l_partkey % 14 + 1 AS tier FROM boxes)
SELECT DISTINCT printf('%d %.6f %.6f %.6f %.6f', category_id, (x_c + col) / 40, (y_c + row) / 14, w / 40, h / 14) AS line FROM b JOIN lay USING (bed, tier)""")
def _n5(boxes):
    return N.stitch_yolo(_placed(boxes), _layout(boxes), 40, 14).select("line").distinct()


@query("n6_grid_layout", "plots", sql="SELECT bed, tier, 40 - bed AS col, tier - 1 AS row, (40 - bed) * 640 AS x_offset, (tier - 1) * 480 AS y_offset FROM plots")
def _n6(plots):
    return N.with_grid_layout(plots.select("bed", "tier"), (1, 40), (1, 14), F.lit(640), F.lit(480), left_to_right=False, bottom_to_top=False)


@query("n7_polygon_points", "plots", sql="""
WITH p AS (SELECT bed, tier, unnest([0, 1, 2, 3]) AS point, unnest([min_lon, max_lon, max_lon, min_lon]) AS x, unnest([min_lat, min_lat, max_lat, max_lat]) AS y FROM plots)
SELECT bed, tier, ring, point, round(x + ring, 7) AS x, round(y, 7) AS y FROM p, (SELECT unnest([0, 1]) AS ring)""")
def _n7(plots):
    flat = lambda d: F.array(F.col("min_lon") + d, "min_lat", F.col("max_lon") + d, "min_lat", F.col("max_lon") + d, "max_lat", F.col("min_lon") + d, "max_lat")
    out = N.polygon_points(plots.withColumn("segmentation", F.array(flat(0), flat(1))), ["bed", "tier"])
    return out.select("bed", "tier", "ring", "point", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query("n8_boxes_from_masks", "pixels", sql="""
SELECT image_id, band, min(col) AS x1, min(row) AS y1, max(col) AS x2, max(row) AS y2, (min(col) + max(col)) / CAST(2 AS DOUBLE) AS centre_x, (min(row) + max(row)) / CAST(2 AS DOUBLE) AS centre_y FROM pixels WHERE v > 150 GROUP BY image_id, band""")
def _n8(pixels):
    return N.boxes_from_masks(pixels.where("v > 150"), ["image_id", "band"])


def _sql_utm(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """The same series as DuckDB text."""
    lam, s = f"(radians({lon}) - radians({zone * 6 - 183}))", f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {P._E!r} * atanh({P._E!r} * {s}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"asinh(sin({lam}) / sqrt({t} * {t} + cos({lam}) * cos({lam})))"
    x = " + ".join([eta, *[f"CAST({a!r} AS DOUBLE) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(P.ALPHA, 1)]])
    y = " + ".join([xi, *[f"CAST({a!r} AS DOUBLE) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(P.ALPHA, 1)]])
    k = f"CAST({P.SCALE * P._RADIUS!r} AS DOUBLE)"
    return f"(500000 + {k} * ({x}))", f"({k} * ({y}))"


X1, Y1 = _sql_utm("min_lon", "min_lat", 10)
X2, Y2 = _sql_utm("max_lon", "max_lat", 10)
X3, Y3 = _sql_utm("min_lon", "max_lat", 10)
X4, Y4 = _sql_utm("max_lon", "min_lat", 10)


@query("g1_utm_zone", "plots", sql="SELECT bed, tier, 10 AS zone, 32610 AS epsg FROM plots UNION ALL SELECT bed, tier, CAST(floor((bed * 9 - 175 + 180) / CAST(6 AS DOUBLE)) AS INT) + 1, 32701 + CAST(floor((bed * 9 - 175 + 180) / CAST(6 AS DOUBLE)) AS INT) FROM plots")
def _g1(plots):
    here = plots.select("bed", "tier", F.col("min_lon").alias("lon"), F.col("min_lat").alias("lat"))
    there = plots.select("bed", "tier", (F.col("bed") * 9 - 175).cast("double").alias("lon"), (-F.col("min_lat")).alias("lat"))
    return G.with_utm_zone(here.unionByName(there)).select("bed", "tier", "zone", "epsg")


@query("g2_to_utm", "plots", sql=f"SELECT bed, tier, round({X1}, 3) AS utm_x, round({Y1}, 3) AS utm_y, round(min_lon, 8) AS lon_again, round(min_lat, 8) AS lat_again FROM plots")
def _g2(plots):
    out = G.to_utm(plots.select("bed", "tier", F.col("min_lon").alias("lon"), F.col("min_lat").alias("lat")), 10).drop("lon", "lat")
    back = G.from_utm(out, F.lit(10))
    return back.select("bed", "tier", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"), F.round("lon", 8).alias("lon_again"), F.round("lat", 8).alias("lat_again"))


@query("g3_bbox_to_utm", "plots", sql=f"""
SELECT bed, tier, round(least({X1}, {X2}, {X3}, {X4}), 3) AS min_x, round(greatest({X1}, {X2}, {X3}, {X4}), 3) AS max_x, round(least({Y1}, {Y2}, {Y3}, {Y4}), 3) AS min_y, round(greatest({Y1}, {Y2}, {Y3}, {Y4}), 3) AS max_y FROM plots""")
def _g3(plots):
    return G.bbox_to_utm(plots, 10).select("bed", "tier", *[F.round(c, 3).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("g4_pixel_to_world", "raster", sql="SELECT row, col, round(600000 + col * CAST(0.025 AS DOUBLE), 6) AS world_x, round(4265000 - row * CAST(0.025 AS DOUBLE), 6) AS world_y, CAST(trunc(col * CAST(0.025 AS DOUBLE) / CAST(0.1 AS DOUBLE)) AS INT) AS px FROM raster")
def _g4(raster):
    a = [F.lit(x) for x in (600000.0, 0.025, 4265000.0, -0.025)]
    out = G.pixel_to_world(raster, *a, px="col", py="row")
    px = G.world_to_pixel(out.withColumns({"wx": F.col("col") * 0.025, "wy": F.lit(0.0)}), F.lit(0.0), F.lit(0.1), F.lit(0.0), F.lit(-0.1), "wx", "wy")
    return px.select("row", "col", F.round("world_x", 6).alias("world_x"), F.round("world_y", 6).alias("world_y"), "px")


WINDOW = "CAST(trunc((bed - 1) * CAST(2.5 AS DOUBLE)) AS INT)"


@query("g5_plot_pixel_window", "plots", sql="""
WITH w AS (SELECT bed, tier, least(greatest(CAST(trunc((bed * 2.5 - 10.3) / 0.5) AS INT), 0), 150) AS x1, least(greatest(CAST(trunc((bed * 2.5 - 8.3) / 0.5) AS INT), 0), 150) AS x2,
  least(greatest(CAST(trunc((50.2 - tier * 4.0 - 3.5) / 0.5) AS INT), 0), 80) AS y1, least(greatest(CAST(trunc((50.2 - tier * 4.0) / 0.5) AS INT), 0), 80) AS y2 FROM plots)
SELECT bed, tier, x1, x2, y1, y2, x2 - x1 AS x_size, y2 - y1 AS y_size FROM w WHERE x2 > x1 AND y2 > y1""")
def _g5(plots):
    b, t = F.col("bed") * 2.5, F.col("tier") * 4.0
    return G.plot_pixel_window(plots.select("bed", "tier", b.alias("min_x"), (b + 2).alias("max_x"), t.alias("min_y"), (t + 3.5).alias("max_y")), 10.3, 50.2, 0.5, 150, 80).select("bed", "tier", "x1", "x2", "y1", "y2", "x_size", "y_size")


@query("g6_crop_to_plots", "raster", "plots", sql="""
WITH b AS (SELECT bed, tier, (bed - 1) * 2 AS x1, (bed - 1) * 2 + 8 AS x2, (tier - 1) * 7 AS y1, (tier - 1) * 7 + 6 AS y2 FROM plots)
SELECT bed, tier, row - y1 AS crop_row, col - x1 AS crop_col, CASE WHEN col + 0.5 >= x1 + 2 AND col + 0.5 < x1 + 5 AND row + 0.5 >= y1 + 1 AND row + 0.5 < y1 + 4 THEN v ELSE 0 END AS v
FROM raster r JOIN b ON r.col >= x1 AND r.col < x2 AND r.row >= y1 AND r.row < y2""")
def _g6(raster, plots):
    x, y = (F.col("bed") - 1) * 2, (F.col("tier") - 1) * 7
    at = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    windows = plots.select("bed", "tier", x.alias("x1"), (x + 8).alias("x2"), y.alias("y1"), (y + 6).alias("y2"), F.array(at(2, 1), at(5, 1), at(5, 4), at(2, 4)).alias("ring"))
    return G.crop_to_plots(raster, windows, "polygon", 0, 16).select("bed", "tier", "crop_row", "crop_col", "v")


@query("g7_local_to_geo", "plants", "plots", sql="""
SELECT bed, tier, count(*) AS n, round(avg((min_lon + max_lon) / 2 + x * ((max_lon - min_lon) / 1.35)), 8) AS lon, round(avg((min_lat + max_lat) / 2 + y * ((max_lat - min_lat) / 3.84)), 8) AS lat FROM plants JOIN plots USING (bed, tier) GROUP BY bed, tier""")
def _g7(plants, plots):
    out = G.local_to_geo(plants, plots, F.lit(1.35), F.lit(3.84))
    return out.groupBy("bed", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lon"), 8).alias("lon"), F.round(F.avg("lat"), 8).alias("lat"))


@query("g8_local_to_pixels", "plants", sql="SELECT bed, tier, count(*) AS n, round(sum((x / 1.35 + 0.5) * 381), 3) AS px, round(sum((0.5 - y / 3.84) * 1080), 3) AS py FROM plants GROUP BY bed, tier")
def _g8(plants):
    return sums(G.local_to_pixels(plants, F.lit(1.35), F.lit(3.84), F.lit(381), F.lit(1080)), ["bed", "tier"], "px", "py", digits=3)


@query("g9_pixels_to_local", "raster", sql="SELECT row, col, round((col - 50) * CAST(0.0035 AS DOUBLE), 6) AS x_m, round(-(row - 50) * CAST(0.0035 AS DOUBLE), 6) AS y_m, round((row - 50) * CAST(0.012 AS DOUBLE), 6) AS rover_x FROM raster")
def _g9(raster):
    centres = raster.select("row", "col", F.col("col").alias("cx"), F.col("row").alias("cy"))
    drone = G.pixels_to_local(centres, "drone", F.lit(100), F.lit(100), F.lit(0.0035)).select("*")
    rover = G.pixels_to_local(drone.withColumnsRenamed({"x_m": "dx", "y_m": "dy"}), "rover", F.lit(100), F.lit(100))
    return rover.select("row", "col", F.round("dx", 6).alias("x_m"), F.round("dy", 6).alias("y_m"), F.round("x_m", 6).alias("rover_x"))


@query("g10_rotate_plots", "plots", sql="""
WITH c AS (SELECT avg((bed * 2.5) + 1.0) AS cx, avg(tier * 4.0 + 1.75) AS cy FROM plots)
SELECT bed, tier, round(cx + (bed * 2.5 - cx) * cos(radians(30)) - (tier * 4.0 - cy) * sin(radians(30)), 6) AS x0, round(cy + (bed * 2.5 - cx) * sin(radians(30)) + (tier * 4.0 - cy) * cos(radians(30)), 6) AS y0 FROM plots, c""")
def _g10(plots):
    b, t = F.col("bed") * 2.5, F.col("tier") * 4.0
    at = lambda dx, dy: F.struct((b + dx).alias("x"), (t + dy).alias("y"))
    out = G.rotate_plots(plots.select("bed", "tier", F.array(at(0, 0), at(2, 0), at(2, 3.5), at(0, 3.5)).alias("ring")), 30.0)
    return out.select("bed", "tier", F.round(F.col("ring")[0]["x"], 6).alias("x0"), F.round(F.col("ring")[0]["y"], 6).alias("y0"))


@query("g13_downsample", "raster", sql="SELECT CAST(floor(row / CAST(4 AS DOUBLE)) AS BIGINT) AS row, CAST(floor(col / CAST(4 AS DOUBLE)) AS BIGINT) AS col, v FROM raster WHERE row % 4 = 2 AND col % 4 = 2")
def _g13(raster):
    from plotweave.operators.raster import downsample

    return downsample(raster, 4).select("row", "col", "v")


@query("g14_mosaic", "pixels", sql="""
WITH t AS (SELECT CAST(floor((image_id * 3 + band) / CAST(4 AS DOUBLE)) AS BIGINT) AS composite, (image_id * 3 + band) % 4 AS tile, row, col, v FROM pixels),
n AS (SELECT composite FROM t GROUP BY composite HAVING count(DISTINCT tile) = 4)
SELECT composite, CAST(floor(tile / CAST(2 AS DOUBLE)) AS BIGINT) * 8 + row AS row, tile % 2 * 8 + col AS col, v FROM t JOIN n USING (composite)""")
def _g14(pixels):
    from plotweave.operators.raster import mosaic

    number = F.col("image_id") * 3 + F.col("band")
    tiles = pixels.select(F.floor(number / 4).alias("composite"), (number % 4).alias("tile"), "row", "col", "v")
    return mosaic(tiles, 2, 2, 8, 8)


@query("g15_cell_extents", "plots", sql="""
SELECT bed, tier, c.range AS cell_col, r.range AS cell_row, round(bed * 2.5 + c.range * 0.5, 6) AS cell_min_x, round(tier * 4.0 + 3.5 - (r.range + 1) * 0.5, 6) AS cell_min_y FROM plots, range(4) c, range(7) r""")
def _g15(plots):
    b, t = F.col("bed") * 2.5, F.col("tier") * 4.0
    out = G.cell_extents(plots.select("bed", "tier", b.alias("min_x"), (b + 2).alias("max_x"), t.alias("min_y"), (t + 3.5).alias("max_y")), 4, 7)
    return rounded(out, ["bed", "tier", "cell_col", "cell_row"], "cell_min_x", "cell_min_y")


@query("g16_scene_size", "scenes", sql="""
SELECT scene_id, CAST(0.0 AS DOUBLE) AS heading, CAST(round(1080 * (plot_size_x / plot_size_y)) AS INT) AS image_width, 1080 AS image_height, round(round(plot_size_x, 4) * 1.1, 6) AS size_x FROM scenes""")
def _g16(scenes):
    out = G.scene_size(scenes, F.col("plot_size_x"), F.col("plot_size_y"), 1.1)
    return out.select("scene_id", "heading", "image_width", "image_height", F.round("size_x", 6).alias("size_x"))


@query("g17_dem_mesh", "pixels", sql="""
WITH p AS (SELECT image_id * 3 + band AS image_id, row, col, CASE WHEN v > 100 THEN v END AS v FROM pixels),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row, col) AS id FROM p WHERE v IS NOT NULL),
q AS (SELECT a.image_id, a.id AS a, b.id AS b, c.id AS c, d.id AS d FROM k a JOIN k b ON b.image_id = a.image_id AND b.row = a.row AND b.col = a.col + 1 JOIN k c ON c.image_id = a.image_id AND c.row = a.row + 1 AND c.col = a.col
  JOIN k d ON d.image_id = a.image_id AND d.row = a.row + 1 AND d.col = a.col + 1)
SELECT v.raster_id, v.n_vertices, v.sum_z, v.sum_x, coalesce(f.n_faces, 0) AS n_faces, coalesce(f.check_sum, 0) AS check_sum FROM
  (SELECT image_id AS raster_id, count(*) AS n_vertices, round(sum(v * CAST(0.5 AS DOUBLE)), 4) AS sum_z, round(sum((col - 4) * CAST(0.1 AS DOUBLE)), 4) AS sum_x FROM k GROUP BY image_id) v
  LEFT JOIN (SELECT image_id AS raster_id, count(*) * 2 AS n_faces, sum(a + c + b + b * 7 + c * 7 + d * 7) AS check_sum FROM q GROUP BY image_id) f USING (raster_id)""")
def _g17(pixels):
    dem = pixels.select((F.col("image_id") * 3 + F.col("band")).alias("raster_id"), "row", "col", F.when(F.col("v") > 100, F.col("v")).alias("v"))
    vertices, faces = G.dem_mesh(dem, 0.1, 0.5)
    v = vertices.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.round(F.sum("z"), 4).alias("sum_z"), F.round(F.sum("x"), 4).alias("sum_x"))
    # the second triangle of a quad starts at its upper right corner
    half = faces.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_faces"), F.sum((F.col("a") + F.col("b") + F.col("c")) * F.when(F.col("c") > F.col("b"), 7).otherwise(1)).alias("check_sum"))
    return v.join(half, "raster_id", "left").select("raster_id", "n_vertices", "sum_z", "sum_x", F.coalesce("n_faces", F.lit(0)).alias("n_faces"), F.coalesce("check_sum", F.lit(0)).alias("check_sum"))


@query("g18_camera_plan", "scenes", sql="""
WITH s AS (SELECT *, degrees(2 * atan(plot_size_x / (2 * camera_height))) AS h FROM scenes)
SELECT scene_id, round(h, 6) AS hfov, round(degrees(2 * atan(plot_size_x * 1.1 / (2 * camera_height))), 6) AS hfov_margin, round(degrees(2 * atan(plot_size_y * 1.1 / (2 * camera_height))), 6) AS vfov_margin,
  round(degrees(2 * atan(tan(radians(h) / 2) / (plot_size_x / plot_size_y))), 6) AS vfov, round(degrees(2 * atan(sqrt(power(tan(radians(h) / 2), 2) + power(tan(radians(h) / 2) / (plot_size_x / plot_size_y), 2)))), 6) AS dfov, round(camera_height - 0.5, 6) AS focal_distance FROM s""")
def _g18(scenes):
    return rounded(G.camera_plan(scenes), ["scene_id"], "hfov", "hfov_margin", "vfov_margin", "vfov", "dfov", "focal_distance")


@query("g19_exposure_plan", "scenes", sql="""
WITH s AS (SELECT *, CASE WHEN scene_id % 5 = 0 THEN 6400 ELSE 100 + scene_id % 3 * 100 END AS iso0 FROM scenes)
SELECT scene_id, CAST(trunc(CASE WHEN iso0 > 1000 THEN CAST(100 AS DOUBLE) ELSE iso0 END * power(CAST(129.63 AS DOUBLE) / CAST(2.8 AS DOUBLE) / CAST(2.8 AS DOUBLE), 2) * CAST(0.25 AS DOUBLE) / greatest(CAST(0.1 AS DOUBLE), sin(radians(sun_elevation)))) AS INT) AS iso, CAST(0.008 AS DOUBLE) AS shutter_time FROM s""")
def _g19(scenes):
    iso = F.when(F.col("scene_id") % 5 == 0, 6400).otherwise(100 + F.col("scene_id") % 3 * 100)
    return G.exposure_plan(scenes, iso, F.lit(0.0)).select("scene_id", "iso", F.round("shutter_time", 6).alias("shutter_time"))


@query("g20_focus_camera", "vertices", sql="""
WITH b AS (SELECT object_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2, CAST(object_id % 3 AS DOUBLE) AS ox, CAST(-(object_id % 3) AS DOUBLE) / 2 AS oy, CAST(5 AS DOUBLE) AS oz FROM vertices GROUP BY object_id),
e AS (SELECT *, sqrt(ox * ox + oy * oy + oz * oz) AS len, sqrt(ox * ox + oy * oy) AS flat FROM b),
f AS (SELECT *, ox / len AS zx, oy / len AS zy, oz / len AS zz, CASE WHEN flat / len < 1e-6 THEN 1 ELSE -oy / flat END AS rx, CASE WHEN flat / len < 1e-6 THEN 0 ELSE ox / flat END AS ry FROM e),
c AS (SELECT f.*, (sx.s * (x2 - x1) / 2 - ox) AS dx, (sy.s * (y2 - y1) / 2 - oy) AS dy, (sz.s * (z2 - z1) / 2 - oz) AS dz FROM f, (SELECT unnest([-1, 1]) AS s) sx, (SELECT unnest([-1, 1]) AS s) sy, (SELECT unnest([-1, 1]) AS s) sz),
h AS (SELECT object_id, max(abs((dx * rx + dy * ry) / -(dx * zx + dy * zy + dz * zz))) AS hx, max(abs((-dx * zz * ry + dy * zz * rx + dz * (zx * ry - zy * rx)) / (dx * zx + dy * zy + dz * zz))) AS hy FROM c GROUP BY object_id)
SELECT object_id, round(CASE WHEN x2 > x1 AND y2 > y1 THEN degrees(greatest(2 * atan(hx * 1.05), 2 * atan(hy * 1.05) / (CAST(1 AS DOUBLE) * 640 / 480))) END, 5) AS hfov,
  round(CASE WHEN x2 > x1 AND y2 > y1 THEN (x1 + x2) / 2 + ox ELSE 2.5 + ox END, 6) AS camera_x, round(CASE WHEN x2 > x1 AND y2 > y1 THEN (z1 + z2) / 2 ELSE 0 END, 6) AS lookat_z FROM b JOIN h USING (object_id)""")
def _g20(vertices):
    turn = (F.col("object_id") % 3).cast("double")
    scenes = vertices.select("object_id").distinct().withColumns({"camera_x": turn + 2.5, "camera_y": -turn / 2 + 0.5, "camera_z": F.lit(5.0), "lookat_x": F.lit(2.5), "lookat_y": F.lit(0.5), "lookat_z": F.lit(0.0), "resolution_x": F.lit(640), "resolution_y": F.lit(480)})
    out = G.focus_camera(vertices, scenes, ["object_id"])
    return out.select("object_id", F.round("hfov", 5).alias("hfov"), F.round("camera_x", 6).alias("camera_x"), F.round("lookat_z", 6).alias("lookat_z"))


@query("g21_field_layout", "plots", sql="SELECT bed, tier, round((bed - 1) * CAST(1.5 AS DOUBLE) - 39 * CAST(1.5 AS DOUBLE) / 2, 6) AS origin_x, round((tier - 1) * CAST(4 AS DOUBLE) - 26, 6) AS origin_y, CAST(0 AS DOUBLE) AS field_x FROM plots")
def _g21(plots):
    grid = G.field_layout(plots.sparkSession, 40, 14, 1.5, 4.0, "centred")
    return plots.select("bed", "tier").join(grid, ["bed", "tier"]).select("bed", "tier", F.round("origin_x", 6).alias("origin_x"), F.round("origin_y", 6).alias("origin_y"), F.round("field_x", 6).alias("field_x"))


@query("g22_canopy_grid", "plots", sql="""
SELECT bed, tier, r.range AS canopy_row, c.range AS canopy_col, round((bed - 1) * CAST(1.5 AS DOUBLE) + (r.range - CAST(0.5 AS DOUBLE)) * CAST(0.75 AS DOUBLE), 4) AS x, round((tier - 1) * CAST(4 AS DOUBLE) + (c.range - 2) * CAST(0.6 AS DOUBLE), 4) AS y FROM plots, range(2) r, range(5) c""")
def _g22(plots):
    grid = plots.select("bed", "tier", ((F.col("bed") - 1) * 1.5).alias("origin_x"), ((F.col("tier") - 1) * 4.0).alias("origin_y"))
    return G.canopy_grid(grid, 2, 5, 0.75, 0.6).select("bed", "tier", "canopy_row", "canopy_col", "x", "y")


@query("g23_rescale_translate", "vertices", sql="""
WITH b AS (SELECT object_id, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM vertices GROUP BY object_id)
SELECT object_id, count(*) AS n, round(sum(-(y * CASE WHEN sy = 0 THEN 1 ELSE 3 / sy END) + 1), 4) AS x, round(sum(x * CASE WHEN sx = 0 THEN 1 ELSE 2 / sx END), 4) AS y FROM vertices JOIN b USING (object_id) GROUP BY object_id""")
def _g23(vertices):
    out = G.rescale_translate(vertices, ["object_id"], (2.0, 3.0, 1.0), (1.0, 0.0, 0.0), 90.0)
    return sums(out, ["object_id"], "x", "y")


@query("g23_copies_on_grid", "vertices", sql="""
WITH m AS (SELECT * FROM vertices WHERE l_linenumber <= 2), b AS (SELECT object_id, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM m GROUP BY object_id),
v AS (SELECT -(y * CASE WHEN sy = 0 THEN 1 ELSE CAST(3.831 AS DOUBLE) / sy END) AS x, x * CASE WHEN sx = 0 THEN 1 ELSE CAST(1.299 AS DOUBLE) / sx END AS y, z FROM m JOIN b USING (object_id))
SELECT d.range + 1 AS bed, t.range + 1 AS tier, count(*) AS n, round(sum(x + d.range * CAST(1.299 AS DOUBLE)), 3) AS x, round(sum(y + t.range * CAST(3.831 AS DOUBLE)), 3) AS y, round(sum(z), 3) AS z FROM v, range(3) d, range(2) t GROUP BY ALL""")
def _g23_grid(vertices):
    # ground meshes of fields of 3 beds and 2 tiers
    ground = G.rescale_translate(vertices.where("l_linenumber <= 2"), ["object_id"], (1.299, 3.831, 0.0), degrees=90.0, axes="xy")
    return sums(G.copies_on_grid(ground, 3, 2, 1.299, 3.831), ["bed", "tier"], "x", "y", "z", digits=3)


@query("g24_ground_drop", "vertices", sql="SELECT object_id, round(CASE WHEN min(z) < 0 THEN min(z) - 0.02 ELSE 0 END, 6) AS shift FROM vertices GROUP BY object_id")
def _g24(vertices):
    return rounded(G.ground_drop(vertices, ["object_id"]), ["object_id"], "shift")


@query("g25_bed_pixels_to_metres", "raster", sql="SELECT row, col, round((281 - col) / CAST(281 AS DOUBLE) * 2 * 2.0 - 1.0, 6) AS bed_x, round(row / CAST(376 AS DOUBLE) * 4.0 - 2.0, 6) AS bed_y FROM raster")
def _g25(raster):
    out = G.bed_pixels_to_metres(raster.withColumns({"px": F.col("col").cast("double"), "py": F.col("row").cast("double")}), 281.0, 376.0)
    return rounded(out, ["row", "col"], "bed_x", "bed_y")


@query("s4_yolo_lines", "boxes", sql="SELECT category_id, count(*) AS n, round(sum(round(x_c, 6)), 3) AS x_c, round(sum(round(h, 6)), 3) AS h FROM boxes WHERE l_linenumber <> 7 GROUP BY category_id")
def _s4(boxes):
    path = f"{shared_dir(boxes.sparkSession)}/plotweave/yolo-{uuid.uuid4().hex}"
    bucket = (F.col("image_id") % 16).alias("bucket")
    K.write_yolo(boxes.where("l_linenumber != 7").withColumn("bucket", bucket), f"{path}/lines", ("bucket",))
    # short and blank lines are skipped
    boxes.where("l_linenumber = 7").select(bucket, F.lit("  1 0.5 ").alias("value")).write.partitionBy("bucket").mode("append").text(f"{path}/lines")
    return sums(S.read_yolo(boxes.sparkSession, f"{path}/lines"), ["category_id"], "x_c", "h", digits=3)


@query("s6_label_matrix", "raster", sql="SELECT row, col, v AS class FROM raster")
def _s6(raster):
    # one matrix file per 50 rows
    path = f"{shared_dir(raster.sparkSession)}/plotweave/matrix-{uuid.uuid4().hex}"
    lines = raster.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("c")).select("row", F.concat(F.array_join(F.transform("c", lambda c: c["v"].cast("string")), " "), F.lit(" ")).alias("line"))
    files = lines.groupBy(F.floor(F.col("row") / 50).alias("part")).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    files.select("part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value")).write.partitionBy("part").text(path)
    cells = S.read_label_matrix(raster.sparkSession, path)
    return cells.select((F.col("part").cast("long") * 50 + F.col("row")).alias("row"), F.col("col").cast("long").alias("col"), "class")


@query("k2_coco_documents", "boxes", sql="""
SELECT image_id, count(*) AS n_annotations, 6 AS n_categories, min(id) AS first_id, count(*) AS n_read FROM (SELECT image_id, l_linenumber * 10000 + l_partkey AS id FROM boxes) GROUP BY image_id""")
def _k2(boxes):
    from plotweave.operators.aggregates import ORGANS

    images = boxes.select("image_id").distinct().withColumns({"width": F.lit(640), "height": F.lit(480)})
    anns = boxes.select("image_id", (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("id"), "category_id", "x_c")
    cats = boxes.sparkSession.createDataFrame(list(enumerate(ORGANS)), "id long, name string")
    path = f"{shared_dir(boxes.sparkSession)}/plotweave/coco-{uuid.uuid4().hex}"
    K.write_coco(images.withColumn("bucket", F.col("image_id") % 8), anns, cats, path, ("bucket",))
    doc = F.from_json("value", "images array<struct<id:long>>, annotations array<struct<id:long,image_id:long>>, categories array<struct<id:long>>")
    out = boxes.sparkSession.read.text(path).select(doc.alias("d"))
    own = F.size(F.filter("d.annotations", lambda a: a["image_id"] == F.col("d.images")[0]["id"]))
    return out.select(F.col("d.images")[0]["id"].alias("image_id"), F.size("d.annotations").cast("long").alias("n_annotations"), F.size("d.categories").alias("n_categories"), F.col("d.annotations")[0]["id"].alias("first_id"), own.cast("long").alias("n_read"))


@query("k3_yolo_lines", "boxes", sql="SELECT l_suppkey % 40 + 1 AS bed, count(*) AS n, min(printf('%d %.6f %.6f %.6f %.6f', category_id, x_c, y_c, w, h)) AS first_line, max(printf('%d %.6f %.6f %.6f %.6f', category_id, x_c, y_c, w, h)) AS last_line FROM boxes GROUP BY 1")
def _k3(boxes):
    path = f"{shared_dir(boxes.sparkSession)}/plotweave/yolo-{uuid.uuid4().hex}"
    K.write_yolo(_placed(boxes), path, ("bed",))
    return boxes.sparkSession.read.text(path).groupBy(F.col("bed").cast("long").alias("bed")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_line"), F.max("value").alias("last_line"))


@query("k4_survey_documents", "plants", sql="""
SELECT dap, bed AS plot, list_aggregate(list_sort(list(DISTINCT crop_type)), 'string_agg', ',') AS crop_types, count(DISTINCT bed) AS n_beds, count(DISTINCT tier) AS n_rows, count(*) AS n_crops, round(min(x) FILTER (tier = t0), 6) AS first_x
FROM (SELECT *, min(tier) OVER (PARTITION BY dap, bed) AS t0 FROM plants) GROUP BY dap, bed""")
def _k4(plants):
    rows = plants.select("dap", F.col("bed").alias("plot"), "bed", F.col("tier").alias("row"), "x", "y", "crop_type", "crop_height")
    path = f"{shared_dir(plants.sparkSession)}/plotweave/survey-{uuid.uuid4().hex}"
    K.write_survey(rows, ["dap"], ["plot"], path)
    heads, items = read_document_parts(plants.sparkSession, path)
    h = F.from_json(F.concat("value", F.lit("]}")), "dap bigint, plot bigint, crop_types array<string>, n_beds bigint, n_rows bigint, crops array<struct<x:double>>")
    heads = heads.select(h.alias("h")).where(F.size("h.crops") == 0).select("h.*")
    crop = items.select("dap", "plot", F.from_json("value", "bed bigint, row bigint, x double, y double, crop_height double, crop_type string").alias("c"))
    crops = crop.groupBy(F.col("dap").cast("long").alias("dap"), F.col("plot").cast("long").alias("plot")).agg(F.count(F.lit(1)).alias("n_crops"), F.min(F.struct("c.bed", "c.row", "c.x"))["x"].alias("first_x"))
    return heads.join(crops, ["dap", "plot"]).select("dap", "plot", F.array_join("crop_types", ",").alias("crop_types"), "n_beds", "n_rows", "n_crops", F.round("first_x", 6).alias("first_x"))
