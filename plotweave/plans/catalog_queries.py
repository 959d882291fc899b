"""Queries of the catalog, join, aggregation and numbering operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions.names import fallback_chain, json_or
from plotweave.operators import aggregates as A
from plotweave.operators import catalog as C
from plotweave.operators import geo as G
from plotweave.operators import joins as J
from plotweave.operators import numbering as W
from plotweave.sources.parts import read_document_parts, write_document_parts

from .registry import query
from .staging import shared_dir


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


PARTS = "CAST(split_part(file_name, '_', 2) AS INT) AS dap, CAST(split_part(file_name, '_', 4) AS INT) AS bed, CAST(split_part(file_name, '_', 5) AS INT) AS {row}, CAST(split_part(file_name, '_', 6) AS INT) AS idx, split_part(split_part(file_name, '_', 7), '.', 1) AS kind"


@query("p1_parse_artifact_name", "artifacts", sql=f"SELECT file_name, {PARTS.format(row='row')}, CAST(NULL AS VARCHAR) AS method, split_part(file_name, '.', 2) AS ext FROM artifacts")
def _p1(artifacts):
    return C.parse_artifact_name(artifacts)


@query("p2_parse_rover_name", "plots", sql="SELECT concat('AgRowStitch_plot-', bed, '_', tier, '.jpg') AS file_name, CAST(bed AS VARCHAR) AS plot, CAST(tier AS INT) AS idx FROM plots")
def _p2(plots):
    return C.parse_rover_name(plots.select(F.concat(F.lit("AgRowStitch_plot-"), "bed", F.lit("_"), "tier", F.lit(".jpg")).alias("file_name")))


@query("p3_dap_from_name", "scenes", sql="""
SELECT scene_id, CASE WHEN scene_id % 4 = 0 THEN 37 ELSE CAST(datediff('day', DATE '2025-05-11', DATE '2025-05-11' + CAST(scene_id % 120 AS INT)) AS INT) END AS dap FROM scenes""")
def _p3(scenes):
    day = F.date_format(F.date_add(F.lit("2025-05-11").cast("date"), (F.col("scene_id") % 120).cast("int")), "yyyy-MM-dd")
    path = F.when(F.col("scene_id") % 4 == 0, "ortho/rgb.tif").otherwise(F.concat(F.lit("ortho/"), day, F.lit("-rgb.tif")))
    return C.with_dap(scenes.select("scene_id", path.alias("path")), "2025-05-11", "2025-06-17").select("scene_id", "dap")


@query("p4_natural_order", "plots", sql="""
WITH s AS (SELECT CASE WHEN bed % 3 = 0 THEN concat('plot_', tier * 100 + bed) ELSE CAST(tier * 100 + bed AS VARCHAR) END AS stem FROM plots)
SELECT stem, row_number() OVER (ORDER BY TRY_CAST(stem AS BIGINT) IS NULL, TRY_CAST(stem AS BIGINT), stem) AS place FROM s""")
def _p4(plots):
    number = F.col("tier") * 100 + F.col("bed")
    stems = plots.select(F.when(F.col("bed") % 3 == 0, F.concat(F.lit("plot_"), number)).otherwise(number.cast("string")).alias("stem"))
    return C.natural_places(stems).select("stem", "place")


def _docs(scenes: DataFrame) -> DataFrame:
    sun = F.struct(F.when(F.col("scene_id") % 5 == 0, F.lit("high")).otherwise(F.col("sun_elevation").cast("string")).alias("note"), F.col("sun_elevation").alias("elevation_degrees"), F.when(F.col("scene_id") % 4 != 0, F.col("scene_id") % 2).alias("shadow"))
    layout = F.struct(F.when(F.col("scene_id") % 2 == 0, F.col("plot_size_x")).alias("plot_size_x"), F.when(F.col("scene_id") % 3 == 0, F.col("plot_size_x") + 1).alias("size_x"))
    plots = F.array(F.struct(F.col("bed"), F.col("tier"), F.transform(F.sequence(F.lit(1), (F.col("scene_id") % 4).cast("int") + 1), lambda i: F.struct(i.alias("x"))).alias("plants")))
    field = F.struct(layout.alias("layout"), F.when(F.col("scene_id") % 7 != 0, plots).alias("plots"))
    seed = F.when(F.col("scene_id") % 6 == 0, F.col("scene_id")).alias("seed")
    return scenes.select("scene_id", F.parse_json(F.to_json(F.struct(seed, F.struct(sun.alias("sun")).alias("environment"), field.alias("field")))).alias("doc"))


@query("p5_json_or", "scenes", sql="""
SELECT scene_id, sun_elevation AS elevation, CASE WHEN scene_id % 4 = 0 THEN TRUE ELSE scene_id % 2 <> 0 END AS shadow,
  CAST(-1.0 AS DOUBLE) AS note_number, CAST(180.0 AS DOUBLE) AS azimuth FROM scenes""")
def _p5(scenes):
    d = F.col("doc")
    return _docs(scenes).select("scene_id", json_or(d, "$.environment.sun.elevation_degrees", "double", 45.0).alias("elevation"), json_or(d, "$.environment.sun.shadow", "boolean", True).alias("shadow"), json_or(d, "$.environment.sun.note", "double", -1.0).alias("note_number"), json_or(d, "$.environment.sun.azimuth_degrees", "double", 180.0).alias("azimuth"))


@query("p6_fallback_chain", "scenes", sql="""
SELECT scene_id, round(CASE WHEN scene_id % 2 = 0 THEN plot_size_x WHEN scene_id % 3 = 0 THEN plot_size_x + 1 ELSE 1.35 END, 6) AS plot_size_x FROM scenes""")
def _p6(scenes):
    return r6(_docs(scenes).select("scene_id", fallback_chain(F.col("doc"), ["$.field.layout.plot_size_x", "$.field.layout.size_x"], "double", 1.35).alias("plot_size_x")), "plot_size_x")


@query("p7_grid_filter", "plants", sql="SELECT bed, tier, count(*) AS n FROM plants WHERE bed BETWEEN 1 AND 8 AND tier BETWEEN 1 AND 14 GROUP BY bed, tier")
def _p7(plants):
    return C.grid_filter(plants, 1, 8, 1, 14).groupBy("bed", "tier").agg(F.count(F.lit(1)).alias("n"))


def _scene_docs(scenes: DataFrame) -> DataFrame:
    """Documents of which some lack a section, a key or the plants of their first plot."""
    n = F.col("scene_id")
    some = lambda by, c: F.when(n % by != 0, c)
    meta = F.struct(F.lit("cowpea").alias("plant_type"), some(5, n).alias("dap"), some(4, n).alias("year"))
    layout = F.struct(F.lit("manual").alias("mode"), F.when(n % 8 == 0, F.struct(F.lit(1.0).alias("plot_size_x"))).alias("sampling"))
    plant = F.struct(F.lit(1.0).alias("x"), some(9, F.lit(1.0)).alias("y"))
    plots = F.array(F.struct("bed", some(11, F.col("tier")).alias("row"), some(3, F.array(plant)).alias("plants")))
    env = F.struct(F.struct(F.col("sun_elevation").alias("elevation_degrees"), F.lit(0).alias("azimuth_degrees"), F.lit(True).alias("shadow")).alias("sun"), F.struct(F.lit("x").alias("spectral_data")).alias("soil"))
    camera = F.struct(F.struct(*[F.lit(1).alias(c) for c in ("resolution_x", "resolution_y", "focal_plane_distance_difference", "lens_diameter")]).alias("sensor"), F.struct(*[F.lit(1).alias(c) for c in ("camera_height", "azimuth_angle", "distance_from_center")]).alias("positioning"))
    optics = F.struct(*[F.lit(1).alias(c) for c in ("number_layers", "chlorophyll_content", "carotenoid_content", "anthocyan_content", "brown_pigments", "water_mass", "dry_mass")])
    plants = F.struct(optics.alias("leaf_optics"), F.struct(F.lit(1).alias("flower_bud_break_probability")).alias("architecture"))
    doc = F.struct(some(6, n).alias("seed"), meta.alias("metadata"), env.alias("environment"), F.struct(layout.alias("layout"), some(7, plots).alias("plots")).alias("field"), some(10, plants).alias("plant_properties"), camera.alias("camera"))
    return scenes.select("scene_id", F.parse_json(F.to_json(doc)).alias("doc"))


@query("p8_validate_params", "scenes", sql="""
SELECT scene_id, scene_id % 5 <> 0 AND scene_id % 6 <> 0 AND scene_id % 7 <> 0 AND scene_id % 10 <> 0 AS valid, CASE WHEN scene_id % 7 = 0 THEN 0 ELSE 1 END AS n_plots, scene_id % 7 <> 0 AND scene_id % 3 <> 0 AS first_plot_has_plants,
  scene_id % 7 <> 0 AND scene_id % 11 <> 0 AND (scene_id % 3 = 0 OR scene_id % 9 <> 0) AS first_plot_placed,
  concat_ws(',', CASE WHEN scene_id % 6 = 0 THEN 'seed' END, CASE WHEN scene_id % 10 = 0 THEN 'plant_properties' END, CASE WHEN scene_id % 5 = 0 THEN 'metadata.dap' END, CASE WHEN scene_id % 7 = 0 THEN 'field.plots' END) AS missing_required,
  concat_ws(',', CASE WHEN scene_id % 4 = 0 THEN 'metadata.year' END, 'metadata.location', CASE WHEN scene_id % 10 = 0 THEN 'plant_properties.leaf_optics,plant_properties.architecture,plant_properties.leaf_optics.number_layers,plant_properties.leaf_optics.chlorophyll_content,plant_properties.leaf_optics.carotenoid_content,plant_properties.leaf_optics.anthocyan_content,plant_properties.leaf_optics.brown_pigments,plant_properties.leaf_optics.water_mass,plant_properties.leaf_optics.dry_mass' END,
    CASE WHEN scene_id % 8 = 0 THEN 'field.layout.sampling.plot_size_y,field.layout.sampling.plot_size_z' END) AS missing_optional FROM scenes""")
def _p8(scenes):
    out = C.validate_params(_scene_docs(scenes))
    return out.select("scene_id", "valid", "n_plots", "first_plot_has_plants", "first_plot_placed", F.array_join("missing_required", ",").alias("missing_required"), F.array_join("missing_optional", ",").alias("missing_optional"))


@query("p9_apply_overrides", "scenes", sql="SELECT scene_id, bed, tier, CAST(2.5 AS DOUBLE) AS camera_height, CAST(40 AS BIGINT) AS dap FROM scenes")
def _p9(scenes):
    given = {"camera_height": 2.5, "dap": 40, "fov": -1.0, "seed": 0}
    return C.apply_overrides(scenes.withColumn("dap", F.lit(30).cast("long")), given).select("scene_id", "bed", "tier", "camera_height", "dap")


@query("p10_genotype_defaults", "scenes", sql="""
WITH s AS (SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN 'sorghum' ELSE 'cowpea' END AS plant_type,
    CASE scene_id % 5 WHEN 0 THEN 'tall' WHEN 1 THEN 'bush' WHEN 2 THEN 'vine' WHEN 3 THEN 'spreading' ELSE 'wild' END AS genotype,
    CASE WHEN scene_id % 2 = 0 THEN -1.0 ELSE 0.5 END AS internode_length_max, -999.0 AS leaf_pitch FROM scenes)
SELECT scene_id, plant_type, genotype,
  CAST(CASE WHEN internode_length_max >= 0 THEN internode_length_max WHEN plant_type = 'sorghum' THEN CASE genotype WHEN 'tall' THEN 0.28 ELSE -1.0 END
    ELSE CASE genotype WHEN 'bush' THEN 0.03 WHEN 'vine' THEN 0.06 WHEN 'spreading' THEN 0.045 ELSE -1.0 END END AS DOUBLE) AS internode_length_max,
  CAST(CASE WHEN plant_type = 'sorghum' THEN -999.0 ELSE CASE genotype WHEN 'bush' THEN 45.0 WHEN 'vine' THEN 20.0 WHEN 'spreading' THEN 25.0 ELSE -999.0 END END AS DOUBLE) AS leaf_pitch FROM s""")
def _p10(scenes):
    names = F.element_at(F.array(*[F.lit(x) for x in ("tall", "bush", "vine", "spreading", "wild")]), (F.col("scene_id") % 5 + 1).cast("int"))
    s = scenes.select("scene_id", F.when(F.col("scene_id") % 3 == 0, "sorghum").otherwise("cowpea").alias("plant_type"), names.alias("genotype"), F.when(F.col("scene_id") % 2 == 0, -1.0).otherwise(0.5).alias("internode_length_max"), F.lit(-999.0).alias("leaf_pitch"))
    return C.genotype_defaults(s)


@query("p11_box_filter", "boxes", sql="SELECT category_id, count(*) AS n, round(sum(h), 4) AS sum_h FROM boxes WHERE w <= 0.8 AND h <= 0.8 GROUP BY category_id")
def _p11(boxes):
    return C.box_filter(boxes).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("h"), 4).alias("sum_h"))


@query("j1_images_with_sidecars", "artifacts", sql="""
WITH a AS (SELECT regexp_replace(file_name, '_[a-z]+[.]jpeg$', '') AS stem, split_part(split_part(file_name, '_', 7), '.', 1) AS kind, file_name FROM artifacts)
SELECT i.stem, i.file_name, l.file_name AS label_file, p.file_name AS params_file FROM a i LEFT JOIN a l ON l.stem = i.stem AND l.kind = 'boxes'
  LEFT JOIN a p ON p.stem = i.stem AND p.kind = 'params' WHERE i.kind = 'vis'""")
def _j1(artifacts):
    a = C.parse_artifact_name(artifacts).withColumn("stem", F.regexp_replace("file_name", r"_[a-z]+\.jpeg$", ""))
    pick = lambda kind, name: a.where(F.col("kind") == kind).select("stem", F.col("file_name").alias(name))
    return J.images_with_sidecars(pick("vis", "file_name"), pick("boxes", "label_file"), pick("params", "params_file"))


@query("j2_annotations_for_image", "boxes", sql="""
WITH i AS (SELECT DISTINCT image_id AS stem, image_id FROM boxes WHERE image_id % 3 <> 2),
b AS (SELECT image_id AS stem, CASE WHEN image_id % 3 = 0 THEN 1 ELSE l_linenumber % 2 END AS img, category_id, l_linenumber, l_partkey, l_suppkey FROM boxes)
SELECT stem, category_id, count(*) AS n FROM b WHERE (stem % 3 = 0 AND img = 1) OR (stem % 3 = 1 AND img = 0) OR stem % 3 = 2 GROUP BY stem, category_id""")
def _j2(boxes):
    stems = boxes.select(F.col("image_id").alias("stem")).distinct()
    images = stems.withColumn("file_name", F.concat(F.lit("a/b/"), "stem", F.lit(".jpeg")))
    same, other = F.concat("stem", F.lit(".jpeg")), F.concat(F.lit("x"), "stem", F.lit(".jpeg"))
    coco = stems.where("stem % 3 = 0").select("stem", F.lit(1).alias("id"), same.alias("file_name")).unionByName(stems.where("stem % 3 = 1").select("stem", F.explode(F.array(F.lit(0), F.lit(1))).alias("id"), other.alias("file_name")))
    anns = boxes.select(F.col("image_id").alias("stem"), F.when(F.col("image_id") % 3 == 0, 1).otherwise(F.col("l_linenumber") % 2).alias("image_id"), "category_id")
    return J.annotations_for_image(images, coco, anns).groupBy("stem", "category_id").agg(F.count(F.lit(1)).alias("n"))


@query("j3_with_category", "boxes", sql="""
SELECT category_id, CASE category_id WHEN 0 THEN 'internode' WHEN 1 THEN 'petiole' WHEN 2 THEN 'leaf' WHEN 3 THEN 'floral_bud' ELSE concat('Category ', category_id) END AS category_name, count(*) AS n
FROM boxes GROUP BY category_id""")
def _j3(boxes):
    names = boxes.sparkSession.createDataFrame(list(enumerate(A.ORGANS[:4])), "id long, name string")
    return J.with_category(boxes, names).groupBy("category_id", "category_name").agg(F.count(F.lit(1)).alias("n"))


@query("j4_artifacts_to_plots", "artifacts", "plots", sql=f"""
SELECT a.file_name, a.bed, a.tier, round(p.min_lon, 6) AS min_lon FROM (SELECT file_name, {PARTS.format(row='tier')} FROM artifacts) a LEFT JOIN plots p ON a.bed = p.bed AND a.tier = p.tier AND p.tier <= 10""")
def _j4(artifacts, plots):
    a = C.parse_artifact_name(artifacts).withColumnRenamed("row", "tier")
    return J.artifacts_to_plots(a, plots.where("tier <= 10"), keep_unmatched=True).select("file_name", "bed", "tier", F.round("min_lon", 6).alias("min_lon"))


KINDS = ["depth", "temperature", "masks", "boxes", "params", "rad", "vis"]


@query("j5_missing_artifacts", "artifacts", sql=f"""
WITH a AS (SELECT DISTINCT {PARTS.format(row='tier')} FROM artifacts), d AS (SELECT DISTINCT dap FROM a)
SELECT d.dap, b.range + 1 AS bed, t.range + 1 AS tier, k.kind FROM d, range(40) b, range(14) t, (SELECT unnest({KINDS}) AS kind) k
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.dap = d.dap AND a.bed = b.range + 1 AND a.tier = t.range + 1 AND a.kind = k.kind)""")
def _j5(artifacts):
    a = C.parse_artifact_name(artifacts).withColumnRenamed("row", "tier").withColumn("length", F.lit(1))
    # the days of a season times the grid of a field
    days = a.select("dap").distinct().withColumn("bed", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("tier", F.explode(F.sequence(F.lit(1), F.lit(14))))
    grid = days.select("dap", F.col("bed").cast("long").alias("bed"), F.col("tier").cast("long").alias("tier"))
    return J.missing_artifacts(grid, KINDS, a, ("dap", "bed", "tier"))


@query("j6_todo", "scenes", "plants", sql="""
SELECT scene_id, bed, tier FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM plants p WHERE p.bed = s.bed AND p.tier = s.tier AND p.set_id = 7 AND p.bed % 3 = 1) AND scene_id >= 100""")
def _j6(scenes, plants):
    return J.todo(scenes, plants.where("set_id = 7 and bed % 3 = 1"), ["bed", "tier"], "scene_id", 100).select("scene_id", "bed", "tier")


@query("j7_pick_by_dap", "artifacts", sql="""
WITH a AS (SELECT CAST(split_part(file_name, '_', 2) AS INT) AS dap, file_name FROM artifacts)
SELECT d.dap, coalesce((SELECT min(file_name) FROM a WHERE a.dap = d.dap), (SELECT min(file_name) FROM a)) AS file_name FROM (SELECT unnest([10, 30, 45, 90, 100]) AS dap) d""")
def _j7(artifacts):
    daps = artifacts.sparkSession.createDataFrame([(d,) for d in (10, 30, 45, 90, 100)], "dap int")
    return J.pick_by_dap(C.parse_artifact_name(artifacts), daps)


@query("j8_method_or_general", "plants", sql="""
WITH f AS (SELECT DISTINCT dap, bed, CASE WHEN set_id = 1 THEN NULL ELSE concat('m', set_id) END AS method FROM plants WHERE NOT (set_id = 3 AND dap > 50)),
r AS (SELECT *, CASE WHEN method = 'm3' THEN 0 WHEN method IS NULL THEN 1 END AS k FROM f)
SELECT dap, bed, method FROM (SELECT *, min(k) OVER (PARTITION BY dap) AS best FROM r WHERE k IS NOT NULL) WHERE k = best""")
def _j8(plants):
    files = plants.where("not (set_id = 3 and dap > 50)").select("dap", "bed", F.when(F.col("set_id") != 1, F.concat(F.lit("m"), "set_id")).alias("method")).distinct()
    return J.method_or_general(files, "m3")


@query("j9_weather_at", "arrivals", "weather", sql="""
SELECT event_id, round(air_temperature, 6) AS air_temperature, round(et0, 6) AS et0 FROM arrivals JOIN weather ON date_trunc('hour', arrived_at) = hour_ts""")
def _j9(arrivals, weather):
    return r6(J.weather_at(arrivals, weather, "arrived_at").select("event_id", "air_temperature", "et0"), "air_temperature", "et0")


@query("j9_weather_as_of", "arrivals", "weather", sql="""
SELECT event_id, round(air_temperature, 6) AS air_temperature FROM arrivals a ASOF LEFT JOIN (SELECT * FROM weather WHERE extract('hour' FROM hour_ts) % 5 = 0) w ON a.arrived_at >= w.hour_ts""")
def _j9b(arrivals, weather):
    sparse = weather.where(F.hour("hour_ts") % 5 == 0).select("hour_ts", "air_temperature")
    return r6(J.weather_as_of(arrivals, sparse, "arrived_at").select("event_id", "air_temperature"), "air_temperature")


def _rings(plots: DataFrame) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"))
    return plots.select("bed", "tier", ring.alias("ring"), F.col("min_lon").alias("min_x"), F.col("max_lon").alias("max_x"), F.col("min_lat").alias("min_y"), F.col("max_lat").alias("max_y"))


@query("j10_points_in_plots", "plants", "plots", sql="""
WITH pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, CAST(-121.78 AS DOUBLE) + (l_orderkey % 400) * CAST(0.00000175 AS DOUBLE) + CAST(0.0000003 AS DOUBLE) AS px,
  CAST(38.53 AS DOUBLE) + (l_partkey % 1400) * CAST(0.0000004 AS DOUBLE) + CAST(0.0000001 AS DOUBLE) AS py FROM plants)
SELECT p.bed, p.tier, count(*) AS n FROM pts JOIN plots p ON px >= min_lon AND px < max_lon AND py >= min_lat AND py < max_lat GROUP BY p.bed, p.tier""")
def _j10(plants, plots):
    x = F.lit(-121.78) + (F.col("l_orderkey") % 400) * F.lit(0.00000175) + F.lit(0.0000003)
    y = F.lit(38.53) + (F.col("l_partkey") % 1400) * F.lit(0.0000004) + F.lit(0.0000001)
    points = plants.select(x.alias("px"), y.alias("py"))
    return J.points_in_plots(points, _rings(plots), 0.00004, "px", "py").groupBy("bed", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("j11_pixels_in_box", "raster", "plots", sql="""
WITH b AS (SELECT bed, tier, (bed - 1) * 2 AS x1, (bed - 1) * 2 + 5 AS x2, (tier - 1) * 7 AS y1, (tier - 1) * 7 + 9 AS y2 FROM plots)
SELECT bed, tier, count(*) AS n, sum(v) AS sum_v FROM raster r JOIN b ON r.col >= x1 AND r.col < x2 AND r.row >= y1 AND r.row < y2 GROUP BY bed, tier""")
def _j11(raster, plots):
    x, y = (F.col("bed") - 1) * 2, (F.col("tier") - 1) * 7
    boxes = plots.select("bed", "tier", x.alias("x1"), (x + 5).alias("x2"), y.alias("y1"), (y + 9).alias("y2"))
    return J.pixels_in_box(raster, boxes, 16).groupBy("bed", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"))


@query("j12_sample_raster", "plants", "raster", sql="""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, set_id, least(greatest(CAST(trunc(x / CAST(0.02 AS DOUBLE) + 50) AS BIGINT), 0), 99) AS col,
   least(greatest(CAST(trunc(y / CAST(0.1 AS DOUBLE) + 50) AS BIGINT), 0), 99) AS row FROM (SELECT *, y / 5 AS yy FROM plants)),
e AS (SELECT p.*, coalesce(CAST(v AS DOUBLE), 0) AS elevation FROM p LEFT JOIN raster r ON r.row = p.row AND r.col = p.col)
SELECT set_id, count(*) AS n, round(sum(elevation), 3) AS sum_elevation, round(max(elevation) - avg(elevation), 6) AS max_z FROM e GROUP BY set_id""")
def _j12(plants, raster):
    meta = plants.select(F.col("set_id").alias("raster_id")).distinct().withColumns({"width": F.lit(100), "height": F.lit(100), "scale": F.lit(0.02)})
    points = plants.select(F.col("set_id").alias("raster_id"), "x", (F.col("y") / F.lit(0.1) * F.lit(0.02)).alias("y"))
    # the one raster serves all sets: each pixel is listed under them
    sets = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("raster_id")
    pixels = raster.select(sets, "row", "col", "v")
    out = J.sample_raster(points, meta, pixels)
    return out.groupBy(F.col("raster_id").alias("set_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("elevation"), 3).alias("sum_elevation"), F.round(F.max("z"), 6).alias("max_z"))


@query("j13_gt_vs_pred", "plants", sql="""
WITH t AS (SELECT dap, bed, tier, count(*) AS n FROM plants WHERE set_id = 1 GROUP BY 1, 2, 3),
p AS (SELECT dap, bed, tier, concat('m', set_id) AS method, count(*) AS n FROM plants WHERE set_id > 1 GROUP BY 1, 2, 3, 4)
SELECT coalesce(t.dap, p.dap) AS dap, coalesce(t.bed, p.bed) AS bed, coalesce(t.tier, p.tier) AS tier, method, coalesce(t.n, 0) AS n_truth, coalesce(p.n, 0) AS n_pred,
  CASE WHEN method = 'm2' THEN CAST(2.0 AS DOUBLE) WHEN t.n IS NOT NULL THEN CAST(1.35 AS DOUBLE) END AS plot_size_x, CASE WHEN method = 'm2' THEN CAST(4.0 AS DOUBLE) WHEN t.n IS NOT NULL THEN CAST(3.84 AS DOUBLE) END AS plot_size_y
FROM t FULL JOIN p ON t.dap = p.dap AND t.bed = p.bed AND t.tier = p.tier""")
def _j13(plants):
    key = ["dap", "bed", "tier"]
    truth = plants.where("set_id = 1").select(*key, F.lit(1.35).alias("plot_size_x"), F.lit(3.84).alias("plot_size_y"))
    own = F.col("set_id") == 2
    pred = plants.where("set_id > 1").select(*key, F.concat(F.lit("m"), "set_id").alias("method"), F.when(own, 2.0).alias("plot_size_x"), F.when(own, 4.0).alias("plot_size_y"))
    return J.gt_vs_pred(truth, pred)


@query("j14_overlay_priority", "pixels", sql="""
SELECT b.image_id, b.row, b.col, b.band, CASE WHEN t.v IS NOT NULL THEN t.v WHEN b.row = 7 THEN CASE b.band WHEN 0 THEN 119 WHEN 1 THEN 115 ELSE 102 END ELSE b.v END AS v
FROM pixels b LEFT JOIN pixels t ON t.image_id = b.image_id AND t.row = b.col AND t.col = b.row AND t.band = b.band AND b.row < 3""")
def _j14(pixels):
    base = pixels.select("image_id", "row", "col", "band", F.when(F.col("row") != 7, F.col("v")).alias("v"))
    tiles = pixels.select("image_id", F.col("col").alias("row"), F.col("row").alias("col"), "band", "v").where("row < 3")
    return J.overlay_priority(base, tiles, ["image_id", "row", "col"])


FIELD = ["scene_id", "bed", "tier"]


@query("a1_dedupe_plots", "artifacts", sql=f"""
SELECT bed, tier, min(file_name) AS file_name FROM (SELECT file_name, {PARTS.format(row='tier')} FROM artifacts) GROUP BY bed, tier""")
def _a1(artifacts):
    return A.dedupe_plots(C.parse_artifact_name(artifacts).withColumnRenamed("row", "tier").select("bed", "tier", "file_name"))


@query("a2_merge_field", "scenes", "plants", sql="""
WITH f AS (SELECT *, CAST(floor(scene_id / CAST(560 AS DOUBLE)) AS BIGINT) AS field FROM scenes WHERE bed BETWEEN 1 AND 8 AND tier BETWEEN 1 AND 14), n AS (SELECT bed, tier, count(*) AS n_plants FROM plants WHERE dap = 30 GROUP BY 1, 2),
m AS (SELECT field, avg(plot_size_x) AS mx, avg(plot_size_y) AS my, avg(sun_elevation) AS me, avg(coalesce(chlorophyll, 30)) AS mc FROM f GROUP BY field)
SELECT field, f.bed, f.tier, f.bed AS new_bed, 15 - f.tier AS new_tier, coalesce(n_plants, 0) AS n_plants, round(mx, 6) AS mean_plot_size_x, round(my, 6) AS mean_plot_size_y, round(me, 6) AS mean_sun_elevation, round(mc, 6) AS mean_chlorophyll
FROM f LEFT JOIN n USING (bed, tier) JOIN m USING (field)""")
def _a2(scenes, plants):
    fields = scenes.withColumn("field", F.floor(F.col("scene_id") / 560))
    field = A.merge_field(fields, (1, 8), (1, 14), bottom_to_top=False, by=["field"])
    n = plants.where("dap = 30").groupBy("bed", "tier").agg(F.count(F.lit(1)).alias("n_plants"))
    out = field.join(n, ["bed", "tier"], "left").withColumn("n_plants", F.coalesce("n_plants", F.lit(0)))
    means = ["mean_plot_size_x", "mean_plot_size_y", "mean_sun_elevation", "mean_chlorophyll"]
    return r6(out.select("field", "bed", "tier", "new_bed", "new_tier", "n_plants", *means), *means)


@query("a2_merged_documents", "scenes", sql="""
WITH f AS (SELECT *, CAST(floor(scene_id / CAST(560 AS DOUBLE)) AS BIGINT) AS field FROM scenes WHERE bed BETWEEN 1 AND 8 AND tier BETWEEN 1 AND 14),
m AS (SELECT field, avg(plot_size_x) AS mx, avg(plot_size_y) AS my, avg(sun_elevation) AS me, avg(coalesce(chlorophyll, 30)) AS mc, count(*) FILTER (scene_id % 5 <> 0) AS n, sum((9 - bed) * 100 + tier) FILTER (scene_id % 5 <> 0) AS places, sum(scene_id) FILTER (scene_id % 5 <> 0) AS tags, arg_min(scene_id, bed * 100 + tier) AS first FROM f GROUP BY field)
SELECT field, round(mx, 6) AS plot_size_x, round(my, 6) AS shape_y, round(me, 6) AS elevation, CAST(180 AS DOUBLE) AS azimuth, round(mc, 6) AS chlorophyll, 8 AS num_beds, 14 AS num_rows, 'manual' AS mode, CAST(trunc(2000 * (my * 14 / (mx * 8))) AS INT) AS resolution_y, FALSE AS focusing, first AS template, 7 AS iso, n AS n_plots, CAST(places AS BIGINT) AS places, CAST(tags AS BIGINT) AS tags FROM m""")
def _a2_documents(scenes):
    sun = F.struct(F.struct(F.col("sun_elevation").alias("elevation_degrees")).alias("sun"), F.struct(F.lit(1).alias("x")).alias("soil"))
    plots = F.when(F.col("scene_id") % 5 != 0, F.array(F.struct(F.lit(77).alias("bed"), F.col("scene_id").alias("tag"))))
    sizes = F.struct("plot_size_x", "plot_size_y", F.lit("auto").alias("mode"))
    doc = F.struct(F.col("scene_id").alias("seed"), sun.alias("environment"), F.struct(F.struct(F.col("chlorophyll").alias("chlorophyll_content")).alias("leaf_optics")).alias("plant_properties"), F.struct(sizes.alias("layout"), sizes.alias("plot_shape"), plots.alias("plots")).alias("field"), F.struct(F.struct(F.lit(7).alias("ISO")).alias("sensor")).alias("camera"))
    docs = scenes.select(F.floor(F.col("scene_id") / 560).alias("field"), "bed", "tier", F.parse_json(F.to_json(doc)).alias("doc"))
    path = f"{shared_dir(scenes.sparkSession)}/plotweave/merged-{uuid.uuid4().hex}"
    heads, items = A.merged_documents(docs, (1, 8), (1, 14), left_to_right=False, by=["field"])
    write_document_parts(heads, items, ["field"], ["_bed", "_tier"], path, end="]}}")
    heads, items = read_document_parts(scenes.sparkSession, path)
    h = F.from_json(F.concat("value", F.lit("]}}")), """seed bigint, environment struct<sun:struct<elevation_degrees:double,azimuth_degrees:double>,soil:struct<x:int>>, plant_properties struct<leaf_optics:struct<chlorophyll_content:double>>,
      field struct<num_beds:int,num_rows:int,layout:struct<plot_size_x:double,mode:string>,plot_shape:struct<plot_size_y:double>,plots:array<struct<bed:int>>>, camera struct<sensor:struct<ISO:int,resolution_y:int>,positioning:struct<focusing_plants:boolean>>""")
    heads = heads.select(F.col("field").cast("long").alias("field"), h.alias("h")).where("size(h.field.plots) = 0 and h.environment.soil.x = 1")
    p = F.from_json("value", "bed int, row int, tag bigint")
    plots = items.select(F.col("field").cast("long").alias("field"), p.alias("p")).groupBy("field").agg(F.count(F.lit(1)).alias("n_plots"), F.sum(F.col("p.bed") * 100 + F.col("p.row")).alias("places"), F.sum("p.tag").alias("tags"))
    out = heads.select("field", F.col("h.field.layout.plot_size_x").alias("plot_size_x"), F.col("h.field.plot_shape.plot_size_y").alias("shape_y"), F.col("h.environment.sun.elevation_degrees").alias("elevation"), F.col("h.environment.sun.azimuth_degrees").alias("azimuth"), F.col("h.plant_properties.leaf_optics.chlorophyll_content").alias("chlorophyll"), "h.field.num_beds", "h.field.num_rows", "h.field.layout.mode", "h.camera.sensor.resolution_y", F.col("h.camera.positioning.focusing_plants").alias("focusing"), F.col("h.seed").alias("template"), F.col("h.camera.sensor.ISO").alias("iso"))
    return r6(out.join(plots, "field", "left"), "plot_size_x", "shape_y", "elevation", "chlorophyll").withColumn("n_plots", F.coalesce("n_plots", F.lit(0)))


@query("a3_merged_camera", "scenes", sql="""
SELECT bed, CAST(2000 AS INT) AS resolution_x, CAST(trunc(sum(plot_size_y) / sum(plot_size_x) * 2000) AS INT) AS resolution_y, CAST(5.0 AS DOUBLE) AS camera_height FROM scenes GROUP BY bed""")
def _a3(scenes):
    field = scenes.groupBy("bed").agg(F.sum("plot_size_x").alias("total_x"), F.sum("plot_size_y").alias("total_y"))
    return A.merged_camera(field).select("bed", "resolution_x", "resolution_y", "camera_height")


@query("a4_total_bounds", "plots", sql="SELECT tier, min(min_lon) AS min_x, min(min_lat) AS min_y, max(max_lon) AS max_x, max(max_lat) AS max_y FROM plots GROUP BY tier")
def _a4(plots):
    return A.total_bounds(_rings(plots), ["tier"])


@query("a5_bbox3d", "vertices", sql="""
SELECT object_id, round(min(x), 6) AS min_x, round(max(z), 6) AS max_z, round(max(x) - min(x), 6) AS size_x, round(max(y) - min(y), 6) AS size_y, round((max(z) + min(z)) / 2, 6) AS centre_z FROM vertices GROUP BY object_id""")
def _a5(vertices):
    cols = ["min_x", "max_z", "size_x", "size_y", "centre_z"]
    return r6(A.bbox3d(vertices, ["object_id"]).select("object_id", *cols), *cols)


@query("a6_run_summary", "arrivals", sql="""
WITH e AS (SELECT CASE WHEN size_kb > 50 THEN 'success' ELSE 'failed' END AS status, CAST(floor(size_kb) AS BIGINT) AS n_plants, CASE WHEN size_kb <= 50 THEN concat('too small: ', kind) END AS error FROM arrivals)
SELECT count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed, count(*) AS total, sum(n_plants) AS total_plants, string_agg(DISTINCT error, ';' ORDER BY error) AS errors FROM e""")
def _a6(arrivals):
    small = F.col("size_kb") <= 50
    results = arrivals.select(F.when(small, "failed").otherwise("success").alias("status"), F.floor("size_kb").alias("n_plants"), F.when(small, F.concat(F.lit("too small: "), "kind")).alias("error"))
    return A.run_summary(results).withColumn("errors", F.array_join("errors", ";"))


@query("a7_raster_stats", "pixels", sql="""
SELECT image_id, band, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, median(v) AS median, CAST(max(v) - min(v) AS DOUBLE) AS range, count(*) FILTER (v <> 127) AS valid, count(*) AS pixels
FROM (SELECT image_id, band, CAST(v AS DOUBLE) AS v0, CASE WHEN v <> 127 THEN CAST(v AS DOUBLE) END AS v FROM pixels) GROUP BY image_id, band""")
def _a7(pixels):
    return r6(A.raster_stats(pixels, ["image_id", "band"], nodata=127.0), "mean", "std").drop("valid_percent")


@query("a8_raster_histogram", "raster", sql="""
WITH e AS (SELECT min(v) AS lo, max(v) AS hi FROM raster)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / CAST(50 AS DOUBLE))), 49) AS INT) AS bin, count(*) AS n FROM raster, e GROUP BY 1""")
def _a8(raster):
    return A.raster_histogram(raster, [], 50).select("bin", "n")


@query("a9_masked_mean", "pixels", sql="""
SELECT image_id, band, round(avg(CASE WHEN row BETWEEN 2 AND 5 AND v > 120 THEN v END), 6) AS mean, count(*) FILTER (row BETWEEN 2 AND 5 AND v > 120) AS n FROM pixels GROUP BY image_id, band""")
def _a9(pixels):
    return r6(A.masked_mean(pixels, ["image_id", "band"], F.col("row").between(2, 5) & (F.col("v") > 120)), "mean")


@query("a10_plant_survey", "pixels", sql="""
WITH p AS (SELECT image_id, row, col, max(CASE WHEN band = 0 THEN v END) AS red, max(CASE WHEN band = 1 THEN v END) AS green, max(CASE WHEN band = 2 THEN v END) AS blue FROM pixels GROUP BY 1, 2, 3),
b AS (SELECT image_id, k AS plant_id, k * 4 AS x1, k * 4 + 4 AS x2, 1 AS y1, 7 AS y2 FROM (SELECT DISTINCT image_id FROM p), (SELECT unnest([0, 1]) AS k)),
g AS (SELECT image_id, avg(red) AS base FROM p WHERE green <= red GROUP BY 1),
t AS (SELECT b.image_id, plant_id, avg(red) AS top, avg(green) AS green FROM b JOIN p ON p.image_id = b.image_id AND col >= x1 AND col < x2 AND row >= y1 AND row < y2 AND green > red GROUP BY 1, 2)
SELECT b.image_id AS raster_id, b.plant_id, CAST(trunc((x1 + x2) / CAST(2 AS DOUBLE)) AS INT) AS x, 4 AS y, 4 AS width, 6 AS height, round(CAST(trunc((x1 + x2) / CAST(2 AS DOUBLE)) AS INT) * CAST(0.5 AS DOUBLE) - 2, 6) AS offset_x,
  round_even(top - base, 3) AS crop_height FROM b LEFT JOIN t USING (image_id, plant_id) LEFT JOIN g USING (image_id)""")
def _a10(pixels):
    band = lambda i: F.max(F.when(F.col("band") == i, F.col("v")))
    p = pixels.groupBy(F.col("image_id").alias("raster_id"), "row", "col").agg(band(0).alias("red"), band(1).alias("green"), band(2).alias("blue"))
    p = p.withColumns({"dem": F.col("red"), "mask": F.when(F.col("green") > F.col("red"), 1).otherwise(0)})
    ids = pixels.select(F.col("image_id").alias("raster_id")).distinct()
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("plant_id")
    boxes = ids.select("raster_id", k).withColumns({"x1": F.col("plant_id") * 4, "x2": F.col("plant_id") * 4 + 4, "y1": F.lit(1), "y2": F.lit(7)})
    plots = ids.withColumns({"centre_x": F.lit(2.0), "centre_y": F.lit(1.0)})
    out = A.plant_survey(boxes, plots, p, {"xinit": 0.0, "xsize": 0.5, "yinit": 4.0, "ysize": -0.5})
    return out.select("raster_id", "plant_id", "x", "y", "width", "height", "offset_x", "crop_height")


@query("a11_class_counts", "boxes", sql="SELECT image_id, category_id, count(*) AS n, count(*) OVER (PARTITION BY image_id) AS n_classes FROM boxes GROUP BY image_id, category_id")
def _a11(boxes):
    return A.class_counts(boxes)


@query("a12_organ_counts", "vertices", sql="SELECT object_id, " + ", ".join(f"count(*) FILTER (organ = {i}) AS n_{n}" for i, n in enumerate(A.ORGANS)) + " FROM vertices GROUP BY object_id")
def _a12(vertices):
    return A.organ_counts(vertices, ["object_id"])


PLOT = ["bed", "tier"]


@query("a13_par_sum", "primitives", sql="SELECT bed, tier, round(sum(flux_red + flux_green + coalesce(flux_blue, 0)), 4) AS par FROM primitives GROUP BY bed, tier")
def _a13(primitives):
    return A.with_par(primitives).groupBy(*PLOT).agg(F.round(F.sum("par"), 4).alias("par"))


@query("a14_stomatal_proxy", "primitives", sql="SELECT bed, tier, round(avg(least(0.6, 0.05 + (flux_red + flux_green + coalesce(flux_blue, 0)) / 400 * 0.55)), 6) AS gs FROM primitives GROUP BY bed, tier")
def _a14(primitives):
    return A.with_stomatal_proxy(A.with_par(primitives)).groupBy(*PLOT).agg(F.round(F.avg("gs"), 6).alias("gs"))


@query("a15_wue", "primitives", sql="""
SELECT bed, tier, round(avg(CASE WHEN t > 1e-6 THEN net_photosynthesis / t ELSE 0 END), 6) AS wue, round(avg(t), 6) AS transpiration FROM (SELECT *, latent_flux / 44000 * 1000 AS t FROM primitives) GROUP BY bed, tier""")
def _a15(primitives):
    return r6(A.wue(primitives, PLOT), "wue", "transpiration")


@query("a16_surface_temperature", "primitives", sql="""
SELECT bed, tier, round(avg(temperature) FILTER (surface = 'leaf'), 6) AS leaf_k, round(avg(temperature) FILTER (surface = 'ground'), 6) AS ground_k, round(avg(temperature) FILTER (surface = 'leaf') - 295, 6) AS leaf_dt FROM primitives GROUP BY bed, tier""")
def _a16(primitives):
    out = A.with_air_difference(A.surface_temperature(primitives, PLOT).withColumn("air_temperature", F.lit(295.0)))
    return r6(out.select(*PLOT, "leaf_k", "ground_k", "leaf_dt"), "leaf_k", "ground_k", "leaf_dt")


@query("a17_evapotranspiration", "primitives", sql="""
SELECT bed, tier, round(sum(latent_flux * area) / 5.184, 6) AS latent, round(sum(latent_flux * area) / 5.184 / 2264705 * 3600, 6) AS et_mm, round(sum(latent_flux * area) / 5.184 / 2264705 * 3600 / 0.35, 6) AS kc FROM primitives GROUP BY bed, tier""")
def _a17(primitives):
    return r6(A.evapotranspiration(primitives, PLOT, F.lit(5.184), F.lit(0.35)), "latent", "et_mm", "kc")


@query("a18_plant_traits", "vertices", sql="""
SELECT object_id, round(max(z) - min(z), 6) AS height, round(max(z) FILTER (organ = 0) - min(z) FILTER (organ = 0), 6) AS stem_height, count(*) FILTER (organ = 2) AS leaf_count, round(coalesce(sum(area) FILTER (organ = 2), 0), 6) AS leaf_area,
  round(coalesce(sum(area) FILTER (organ = 2 AND y * 10 >= 30 AND y * 10 < 40), 0), 6) AS area_bin_3 FROM (SELECT *, 0 AS k FROM vertices) GROUP BY object_id""")
def _a18(vertices):
    # y * 10 stands for an inclination in hundredths of a right angle
    tilt = F.least(F.floor(F.col("y") * 10 / 10 + 1e-9), F.lit(9)) + 0.5
    out = A.plant_traits(vertices.withColumn("inclination", tilt / 10 * 3.141592653589793 / 2), ["object_id"])
    return r6(out.withColumn("area_bin_3", F.col("inclination_area")[3]).drop("inclination_area"), "height", "stem_height", "leaf_area", "area_bin_3")


@query("a18_mesh_traits", "pixels", sql="""
WITH p AS (SELECT image_id * 3 + band AS raster_id, row, col, (col - 4) * CAST(0.1 AS DOUBLE) AS x, (4 - row) * CAST(0.1 AS DOUBLE) AS y, v * CAST(0.02 AS DOUBLE) AS z FROM pixels WHERE v > 100),
f AS (SELECT a.raster_id, a.row, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS yb, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, d.x AS dx, d.y AS dy, d.z AS dz FROM p a JOIN p b ON b.raster_id = a.raster_id AND b.row = a.row + 1 AND b.col = a.col
  JOIN p c ON c.raster_id = a.raster_id AND c.row = a.row AND c.col = a.col + 1 JOIN p d ON d.raster_id = a.raster_id AND d.row = a.row + 1 AND d.col = a.col + 1),
t AS (SELECT raster_id, row, bx - ax AS ux, yb - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, least(az, bz, cz) AS lo, greatest(az, bz, cz) AS hi FROM f
  UNION ALL SELECT raster_id, row, bx - cx, yb - cy, bz - cz, dx - cx, dy - cy, dz - cz, least(cz, bz, dz), greatest(cz, bz, dz) FROM f),
n AS (SELECT raster_id, row, lo, hi, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM t),
g AS (SELECT *, row % 3 AS organ, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n),
h AS (SELECT *, least(floor(acos(least(1, abs(nz) / l)) / (CAST(3.141592653589793 AS DOUBLE) / 2 / 10)), 9) AS bin FROM g)
SELECT raster_id, round(max(hi) - min(lo), 6) AS height, round(max(hi) FILTER (organ = 0) - min(lo) FILTER (organ = 0), 6) AS stem_height, count(DISTINCT row) FILTER (organ = 2) AS leaf_count, round(coalesce(sum(l / 2) FILTER (organ = 2), 0), 6) AS leaf_area,
  """ + ", ".join(f"round(coalesce(sum(l / 2) FILTER (organ = 2 AND bin = {i}), 0), 6) AS area_bin_{i}" for i in range(10)) + " FROM h GROUP BY raster_id")
def _a18_mesh(pixels):
    dem = pixels.select((F.col("image_id") * 3 + F.col("band")).alias("raster_id"), "row", "col", F.when(F.col("v") > 100, F.col("v")).alias("v"))
    vertices, faces = G.dem_mesh(dem, 0.1, 0.02)
    # rows of quads stand for organs: stem, petiole, leaf and again
    row = vertices.groupBy("raster_id", F.col("vertex_id").alias("a")).agg(F.min("row").alias("part"))
    traits = A.mesh_traits(vertices, faces.join(row, ["raster_id", "a"]).withColumn("organ", F.col("part") % 3))
    bins = [F.round(F.col("inclination_area")[i], 6).alias(f"area_bin_{i}") for i in range(10)]
    return traits.select("raster_id", *[F.round(c, 6).alias(c) for c in ("height", "stem_height")], "leaf_count", F.round("leaf_area", 6).alias("leaf_area"), *bins)


@query("a19_blend_spectra", "raster", sql="""
WITH s AS (SELECT concat('s', row % 2) AS name, col AS wavelength, avg(v) AS value FROM raster GROUP BY 1, 2),
w AS (SELECT unnest(['flower_closed', 'flower_open', 'pod']) AS target, unnest([0.35, 0.10, 0.95]) AS a, unnest([0.65, 0.90, 0.05]) AS b)
SELECT target, wavelength, round(sum(CASE name WHEN 's0' THEN a ELSE b END * value), 6) AS value FROM s, w GROUP BY target, wavelength""")
def _a19(raster):
    spectra = raster.groupBy(F.concat(F.lit("s"), F.col("row") % 2).alias("name"), F.col("col").alias("wavelength")).agg(F.avg("v").alias("value"))
    weights = raster.sparkSession.createDataFrame([(t, n, w) for t, a, b in A.ORGAN_BLENDS for n, w in (("s0", a), ("s1", b))], "target string, name string, weight double")
    return r6(A.blend_spectra(spectra, weights), "value")


ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("w1_global_annotation_ids", "boxes", sql=f"""
SELECT bed, tier, count(*) AS n, min(id) AS first_id, max(id) AS last_id, sum(id * category_id) AS check_sum FROM (SELECT *, row_number() OVER (ORDER BY bed, tier, image_id, l_linenumber, l_partkey, l_suppkey, x_c, y_c, w, h) - 1 AS id
  FROM (SELECT *, l_suppkey % 40 + 1 AS bed, l_partkey % 14 + 1 AS tier FROM boxes)) GROUP BY bed, tier""")
def _w1(boxes):
    rows = boxes.withColumns({"bed": F.col("l_suppkey") % 40 + 1, "tier": F.col("l_partkey") % 14 + 1})
    out = W.global_annotation_ids(rows, ["image_id", *ALL.split(", ")[1:], "x_c", "y_c", "w", "h"])
    return out.groupBy("bed", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("annotation_id").alias("first_id"), F.max("annotation_id").alias("last_id"), F.sum(F.col("annotation_id") * F.col("category_id")).alias("check_sum"))


@query("w2_global_plant_ids", "plants", sql=f"""
SELECT bed, tier, min(id) AS first_id, max(id) AS last_id, sum(id * l_linenumber) AS check_sum FROM (SELECT *, row_number() OVER (ORDER BY bed, tier, {ALL}, x, y, crop_height, crop_type) AS id FROM plants) GROUP BY bed, tier""")
def _w2(plants):
    out = W.global_plant_ids(plants, [*ALL.split(", "), "x", "y", "crop_height", "crop_type"])
    return out.groupBy("bed", "tier").agg(F.min("plant_id").alias("first_id"), F.max("plant_id").alias("last_id"), F.sum(F.col("plant_id") * F.col("l_linenumber")).alias("check_sum"))


@query("w3_organ_instance_ids", "vertices", sql="""
SELECT organ, object_id, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY organ ORDER BY object_id, l_linenumber, l_partkey, l_suppkey, x, y, z) - 1 AS id FROM vertices) GROUP BY organ, object_id""")
def _w3(vertices):
    out = W.organ_instance_ids(vertices, ["object_id"], ["l_linenumber", "l_partkey", "l_suppkey", "x", "y", "z"])
    return out.groupBy("organ", "object_id").agg(F.min("instance_id").alias("first_id"), F.max("instance_id").alias("last_id"))


@query("w4_grid_index", "plots", sql="SELECT bed, tier, (tier - 1) * 40 + bed - 1 AS idx, bed AS bed_again, tier AS tier_again FROM plots")
def _w4(plots):
    out = plots.select("bed", "tier", W.grid_index(F.col("bed"), F.col("tier")).alias("idx"))
    bed, tier = W.grid_place(F.col("idx"))
    return out.withColumns({"bed_again": bed, "tier_again": tier})


@query("w5_sorted_merge", "scenes", sql="SELECT CAST(floor(scene_id / CAST(560 AS DOUBLE)) AS BIGINT) AS field, string_agg(concat(bed, '/', tier, '/', scene_id), ',' ORDER BY bed, tier, scene_id) AS plots FROM scenes GROUP BY 1")
def _w5(scenes):
    merged = W.sorted_merge(scenes.withColumn("field", F.floor(F.col("scene_id") / 560)), ["scene_id"], ["field"])
    return merged.select("field", F.array_join(F.transform("plots", lambda p: F.concat_ws("/", p["bed"].cast("string"), p["tier"].cast("string"), p["scene_id"].cast("string"))), ",").alias("plots"))


@query("w6_sample_plots", "plots", sql="SELECT bed, tier FROM plots ORDER BY md5(concat_ws('|', '42', bed, tier)), bed, tier LIMIT 6")
def _w6(plots):
    return W.sample_plots(plots, ["bed", "tier"]).select("bed", "tier")


@query("w7_first_n", "artifacts", sql="SELECT file_name FROM artifacts ORDER BY file_name LIMIT 10")
def _w7(artifacts):
    return W.first_n(artifacts, 10, "file_name")


@query("w8_unique_plots", "plants", sql="SELECT DISTINCT bed, tier FROM plants")
def _w8(plants):
    return W.unique_plots(plants, "bed", "tier")


@query("w9_growth_series", "plants", sql="""
WITH s AS (SELECT bed, tier, dap, round(avg(crop_height), 9) AS h FROM plants GROUP BY 1, 2, 3)
SELECT bed, tier, dap, round(h, 6) AS crop_height, round(h - lag(h) OVER w, 6) AS change, dap - lag(dap) OVER w AS days FROM s WINDOW w AS (PARTITION BY bed, tier ORDER BY dap)""")
def _w9(plants):
    s = plants.groupBy("bed", "tier", "dap").agg(F.round(F.avg("crop_height"), 9).alias("crop_height"))
    return r6(W.growth_series(s, ["bed", "tier"], "crop_height"), "crop_height", "change")
