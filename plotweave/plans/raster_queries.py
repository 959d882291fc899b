"""Queries of the raster, scenario, source, sink and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotweave.functions import colour as C
from plotweave.operators import raster as R
from plotweave.operators import scenario as X
from plotweave.operators import tiles as Tl
from plotweave.sources import readers as S
from plotweave.sources import writers as K
from plotweave.sources.tile_files import read_window, write_tiles
from plotweave.streaming import arrivals as T

from .registry import query
from .staging import shared_dir, staged

DUCK = "CAST({} AS DOUBLE)".format


def _rgb(pixels: DataFrame) -> DataFrame:
    return R.bands_to_columns(pixels.withColumnRenamed("image_id", "raster_id")).where("r is not null and g is not null and b is not null")


RGB = "rgb AS (SELECT image_id AS raster_id, row, col, max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS b FROM pixels GROUP BY 1, 2, 3 HAVING count(DISTINCT band) = 3)"


def _one(pixels: DataFrame) -> DataFrame:
    """Every band as a raster of its own."""
    return pixels.select((F.col("image_id") * 3 + F.col("band")).alias("raster_id"), "row", "col", "v")


ONE = "px AS (SELECT image_id * 3 + band AS raster_id, row, col, v FROM pixels)"


def _whole(raster: DataFrame) -> DataFrame:
    return raster.select(F.lit(0).alias("raster_id"), "row", "col", "v")


@query("r1_exg", "pixels", sql=f"""
WITH {RGB} SELECT raster_id, row, col, round(greatest(-1, least(1, (2 * g - r - b) / (r + g + b + {DUCK(1e-6)}))), 6) AS v, round(greatest(-1, least(1, (2 * g - r - b) / ((r + g + b) % 256 + {DUCK(1e-6)}))), 6) AS wrapped FROM rgb""")
def _r1(pixels):
    rgb = _rgb(pixels)
    wrapped = R.exg(R.exg(rgb).withColumnRenamed("v", "plain"), wrap_uint8=True)
    return wrapped.select("raster_id", "row", "col", F.round("plain", 6).alias("v"), F.round("v", 6).alias("wrapped"))


@query("r2_exg_raw", "pixels", sql=f"WITH {RGB} SELECT raster_id, row, col, 2 * g - b - r AS v FROM rgb")
def _r2(pixels):
    return R.exg_raw(_rgb(pixels)).select("raster_id", "row", "col", "v")


@query("r3_minmax_scale", "pixels", sql=f"""
WITH {ONE}, e AS (SELECT raster_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT raster_id, row, col, round(CASE WHEN hi > lo THEN (v - lo) / CAST(hi - lo AS DOUBLE) ELSE 0 END * 255, 6) AS v FROM px JOIN e USING (raster_id)""")
def _r3(pixels):
    return R.minmax_scale(_one(pixels)).select("raster_id", "row", "col", F.round("v", 6).alias("v"))


BLUR = f"""d AS (SELECT unnest([-1, 0, 1]) AS d, unnest([{DUCK(0.25)}, {DUCK(0.5)}, {DUCK(0.25)}]) AS w),
h AS (SELECT p.raster_id, p.row, p.col, sum(w * q.v) AS v FROM px p, d JOIN px q ON q.raster_id = p.raster_id AND q.row = p.row AND q.col = 7 - abs(7 - abs(p.col + d.d)) GROUP BY 1, 2, 3),
bl AS (SELECT p.raster_id, p.row, p.col, sum(w * q.v) AS v FROM h p, d JOIN h q ON q.raster_id = p.raster_id AND q.col = p.col AND q.row = 7 - abs(7 - abs(p.row + d.d)) GROUP BY 1, 2, 3)"""


@query("r4_gaussian_blur", "pixels", sql=f"WITH {ONE}, {BLUR} SELECT raster_id, row, col, round(v, 6) AS v FROM bl")
def _r4(pixels):
    return R.gaussian_blur(_one(pixels), 3).withColumn("v", F.round("v", 6))


@query("r5_otsu", "pixels", sql=f"""
WITH {ONE}, h AS (SELECT raster_id, v AS t, count(*) AS n FROM px GROUP BY 1, 2),
c AS (SELECT raster_id, t, sum(n) OVER w AS w0, sum(n * t) OVER w AS s0, sum(n) OVER (PARTITION BY raster_id) AS total, sum(n * t) OVER (PARTITION BY raster_id) AS s FROM h WINDOW w AS (PARTITION BY raster_id ORDER BY t)),
b AS (SELECT raster_id, t, CASE WHEN total > w0 THEN round(CAST(w0 AS DOUBLE) * (total - w0) * power(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / (total - w0), 2), 3) ELSE 0 END AS between FROM c),
r AS (SELECT raster_id, t, row_number() OVER (PARTITION BY raster_id ORDER BY between DESC, t) AS k FROM b)
SELECT raster_id, t AS threshold, round(t / {DUCK(127.5)} - 1, 6) AS scaled FROM r WHERE k = 1""")
def _r5(pixels):
    return R.otsu(_one(pixels)).withColumn("scaled", F.round("scaled", 6))


@query("r6_threshold", "raster", sql="SELECT row, col, CASE WHEN v > 100 THEN 255 ELSE 0 END AS v FROM raster")
def _r6(raster):
    return R.threshold(raster, F.lit(100))


def _near(r: int) -> str:
    pairs = R.ellipse(2 * r + 1)
    return f"k AS (SELECT unnest([{', '.join(str(a) for a, _ in pairs)}]) AS dy, unnest([{', '.join(str(b) for _, b in pairs)}]) AS dx)"


@query("r7_morphology", "raster", sql=f"""
WITH m AS (SELECT row, col, CASE WHEN v > 20 THEN 255 ELSE 0 END AS v FROM raster), {_near(2)},
e AS (SELECT a.row, a.col, min(b.v) AS v FROM m a, k JOIN m b ON b.row = a.row + dy AND b.col = a.col + dx GROUP BY 1, 2),
o AS (SELECT a.row, a.col, max(b.v) AS v FROM e a, k JOIN e b ON b.row = a.row + dy AND b.col = a.col + dx GROUP BY 1, 2)
SELECT row, col, v FROM o""")
def _r7(raster):
    return R.morphology(R.threshold(_whole(raster), F.lit(20)), "open", R.ellipse(5)).select("row", "col", "v")


COMPONENTS = """p AS (SELECT raster_id, row, col, row * 8 + col AS id FROM px WHERE v > 140),
r AS (SELECT raster_id, id, id AS label FROM p UNION SELECT q.raster_id, q.id, r.label FROM r JOIN p a ON a.raster_id = r.raster_id AND a.id = r.id JOIN p q ON q.raster_id = a.raster_id AND abs(q.row - a.row) <= 1 AND abs(q.col - a.col) <= 1),
lab AS (SELECT p.raster_id, p.row, p.col, l.label FROM p JOIN (SELECT raster_id, id, min(label) AS label FROM r GROUP BY 1, 2) l USING (raster_id, id))"""


def _mask(pixels: DataFrame) -> DataFrame:
    return R.threshold(_one(pixels), F.lit(140))


@query("r8_label_components", "pixels", sql=f"WITH RECURSIVE {ONE}, {COMPONENTS} SELECT raster_id, row, col, label FROM lab")
def _r8(pixels):
    return R.label_components(_mask(pixels))


PROPS = "props AS (SELECT raster_id, label, min(row) AS y1, min(col) AS x1, max(row) + 1 AS y2, max(col) + 1 AS x2, count(*) AS area, avg(row) AS cy, avg(col) AS cx FROM lab GROUP BY 1, 2)"


@query("r9_region_props", "pixels", sql=f"WITH RECURSIVE {ONE}, {COMPONENTS}, {PROPS} SELECT raster_id, label, y1, x1, y2, x2, area, round(cy, 6) AS cy, round(cx, 6) AS cx FROM props")
def _r9(pixels):
    return R.region_props(R.label_components(_mask(pixels))).withColumns({"cy": F.round("cy", 6), "cx": F.round("cx", 6)})


@query("r10_drop_small", "pixels", sql=f"WITH RECURSIVE {ONE}, {COMPONENTS}, {PROPS} SELECT raster_id, row, col, label FROM lab JOIN (SELECT raster_id, label FROM props WHERE greatest(y2 - y1, x2 - x1) >= 3) USING (raster_id, label)")
def _r10(pixels):
    return R.drop_small(staged(R.label_components(_mask(pixels)), "q"), 3).select("raster_id", "row", "col", "label")


SEGMENTS = """seg AS (SELECT raster_id, label, CAST(s AS INT) AS segment, CASE WHEN w >= h THEN x1 + s * step ELSE x1 END AS sx1, CASE WHEN w >= h THEN least(x1 + s * step + step, x2) ELSE x2 END AS sx2,
  CASE WHEN w >= h THEN y1 ELSE y1 + s * step END AS sy1, CASE WHEN w >= h THEN y2 ELSE least(y1 + s * step + step, y2) END AS sy2
  FROM (SELECT *, unnest(range(n)) AS s, CAST(floor(greatest(w, h) / CAST(n AS DOUBLE)) AS BIGINT) AS step FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h, CAST(ceil(greatest(x2 - x1, y2 - y1) / CAST(least(x2 - x1, y2 - y1) AS DOUBLE)) AS BIGINT) AS n FROM props)))"""


@query("r11_split_blobs", "pixels", sql=f"WITH RECURSIVE {ONE}, {COMPONENTS}, {PROPS}, {SEGMENTS} SELECT raster_id, label, segment, sx1, sx2, sy1, sy2 FROM seg")
def _r11(pixels):
    return R.split_blobs(R.region_props(R.label_components(_mask(pixels))))


@query("r12_segment_props", "pixels", sql=f"""
WITH RECURSIVE {ONE}, {COMPONENTS}, {PROPS}, {SEGMENTS}
SELECT s.raster_id, s.label, s.segment, round(coalesce(avg(l.col), (sx1 + sx2) / {DUCK(2)}), 6) AS cx, round(coalesce(avg(l.row), (sy1 + sy2) / {DUCK(2)}), 6) AS cy, coalesce(min(l.col), sx1) AS x1, coalesce(min(l.row), sy1) AS y1, coalesce(max(l.col), sx2) AS x2, coalesce(max(l.row), sy2) AS y2
FROM seg s LEFT JOIN lab l ON l.raster_id = s.raster_id AND l.label = s.label AND l.col >= sx1 AND l.col < sx2 AND l.row >= sy1 AND l.row < sy2 GROUP BY s.raster_id, s.label, s.segment, sx1, sx2, sy1, sy2""")
def _r12(pixels):
    labels = staged(R.label_components(_mask(pixels)), "q")
    out = R.segment_props(R.split_blobs(R.region_props(labels)), labels)
    return out.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


def _passes() -> str:
    """Masks m1 to m10 from m0: open twice, close twice, open once, each pass over a pixel and its four neighbours."""
    steps = ["min", "min", "max", "max", "max", "max", "min", "min", "min", "max"]
    pass_ = "m{1} AS (SELECT a.raster_id, a.row, a.col, {0}(b.v) AS v FROM m{2} a, k JOIN m{2} b ON b.raster_id = a.raster_id AND b.row = a.row + dy AND b.col = a.col + dx GROUP BY 1, 2, 3)"
    return ", ".join(pass_.format(f, i + 1, i) for i, f in enumerate(steps))


PLANTS = f"""WITH RECURSIVE {RGB}, px AS (SELECT raster_id, row, col, greatest(-1, least(1, (2 * g - r - b) / (r + g + b + {DUCK(1e-6)}))) AS v FROM rgb), {BLUR},
q AS (SELECT raster_id, row, col, CAST(floor((v + 1) * {DUCK(127.5)}) AS INT) AS v FROM bl), hist AS (SELECT raster_id, v AS t, count(*) AS n FROM q GROUP BY 1, 2),
cum AS (SELECT raster_id, t, sum(n) OVER w AS w0, sum(n * t) OVER w AS s0, sum(n) OVER (PARTITION BY raster_id) AS total, sum(n * t) OVER (PARTITION BY raster_id) AS s FROM hist WINDOW w AS (PARTITION BY raster_id ORDER BY t)),
bet AS (SELECT raster_id, t, CASE WHEN total > w0 THEN round(CAST(w0 AS DOUBLE) * (total - w0) * power(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / (total - w0), 2), 3) ELSE 0 END AS between FROM cum),
cut AS (SELECT raster_id, t FROM (SELECT raster_id, t, row_number() OVER (PARTITION BY raster_id ORDER BY between DESC, t) AS k FROM bet) WHERE k = 1),
m0 AS (SELECT q.raster_id, row, col, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM q JOIN cut USING (raster_id)), {_near(1)}, {_passes()},
{COMPONENTS.replace("FROM px WHERE v > 140", "FROM m10 WHERE v > 0").replace("r AS (", "rec AS (").replace("FROM r JOIN", "FROM rec r JOIN").replace("FROM r GROUP", "FROM rec GROUP")},
{PROPS.replace("props AS (", "props AS (SELECT * FROM (") + " WHERE greatest(y2 - y1, x2 - x1) >= 2)"}, {SEGMENTS}"""


@query("r13_detect_plants", "pixels", sql=f"""
{PLANTS}, o AS (SELECT s.raster_id, s.label, s.segment, coalesce(avg(l.col), (sx1 + sx2) / {DUCK(2)}) AS cx, coalesce(avg(l.row), (sy1 + sy2) / {DUCK(2)}) AS cy, coalesce(min(l.col), sx1) AS x1, coalesce(min(l.row), sy1) AS y1, coalesce(max(l.col), sx2) AS x2, coalesce(max(l.row), sy2) AS y2
FROM seg s LEFT JOIN lab l ON l.raster_id = s.raster_id AND l.label = s.label AND l.col >= sx1 AND l.col < sx2 AND l.row >= sy1 AND l.row < sy2 GROUP BY s.raster_id, s.label, s.segment, sx1, sx2, sy1, sy2)
SELECT raster_id, label, segment, round(cx, 6) AS cx, round(cy, 6) AS cy, x1, y1, x2, y2, round((cx - 4) * {DUCK(0.0035)}, 6) AS x_m, round(-(cy - 4) * {DUCK(0.0035)}, 6) AS y_m FROM o""")
def _r13(pixels):
    out = R.detect_plants(_rgb(pixels), 0.0035, min_size=2, kernel_small=3, kernel_large=3)
    return out.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "x_m", "y_m")})


def _equalized(source: str, tiles: int) -> str:
    """SQL of `clahe` over a table (raster_id, row, col, v), as CTEs that end in `eq`."""
    return f"""sz AS (SELECT raster_id, max(row) + 1 AS height, max(col) + 1 AS width, CAST(ceil((max(row) + 1) / {DUCK(tiles)}) AS INT) AS th, CAST(ceil((max(col) + 1) / {DUCK(tiles)}) AS INT) AS tw FROM {source} GROUP BY 1),
pt AS (SELECT raster_id, row, col, v, th, tw, CAST(ceil(height / {DUCK('th')}) AS INT) - 1 AS ly, CAST(ceil(width / {DUCK('tw')}) AS INT) - 1 AS lx, (row + 0.5) / {DUCK('th')} - 0.5 AS fy, (col + 0.5) / {DUCK('tw')} - 0.5 AS fx FROM {source} JOIN sz USING (raster_id)),
ct AS (SELECT raster_id, CAST(floor(row / {DUCK('th')}) AS INT) AS ty, CAST(floor(col / {DUCK('tw')}) AS INT) AS tx, v, count(*) AS n FROM pt GROUP BY ALL),
ar AS (SELECT raster_id, ty, tx, CAST(sum(n) AS DOUBLE) AS area, greatest(1, 2 * CAST(sum(n) AS DOUBLE) / 256) AS lim FROM ct GROUP BY ALL),
ex AS (SELECT raster_id, ty, tx, any_value(area) AS area, any_value(lim) AS lim, sum(greatest(n - lim, 0)) AS extra FROM ct JOIN ar USING (raster_id, ty, tx) GROUP BY ALL),
lut AS (SELECT raster_id, ty, tx, v, (sum(least(coalesce(n, 0), lim)) OVER (PARTITION BY raster_id, ty, tx ORDER BY v) + extra * (v + 1) / {DUCK(256)}) / area * 255 AS y
  FROM (SELECT ex.*, CAST(g.range AS INT) AS v FROM ex, range(256) g) LEFT JOIN ct USING (raster_id, ty, tx, v)),
co AS (SELECT raster_id, row, col, v, greatest(0, least(CAST(floor(fy) AS INT) + dy, ly)) AS ty, greatest(0, least(CAST(floor(fx) AS INT) + dx, lx)) AS tx, (1 - abs(fy - floor(fy) - dy)) * (1 - abs(fx - floor(fx) - dx)) AS w FROM pt, (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx)),
eq AS (SELECT raster_id, row, col, CAST(round(round(sum(w * y), 6)) AS INT) AS v FROM co JOIN lut USING (raster_id, ty, tx, v) GROUP BY ALL)"""


@query("r14_clahe", "raster", sql=f"WITH px AS (SELECT 0 AS raster_id, row, col, v FROM raster), {_equalized('px', 8)} SELECT row, col, v FROM eq")
def _r14(raster):
    return R.clahe(_whole(raster)).select("row", "col", "v")


def _lab_sql() -> tuple[str, str]:
    """SQL of 8-bit RGB (r, g, b of `rgb`) to rounded Lab (`lab`: l, a, b) and of Lab (v, a, b) back to r, g and b."""
    mix = lambda row, *c: " + ".join(f"{DUCK(w)} * {x}" for w, x in zip(row, c, strict=True))
    lin = lambda c: f"CASE WHEN {c} / {DUCK(255)} <= {DUCK(0.04045)} THEN {c} / {DUCK(255)} / {DUCK(12.92)} ELSE power(({c} / {DUCK(255)} + {DUCK(0.055)}) / {DUCK(1.055)}, {DUCK(2.4)}) END"
    f = lambda t: f"CASE WHEN {t} > {DUCK(0.008856)} THEN cbrt({t}) ELSE {DUCK(7.787)} * {t} + {DUCK(16)} / 116 END"
    there = f"""li AS (SELECT raster_id, row, col, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM rgb),
xyz AS (SELECT raster_id, row, col, {', '.join(f"({mix(m, 'lr', 'lg', 'lb')}) / {DUCK(w)} AS {n}" for m, w, n in zip(C.TO_XYZ, C.WHITE, 'xyz', strict=True))} FROM li),
ff AS (SELECT raster_id, row, col, {', '.join(f"{f(n)} AS f{n}" for n in 'xyz')} FROM xyz),
lab AS (SELECT raster_id, row, col, CAST(round((116 * fy - 16) * {DUCK(2.55)}) AS INT) AS v, round(500 * (fx - fy) + 128) AS a, round(200 * (fy - fz) + 128) AS b FROM ff)"""
    cube = lambda t: f"CASE WHEN {t} > {DUCK(0.206893)} THEN {t} * {t} * {t} ELSE ({t} - {DUCK(16)} / 116) / {DUCK(7.787)} END"
    gamma = lambda t: f"CAST(round(255 * (CASE WHEN {t} <= {DUCK(0.0031308)} THEN {DUCK(12.92)} * {t} ELSE {DUCK(1.055)} * power({t}, 1 / {DUCK(2.4)}) - {DUCK(0.055)} END)) AS INT)"
    back = f"""gf AS (SELECT raster_id, row, col, (eq.v / {DUCK(2.55)} + 16) / 116 AS fy, (a - 128) / {DUCK(500)} AS da, (b - 128) / {DUCK(200)} AS db FROM eq JOIN lab USING (raster_id, row, col)),
cu AS (SELECT raster_id, row, col, ({cube('(fy + da)')}) * {DUCK(C.WHITE[0])} AS x, {cube('fy')} AS y, ({cube('(fy - db)')}) * {DUCK(C.WHITE[2])} AS z FROM gf),
cl AS (SELECT raster_id, row, col, {', '.join(f"greatest(0, least(1, {mix(m, 'x', 'y', 'z')})) AS {n}" for m, n in zip(C.FROM_XYZ, 'rgb', strict=True))} FROM cu)
SELECT raster_id, row, col, {', '.join(f"{gamma(n)} AS {n}" for n in 'rgb')} FROM cl"""
    return there, back


_THERE, _BACK = _lab_sql()


@query("r14_equalize_colour", "pixels", sql=f"WITH {RGB}, {_THERE}, {_equalized('lab', 2)}, {_BACK}")
def _r14c(pixels):
    return R.equalize_colour(_rgb(pixels), tiles=2)


@query("r15_depth_stretch", "pixels", sql=f"""
WITH {ONE}, e AS (SELECT raster_id, min(v) FILTER (v <= 140) AS lo, max(v) FILTER (v <= 140) AS hi FROM px GROUP BY 1)
SELECT raster_id, row, col, CASE WHEN v > 140 THEN 255 WHEN hi > lo THEN CAST(trunc((v - lo) / CAST(hi - lo AS DOUBLE) * 220) AS INT) ELSE 100 END AS v FROM px JOIN e USING (raster_id)""")
def _r15(pixels):
    return R.depth_stretch(_one(pixels), 140).select("raster_id", "row", "col", "v")


@query("r16_apply_lut", "raster", sql="SELECT row, col, v, 255 - v AS red, v % 16 AS green, 7 AS blue FROM raster")
def _r16(raster):
    lut = raster.sparkSession.range(256).select(F.col("id").cast("int").alias("v"), (255 - F.col("id")).cast("int").alias("red"), (F.col("id") % 16).cast("int").alias("green"), F.lit(7).alias("blue"))
    return R.apply_lut(raster, lut).select("row", "col", "v", "red", "green", "blue")


@query("r17_dem_valid", "raster", sql="SELECT row, col, v <> 3 AS valid FROM raster")
def _r17(raster):
    return R.dem_valid(raster, F.lit(3.0)).select("row", "col", "valid")


@query("g11_resample_affine", "pixels", sql=f"""
WITH {ONE}, c AS (SELECT DISTINCT raster_id, r.range AS row, k.range AS col FROM px, range(6) r, range(6) k),
s AS (SELECT *, CAST(floor({DUCK(0.9)} * (col + 0.5) + {DUCK(0.3)} * (row + 0.5) + {DUCK(0.2)}) AS BIGINT) AS scol, CAST(floor({DUCK(-0.3)} * (col + 0.5) + {DUCK(0.9)} * (row + 0.5) + {DUCK(1.7)}) AS BIGINT) AS srow FROM c)
SELECT s.raster_id, CAST(s.row AS INT) AS row, CAST(s.col AS INT) AS col, v FROM s JOIN px ON px.raster_id = s.raster_id AND px.row = srow AND px.col = scol""")
def _g11(pixels):
    return R.resample_affine(_one(pixels), 6, 6, (0.9, 0.3, 0.2, -0.3, 0.9, 1.7))


@query("g12_resize_raster", "pixels", sql=f"""
WITH {ONE}, c AS (SELECT DISTINCT raster_id, r.range AS row, k.range AS col FROM px, range(4) r, range(4) k)
SELECT c.raster_id, CAST(c.row AS INT) AS row, CAST(c.col AS INT) AS col, round(avg(v), 6) AS v FROM c JOIN px ON px.raster_id = c.raster_id AND px.row IN (2 * c.row, 2 * c.row + 1) AND px.col IN (2 * c.col, 2 * c.col + 1) GROUP BY 1, 2, 3""")
def _g12(pixels):
    return R.resize_raster(_one(pixels), (8, 8), (4, 4), "bilinear").withColumn("v", F.round("v", 6))


U = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)".format


def _templates(scenes: DataFrame) -> DataFrame:
    """A document per scene with literal, uniform, normal and categorical leaves and a nested array."""
    dist = lambda kind, **p: F.struct(F.struct(F.lit(kind).alias("type"), F.struct(*[v.alias(k) for k, v in p.items()]).alias("params")).alias("distribution"))
    spot = F.array(F.struct(F.lit(0.5).alias("x")), F.struct(F.lit(1.5).alias("x")))
    doc = F.struct(dist("uniform", min=F.lit(10), max=F.lit(90)).alias("dap"), dist("normal", mean=F.col("sun_elevation"), std=F.lit(2.0)).alias("sun"), dist("categorical", categories=F.array(F.lit("a"), F.lit("b"))).alias("kind"), F.struct(F.col("camera_height").alias("height"), spot.alias("plants")).alias("field"))
    # the table is one small file, its documents are work for all cores
    spread = scenes.repartition(scenes.sparkSession.sparkContext.defaultParallelism)
    return spread.select("scene_id", F.parse_json(F.to_json(doc)).alias("doc"))


def _draw(path: str, *more: str) -> str:
    return U(", ".join(["'5'", "scene_id", "s.range", f"'{path}'", *[f"'{m}'" for m in more]]))


DRAWN = f"""drawn AS (SELECT scene_id, CAST(s.range AS INT) AS scene, 10 + CAST(floor({_draw('.dap')} * 81) AS BIGINT) AS dap,
  round(sun_elevation + sqrt(-2 * ln(1 - {_draw('.sun', 'u')})) * cos({_draw('.sun', 'v')} * {DUCK(6.283185307179586)}) * 2, 4) AS sun, CASE WHEN {_draw('.kind')} < 0.5 THEN 'a' ELSE 'b' END AS kind, camera_height AS height FROM scenes, range(2) s)"""


def _samples(scenes: DataFrame) -> DataFrame:
    return X.sample_params(X.leaf_distributions(X.flatten_params(_templates(scenes), "scene_id", depth=5)), "scene_id", 2, seed=5)


@query("x1_flatten_params", "scenes", sql="""
SELECT scene_id, unnest(['.dap', '.sun', '.kind', '.field.height', '.field.plants[0].x', '.field.plants[1].x']) AS path, unnest(['distribution', 'distribution', 'distribution', 'literal', 'literal', 'literal']) AS kind FROM scenes""")
def _x1(scenes):
    return X.flatten_params(_templates(scenes), "scene_id", depth=5).select("scene_id", "path", "kind")


@query("x2_sample_params", "scenes", sql=f"""
WITH {DRAWN} SELECT scene_id, scene, unnest(['.dap', '.sun', '.field.height', '.kind']) AS path, round(unnest([CAST(dap AS DOUBLE), sun, height, NULL]), 4) AS number, unnest([NULL, NULL, NULL, kind]) AS word FROM drawn""")
def _x2(scenes):
    s = _samples(scenes).where(~F.col("path").contains("plants"))
    word = F.when(F.col("path") == ".kind", F.replace("drawn", F.lit('"'), F.lit("")))
    return s.select("scene_id", "scene", "path", F.round(F.when(F.col("path") != ".kind", F.col("drawn").cast("double")), 4).alias("number"), word.alias("word"))


@query("x3_assemble_params", "scenes", sql=f"WITH {DRAWN} SELECT scene_id, scene, dap, round(sun, 4) AS sun, kind, round(height, 4) AS height, {DUCK(0.5)} AS x0, {DUCK(1.5)} AS x1, 6 AS n_leaves, TRUE AS typed FROM drawn")
def _x3(scenes):
    out = X.assemble_params(_samples(scenes), "scene_id")
    d = F.from_json("document", "dap bigint, sun double, kind string, field struct<height:double,plants:array<struct<x:double>>>")
    typed = F.col("document").startswith('{"dap":') & F.col("document").rlike('"kind":"[ab]"') & F.try_parse_json("document").isNotNull()
    return out.select("scene_id", "scene", d.alias("d"), typed.alias("typed"), F.col("n_leaves").cast("int").alias("n_leaves")).select("scene_id", "scene", "d.dap", F.round("d.sun", 4).alias("sun"), "d.kind", F.round("d.field.height", 4).alias("height"), F.col("d.field.plants")[0]["x"].alias("x0"), F.col("d.field.plants")[1]["x"].alias("x1"), "n_leaves", "typed")


def _trait(name: str, end: str) -> str:
    return U(f"'42', genotype_id, '{name}-{end}'")


def _traits() -> str:
    cols = []
    for t, (lo, hi, gap, top) in X.GENOTYPE_RANGES.items():
        least = f"({DUCK(lo)} + {_trait(t, 'min')} * {DUCK(hi - lo)})"
        least = f"floor({least})" if t == "plant_count" else least
        start, end = (DUCK(top[0]), top[1]) if gap is None else (f"({least} + {DUCK(gap)})", top)
        most = f"({start} + {_trait(t, 'max')} * ({DUCK(end)} - {start}))"
        cols += [f"{least} AS {t}_min", f"{f'floor({most})' if t == 'plant_count' else most} AS {t}_max"]
    return "traits AS (SELECT genotype_id, " + ", ".join(cols) + " FROM (SELECT scene_id AS genotype_id FROM scenes))"


TRAITS = _traits()
ENDS = [f"{t}_{e}" for t in X.GENOTYPE_RANGES for e in ("min", "max")]


@query("x4_virtual_genotypes", "scenes", sql=f"WITH {TRAITS} SELECT genotype_id, {', '.join(f'round({c}, 6) AS {c}' for c in ENDS)} FROM traits")
def _x4(scenes):
    made = X.with_traits(scenes.select(F.col("scene_id").alias("genotype_id")))
    return made.select("genotype_id", *[F.round(c, 6).alias(c) for c in ENDS])


def _matrix(scenes: DataFrame) -> DataFrame:
    # the table is one small file, its plans are work for all cores; both sides are dealt alike, so the join takes them as they are
    n = 4 * scenes.sparkSession.sparkContext.defaultParallelism
    made = X.with_traits(scenes.select(F.col("scene_id").alias("genotype_id")).repartition(n, "genotype_id"))
    gone = scenes.where("scene_id % 7 = 0").select(F.col("scene_id").alias("genotype_id"), F.lit(20).alias("dap"), F.lit(1).alias("scene"))
    return X.scene_matrix(made, [10, 20, 30], 4, gone.repartition(n, "genotype_id"))


MATRIX = "(SELECT unnest([10, 20, 30]) AS dap) d, range(4) s WHERE NOT (scene_id % 7 = 0 AND d.dap = 20 AND s.range = 1)"


@query("x5_scene_matrix", "scenes", sql=f"SELECT scene_id AS genotype_id, d.dap, CAST(s.range AS INT) AS scene FROM scenes, {MATRIX}")
def _x5(scenes):
    return _matrix(scenes).select("genotype_id", "dap", "scene")


def _of_scene(*salt: str) -> str:
    return U(", ".join(["'42'", "genotype_id", "dap", "scene", *salt]))


PLAN = f"""m AS MATERIALIZED (SELECT t.*, d.dap, CAST(s.range AS INT) AS scene FROM traits t, {MATRIX.replace('scene_id', 'genotype_id')}),
r AS MATERIALIZED (SELECT *, CAST(floor(plant_count_min + {_of_scene("'n'")} * (plant_count_max + 1 - plant_count_min)) AS INT) AS n_plants, CAST(floor({_of_scene("'rows'")} * 4) + 1 AS INT) AS n_rows FROM m),
c AS (SELECT *, greatest(1, CAST(ceil(n_plants / CAST(n_rows AS DOUBLE)) AS INT)) AS n_cols FROM r),
p AS (SELECT genotype_id, dap, scene, n_rows, n_cols, unnest(range(n_plants)) AS plant, plant_spacing_x_min AS ax, plant_spacing_x_max AS bx, plant_spacing_y_min AS ay, plant_spacing_y_max AS yb FROM c WHERE n_plants > 0),
q AS MATERIALIZED (SELECT genotype_id, dap, scene, (ax + {_of_scene('plant', "'x'")} * (bx - ax)) * (plant % n_cols - (n_cols - 1) / CAST(2 AS DOUBLE)) AS x, (ay + {_of_scene('plant', "'y'")} * (yb - ay)) * (floor(plant / CAST(n_cols AS DOUBLE)) - (n_rows - 1) / CAST(2 AS DOUBLE)) AS y FROM p),
e AS (SELECT genotype_id, dap, scene, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM q GROUP BY ALL),
z AS (SELECT c.genotype_id, c.dap, c.scene, n_plants, n_rows, coalesce(dx + mg, 2.5) AS sx, coalesce(dy + mg, 5) AS sy FROM (SELECT *, {DUCK(0.5)} + {_of_scene("'margin'")} * {DUCK(1.5)} AS mg FROM c) c LEFT JOIN e ON e.genotype_id = c.genotype_id AND e.dap = c.dap AND e.scene = c.scene),
w AS (SELECT *, CAST(round_even(sy / sx * round_even(sqrt(921600 * sx / sy), 0), 0) AS INT) AS resolution_y FROM z)"""


@query("x6_scene_plan", "scenes", sql=f"""
WITH {TRAITS.replace("traits AS (", "traits AS MATERIALIZED (")}, {PLAN} SELECT genotype_id, dap, scene, n_plants, n_rows, round(sx, 5) AS plot_size_x, round(sy, 5) AS plot_size_y, resolution_y, CAST(round_even(resolution_y * sx / sy, 0) AS INT) AS resolution_x FROM w""")
def _x6(scenes):
    _, plan = X.scene_plan(_matrix(scenes))
    return plan.select("genotype_id", "dap", "scene", "n_plants", "n_rows", F.round("plot_size_x", 5).alias("plot_size_x"), F.round("plot_size_y", 5).alias("plot_size_y"), "resolution_y", "resolution_x")


SCENE = '{"metadata": {"location": "field", "plant_type": "x"}, "environment": {"sun": {"shadow": true}}, "camera": {"sensor": {"ISO": 100, "resolution_x": 1}}, "seed": 7}'


@query("x7_plots_to_scenes", "plants", "scenes", sql="""
WITH p AS (SELECT bed * 100 + tier AS raster_id, count(*) AS n_plants, min(round_even(x, 4)) AS first_x FROM plants GROUP BY 1), s AS (SELECT bed * 100 + tier AS raster_id, max(plot_size_x) AS w, max(plot_size_y) AS h FROM scenes GROUP BY 1)
SELECT raster_id, coalesce(n_plants, 0) AS n_plants, round(first_x, 4) AS first_x, CAST(0 AS DOUBLE) AS heading, 1080 AS image_height, CAST(round_even(1080 * (w / h), 0) AS INT) AS image_width, round(round_even(w, 4) * 1.1, 6) AS size_x, CAST(0.2 AS DOUBLE) AS size_z, 'field' AS location, 'cowpea' AS plant_type, 2025 AS year, 30 AS dap, TRUE AS shadow, 100 AS iso, 7 AS seed, CAST(1.2 AS DOUBLE) AS camera_height, FALSE AS focusing,
  CASE WHEN raster_id % 2 = 0 THEN concat('g', raster_id, '.obj') END AS ground FROM s LEFT JOIN p USING (raster_id)""")
def _x7(plants, scenes):
    place = (F.col("bed") * 100 + F.col("tier")).alias("raster_id")
    plots = scenes.groupBy(place).agg(F.max("plot_size_x").alias("width_m"), F.max("plot_size_y").alias("height_m")).withColumn("dap", F.lit(30))
    mesh = F.when(F.col("raster_id") % 2 == 0, F.concat(F.lit("g"), "raster_id", F.lit(".obj")))
    out = X.plots_to_scenes(plants.select(place, F.col("x").alias("x_m"), F.col("y").alias("y_m"), F.lit(0.0).alias("z")), plots, SCENE, plant_type="cowpea", buffer=1.1, ground=mesh)
    d = F.from_json("document", """seed int, metadata struct<location:string,plant_type:string,year:int,dap:int>, environment struct<sun:struct<shadow:boolean>,soil:struct<rotate_obj:double,use_obj_ground:boolean,obj_file_path:string>>,
      field struct<layout:struct<plot_size_x:double,plot_size_z:double>,plots:array<struct<plants:array<struct<x:double>>>>>, camera struct<sensor:struct<ISO:int,resolution_x:int,resolution_y:int>,positioning:struct<camera_height:double,focusing_plants:boolean>>""")
    out = out.select("raster_id", d.alias("d"))
    dots = F.col("d.field.plots")[0]["plants"]
    return out.select("raster_id", F.size(dots).cast("long").alias("n_plants"), F.round(F.get(dots, F.lit(0))["x"], 4).alias("first_x"), F.col("d.environment.soil.rotate_obj").alias("heading"), F.col("d.camera.sensor.resolution_y").alias("image_height"), F.col("d.camera.sensor.resolution_x").alias("image_width"), F.round("d.field.layout.plot_size_x", 6).alias("size_x"), F.col("d.field.layout.plot_size_z").alias("size_z"), "d.metadata.location", "d.metadata.plant_type", "d.metadata.year", "d.metadata.dap", "d.environment.sun.shadow", F.col("d.camera.sensor.ISO").alias("iso"), "d.seed", "d.camera.positioning.camera_height", F.col("d.camera.positioning.focusing_plants").alias("focusing"), F.col("d.environment.soil.obj_file_path").alias("ground"))


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/plotweave/{name}-{uuid.uuid4().hex}"


@query("s1_k1_scene_params", "scenes", sql="SELECT scene_id, bed, round(camera_height, 6) AS camera_height, concat('dap_30_plot_', bed, '_', tier) AS name FROM scenes")
def _s1(scenes):
    path = _folder(scenes, "scene-params")
    K.write_scene_params(scenes.withColumn("dap", F.lit(30)).repartition("bed"), path, prefix=True)
    back = S.read_scene_lines(scenes.sparkSession, path)
    d = F.col("doc")
    return back.select(F.try_variant_get(d, "$.scene_id", "long").alias("scene_id"), F.col("bed").cast("long").alias("bed"), F.round(F.try_variant_get(d, "$.camera_height", "double"), 6).alias("camera_height"), F.try_variant_get(d, "$.name", "string").alias("name"))


@query("s2_read_plots", "plots", sql="SELECT bed, tier, round(min_lon, 7) AS min_x, round(max_lat, 7) AS max_y, 5 AS n_points FROM plots")
def _s2(plots):
    at = lambda x, y: F.array(x, y)
    ring = F.array(at("min_lon", "min_lat"), at("max_lon", "min_lat"), at("max_lon", "max_lat"), at("min_lon", "max_lat"), at("min_lon", "min_lat"))
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.col("bed").alias("column"), F.col("tier").alias("row")).alias("properties"))
    path = _folder(plots, "plots")
    plots.groupBy("bed").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("value"), "bed").write.partitionBy("bed").text(path)
    out = S.read_plots(plots.sparkSession, f"{path}/*")
    return out.select(F.col("bed").cast("long").alias("bed"), F.col("tier").cast("long").alias("tier"), F.round("min_x", 7).alias("min_x"), F.round("max_y", 7).alias("max_y"), F.size("ring").alias("n_points"))


@query("s3_read_coco", "boxes", sql="SELECT category_id, count(*) AS n, round(sum(round(x_c, 6)), 2) AS x FROM boxes GROUP BY category_id")
def _s3(boxes):
    path = _folder(boxes, "coco")
    anns = boxes.select("image_id", F.xxhash64("image_id", "l_linenumber").alias("id"), "category_id", F.array(F.round("x_c", 6), "y_c", "w", "h").alias("bbox"))
    images = anns.select("image_id").distinct().withColumns({"file_name": F.concat("image_id", F.lit(".jpeg")), "width": F.lit(640), "height": F.lit(480)})
    cats = boxes.sparkSession.createDataFrame([(0, "internode")], "id long, name string")
    # a document per image, a line each
    K.coco_documents(images, anns, cats).select("value").write.text(path)
    out = S.read_coco(boxes.sparkSession, path, lines=True)["annotations"]
    return out.groupBy(F.col("category_id").cast("int").alias("category_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("bbox")[0]), 2).alias("x"))


@query("s9_tile_window", "raster", "pixels", sql=f"""
WITH {ONE}, r AS (SELECT -1 AS raster_id, row, col, v FROM raster UNION ALL SELECT raster_id, row, col, v FROM px)
SELECT raster_id, 1 AS level, row // 2 AS row, col // 2 AS col, v FROM r WHERE raster_id = -1 AND row % 2 = 1 AND col % 2 = 1 AND row // 2 BETWEEN 3 AND 39 AND col // 2 BETWEEN 5 AND 28
UNION ALL SELECT raster_id, 2, row // 4, col // 4, v FROM r WHERE row % 4 = 2 AND col % 4 = 2""")
def _s9_window(raster, pixels):
    path = _folder(raster, "tiles")
    whole = raster.select(F.lit(-1).cast("long").alias("raster_id"), "row", "col", "v").unionByName(_one(pixels))
    write_tiles(Tl.pyramid(Tl.to_tiles(whole, 16), 2, 16), path)
    window = read_window(raster.sparkSession, path, -1, 1, (3, 40), (5, 29), "int", 16).withColumn("level", F.lit(1))
    return window.unionByName(read_window(raster.sparkSession, path, level=2, kind="int", size=16).withColumn("level", F.lit(2)))


@query("s5_read_classes", "plots", sql="SELECT CAST(bed AS INT) AS id, concat('bed  number ', bed) AS name FROM (SELECT DISTINCT bed FROM plots)")
def _s5(plots):
    path = _folder(plots, "classes")
    plots.select("bed").distinct().select(F.concat(F.lit(" "), "bed", F.lit("\t bed  number "), "bed").alias("value")).write.text(path)
    return S.read_classes(plots.sparkSession, path)


@query("s7_read_labelme", "plots", sql="SELECT CAST(bed AS INT) AS height, CAST(tier - 1 AS INT) AS shape, round(min_lon, 7) AS first_x FROM plots")
def _s7(plots):
    path = _folder(plots, "labelme")
    shape = F.struct("tier", F.array(F.array("min_lon", "min_lat"), F.array("max_lon", "max_lat")).alias("points"))
    docs = plots.groupBy("bed").agg(F.array_sort(F.collect_list(shape)).alias("shapes"))
    docs.select("bed", F.to_json(F.struct("shapes", F.col("bed").alias("imageHeight"), F.lit(10).alias("imageWidth"))).alias("value")).write.partitionBy("bed").text(path)
    out = S.read_labelme(plots.sparkSession, f"{path}/*")
    return out.select(F.col("imageHeight").alias("height"), "shape", F.round(F.col("points")[0]["x"], 7).alias("first_x"))


@query("s8_read_artifacts", "plots", sql="SELECT CAST(bed AS INT) AS bed, TRUE AS filled, 1 AS n FROM (SELECT DISTINCT bed FROM plots)")
def _s8(plots):
    path = _folder(plots, "artifacts")
    plots.select("bed", F.lit("x").alias("value")).distinct().repartition(4, "bed").write.partitionBy("bed").text(path)
    out = S.read_artifacts(plots.sparkSession, path, "*.txt")
    bed = F.regexp_extract("path", r"bed=(\d+)", 1).cast("int").alias("bed")
    return out.groupBy(bed).agg((F.min("length") > 0).alias("filled"), F.count(F.lit(1)).cast("int").alias("n"))


@query("s9_read_raster_table", "raster", sql="SELECT row, col, v FROM raster WHERE row >= 10 AND row < 30 AND col >= 5 AND col < 50")
def _s9(raster):
    path = _folder(raster, "raster")
    raster.repartitionByRange("row").sortWithinPartitions("row", "col").withColumn("unused", F.lit(1)).write.parquet(path)
    return S.read_raster_table(raster.sparkSession, path, ["v"], (10, 30, 5, 50)).select("row", "col", "v")


@query("s10_k5_primitive_data", "primitives", sql="SELECT bed, count(*) AS n, round(sum(area), 4) AS area, round(sum(latent_flux), 2) AS latent_flux FROM primitives GROUP BY bed")
def _s10(primitives):
    path = _folder(primitives, "primitives")
    K.write_primitive_data(primitives, ["bed", "area", "latent_flux"], path)
    back = S.read_table(primitives.sparkSession, path, "bed long, area double, latent_flux double")
    return back.groupBy("bed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"), F.round(F.sum("latent_flux"), 2).alias("latent_flux"))


@query("k6_write_mesh", "pixels", sql="SELECT image_id * 3 + band AS raster_id, count(*) AS n_vertices FROM pixels WHERE v > 100 GROUP BY 1")
def _k6(pixels):
    from plotweave.operators.geo import dem_mesh

    path = _folder(pixels, "mesh")
    K.write_mesh(*dem_mesh(_one(pixels).withColumn("v", F.when(F.col("v") > 100, F.col("v")))), path)
    return pixels.sparkSession.read.parquet(f"{path}/vertices").groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_vertices"))


EVENT_KINDS = "SELECT DISTINCT kind FROM arrivals"


def _streaming(spark: SparkSession) -> SparkSession:
    """A session beside `spark` with the state store that state with timers needs; settings of `spark` stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def _run_stream(out: DataFrame, path: str) -> None:
    """Take what has arrived so far through a stream that goes on from its checkpoint."""
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    _ended(query)


def _ended(query: StreamingQuery) -> None:
    if not query.awaitTermination(600):
        query.stop()
        raise TimeoutError("the stream of arrivals did not end")


@query("t1_completeness", "arrivals", sql=f"""
WITH k AS ({EVENT_KINDS}), a AS (SELECT DISTINCT plot, kind FROM arrivals), m AS (SELECT p.plot, k.kind FROM (SELECT DISTINCT plot FROM a) p, k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.plot = p.plot AND a.kind = k.kind))
SELECT p.plot, CASE WHEN count(m.kind) = 0 THEN 'complete' ELSE 'timed_out' END AS state, coalesce(string_agg(m.kind, ',' ORDER BY m.kind), '') AS missing FROM (SELECT DISTINCT plot FROM a) p LEFT JOIN m USING (plot) GROUP BY p.plot""")
def _t1(arrivals):
    # what arrives is a stream of files; a last row far ahead in event time lets every plot's timer fire
    path = _folder(arrivals, "arrivals")
    rows = arrivals.select(F.col("plot").cast("string").alias("plot"), "kind", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    tick = rows.agg((F.max("arrived_at") + F.expr("interval 100 days")).alias("arrived_at")).select(F.lit("tick").alias("plot"), F.lit("none").alias("kind"), "arrived_at")
    rows.unionByName(tick).write.parquet(f"{path}/in")
    spark = _streaming(rows.sparkSession)
    expected = spark.read.parquet(f"{path}/in").where("plot != 'tick'").select("kind")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    # plots wait longer than the table is
    _run_stream(T.watch_completeness(stream, expected, "arrived_at", timeout_s=40 * 86_400), path)
    out = rows.sparkSession.read.parquet(f"{path}/out").where("plot != 'tick'")
    return out.select(F.col("plot").cast("long").alias("plot"), "state", "missing")


@query("t2_progress", "arrivals", sql="SELECT kind AS status, count(*) AS n FROM arrivals GROUP BY kind")
def _t2(arrivals):
    path, done = _folder(arrivals, "progress"), []
    arrivals.select(F.col("kind").alias("status")).write.parquet(f"{path}/in")
    stream = _streaming(arrivals.sparkSession).readStream.schema("status string").parquet(f"{path}/in")

    def keep(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{path}/out/{batch}")
        done.append(batch)

    query = T.progress(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    _ended(query)
    if not done:  # nothing has arrived
        return arrivals.sparkSession.createDataFrame([], "status string, n bigint")
    # each batch writes all counts so far
    return arrivals.sparkSession.read.schema("status string, n bigint").parquet(f"{path}/out/{max(done)}")


@query("t3_incremental_todo", "arrivals", sql="SELECT DISTINCT plot, kind FROM arrivals")
def _t3(arrivals):
    path = _folder(arrivals, "todo")
    rows = arrivals.select("plot", "kind", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    rows.write.parquet(f"{path}/in")
    stream = _streaming(rows.sparkSession).readStream.schema(rows.schema).parquet(f"{path}/in")
    _run_stream(T.incremental_todo(stream, ["plot", "kind"], "arrived_at").select("plot", "kind"), path)
    return rows.sparkSession.read.parquet(f"{path}/out")


@query("t4_arrivals_per_window", "arrivals", sql="SELECT to_timestamp(floor(epoch(arrived_at) / 15) * 15) AT TIME ZONE 'UTC' AS window_start, count(*) AS n FROM arrivals GROUP BY 1")
def _t4(arrivals):
    # a last row far ahead lets the watermark pass every interval; its own stays open
    path = _folder(arrivals, "windows")
    rows = arrivals.select(F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    rows.unionByName(rows.agg((F.max("arrived_at") + F.expr("interval 1 day")).alias("arrived_at"))).write.parquet(f"{path}/in")
    stream = _streaming(rows.sparkSession).readStream.schema(rows.schema).parquet(f"{path}/in")
    _run_stream(T.arrivals_per_window(stream, "arrived_at"), path)
    out = rows.sparkSession.read.parquet(f"{path}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
