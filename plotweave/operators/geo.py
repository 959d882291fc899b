"""Geospatial, layout and camera-planning operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import projection as P
from plotweave.plans.staging import staged


def with_utm_zone(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return rows.withColumns({"zone": P.utm_zone(F.col(lon)), "epsg": P.epsg(F.col(lon), F.col(lat))})


def to_utm(points: DataFrame, zone: int | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add utm_x and utm_y in `zone` (default: each point's own)."""
    x, y = P.to_utm(F.col(lon), F.col(lat), P.utm_zone(F.col(lon)) if zone is None else F.lit(zone))
    return points.withColumns({"utm_x": x, "utm_y": y})


def from_utm(points: DataFrame, zone: Column, south: Column | None = None, x: str = "utm_x", y: str = "utm_y") -> DataFrame:
    """Add lon and lat."""
    lon, lat = P.from_utm(F.col(x), F.col(y), zone, south)
    return points.withColumns({"lon": lon, "lat": lat})


def bbox_to_utm(bounds: DataFrame, zone: int, convention: str = "corners") -> DataFrame:
    """Boxes (min_lon, min_lat, max_lon, max_lat) to UTM.

    `corners` takes the ends over all four corners; `edges` the lower left and
    upper right corner only.
    """
    at = {f"{a}{b}": P.to_utm(F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.lit(zone)) for a in ("min", "max") for b in ("min", "max")}
    if convention == "edges":
        low, high = at["minmin"], at["maxmax"]
        ends = {"min_x": low[0], "min_y": low[1], "max_x": high[0], "max_y": high[1]}
    else:
        ends = {f"{n}_{c}": f(*[p[i] for p in at.values()]) for i, c in enumerate("xy") for n, f in (("min", F.least), ("max", F.greatest))}
    return bounds.withColumns(ends)


def pixel_to_world(rows: DataFrame, xinit: Column, xsize: Column, yinit: Column, ysize: Column, px: str = "px", py: str = "py") -> DataFrame:
    return rows.withColumns({"world_x": xinit + F.col(px) * xsize, "world_y": yinit + F.col(py) * ysize})


def world_to_pixel(rows: DataFrame, xinit: Column, xsize: Column, yinit: Column, ysize: Column, x: str = "world_x", y: str = "world_y") -> DataFrame:
    """Whole pixels by truncation."""
    return rows.withColumns({"px": ((F.col(x) - xinit) / xsize).cast("int"), "py": ((F.col(y) - yinit) / ysize).cast("int")})


def plot_pixel_window(plots: DataFrame, xinit: float, yinit: float, pixel: float, width: int, height: int) -> DataFrame:
    """Pixel window (y downwards, ends exclusive) of plot bounds in a raster, clamped; empty windows are dropped."""
    clamp = lambda c, n: F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(n))
    out = plots.withColumns({"x1": clamp((F.col("min_x") - xinit) / pixel, width), "x2": clamp((F.col("max_x") - xinit) / pixel, width), "y1": clamp((yinit - F.col("max_y")) / pixel, height), "y2": clamp((yinit - F.col("min_y")) / pixel, height)})
    return out.where("x2 > x1 and y2 > y1").withColumns({"x_size": F.col("x2") - F.col("x1"), "y_size": F.col("y2") - F.col("y1")})


def polygon_rows(windows: DataFrame) -> DataFrame:
    """Windows (y1, y2, ring in pixels, ...) by pixel row, with `spans`: the (c1, c2; end exclusive) of pixels whose centre lies in the ring.

    Where the line through the pixel centres crosses the ring, sorted, an inside
    part begins and ends in turn; edges are half open in y.
    """
    rows = windows.withColumn("row", F.explode(F.sequence(F.col("y1").cast("long"), F.col("y2").cast("long") - 1)))
    ring, n, y = F.col("ring"), F.size("ring"), F.col("row") + 0.5

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return F.when((a["y"] > y) != (b["y"] > y), a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))

    cuts = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), crossing)))
    col = lambda i: F.ceil(F.get("_cuts", i) - 0.5).cast("long")
    spans = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_cuts") - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i < F.size("_cuts"))), lambda i: F.struct(col(i).alias("c1"), col(i + 1).alias("c2")))
    return rows.withColumn("_cuts", cuts).withColumn("spans", spans).drop("_cuts")


def crop_to_plots(pixels: DataFrame, windows: DataFrame, mode: str = "bbox", outside: int | None = 0, tile: int = 64) -> DataFrame:
    """Pixels of each plot window in the plot's own coordinates.

    With `polygon` (windows carry `ring` in pixels) pixels whose centre lies
    outside the ring get `outside`, or are left out when that is None. The ring
    is cut once per row of a window; a pixel meets its row's spans only.
    """
    from .joins import pixels_in_box

    if mode != "polygon":
        out = pixels_in_box(pixels, windows, tile)
    else:
        rows = polygon_rows(windows.where("x2 > x1 and y2 > y1")).withColumnRenamed("row", "_row")
        rows = rows.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("x1") / tile).cast("long"), F.floor((F.col("x2") - 1) / tile).cast("long"))))
        own = pixels.withColumns({"_row": F.col("row").cast("long"), "_tx": F.floor(F.col("col") / tile).cast("long")})
        found = own.join(rows, ["_row", "_tx"]).where((F.col("col") >= F.col("x1")) & (F.col("col") < F.col("x2")))
        hit = F.exists("spans", lambda s: (F.col("col") >= s["c1"]) & (F.col("col") < s["c2"]))
        found = found.where(hit) if outside is None else found.withColumn("v", F.when(hit, F.col("v")).otherwise(outside))
        out = found.drop("_row", "_tx", "spans")
    return out.withColumns({"crop_row": F.col("row") - F.col("y1"), "crop_col": F.col("col") - F.col("x1")})


def local_to_geo(plants: DataFrame, plots: DataFrame, size_x: Column, size_y: Column) -> DataFrame:
    """Local metres from a plot's centre to lon and lat by the plot's own extent in degrees."""
    out = plants.join(plots, ["bed", "tier"])
    lon = (F.col("min_lon") + F.col("max_lon")) / 2 + F.col("x") * ((F.col("max_lon") - F.col("min_lon")) / size_x)
    lat = (F.col("min_lat") + F.col("max_lat")) / 2 + F.col("y") * ((F.col("max_lat") - F.col("min_lat")) / size_y)
    return out.withColumns({"lon": lon, "lat": lat}).select(*plants.columns, "lon", "lat")


def local_to_pixels(plants: DataFrame, size_x: Column, size_y: Column, width: Column, height: Column) -> DataFrame:
    return plants.withColumns({"px": (F.col("x") / size_x + 0.5) * width, "py": (0.5 - F.col("y") / size_y) * height})


def pixels_to_local(centres: DataFrame, mode: str, width: Column, height: Column, pixel: Column | None = None, rover_width: float = 1.2) -> DataFrame:
    """Pixel centres (cx, cy) to metres from the plot's centre; the rover's image is turned and scaled by its height."""
    cx, cy = F.col("cx") - width / 2, F.col("cy") - height / 2
    if mode == "drone":
        return centres.withColumns({"x_m": cx * pixel, "y_m": -cy * pixel})
    scale = rover_width / height
    return centres.withColumns({"x_m": cy * scale, "y_m": cx * scale})


def rotate_plots(plots: DataFrame, degrees: float) -> DataFrame:
    """Rotate all rings (arrays of (x, y)) about the area-weighted centroid of all plots."""
    n = F.size("ring")
    # sums are taken relative to the ring's first point, which keeps them exact for large coordinates
    x0, y0 = F.col("ring")[0]["x"], F.col("ring")[0]["y"]

    def term(acc: Column, i: Column) -> Column:
        a, b = F.get("ring", i), F.get("ring", (i + 1) % n)
        ax, ay, bx, by = a["x"] - x0, a["y"] - y0, b["x"] - x0, b["y"] - y0
        cross = ax * by - bx * ay
        return F.struct((acc["a"] + cross / 2).alias("a"), (acc["x"] + (ax + bx) * cross / 6).alias("x"), (acc["y"] + (ay + by) * cross / 6).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    moments = plots.select(F.aggregate(F.sequence(F.lit(0), n - 1), zero, term).alias("m"), x0.alias("x0"), y0.alias("y0"))
    area = F.abs(F.col("m.a"))
    sign = F.signum("m.a")
    centre = moments.agg((F.sum(sign * F.col("m.x") + area * F.col("x0")) / F.sum(area)).alias("_cx"), (F.sum(sign * F.col("m.y") + area * F.col("y0")) / F.sum(area)).alias("_cy"))
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    turn = lambda p: F.struct((F.col("_cx") + (p["x"] - F.col("_cx")) * c - (p["y"] - F.col("_cy")) * s).alias("x"), (F.col("_cy") + (p["x"] - F.col("_cx")) * s + (p["y"] - F.col("_cy")) * c).alias("y"))
    return plots.join(F.broadcast(centre)).withColumn("ring", F.transform("ring", turn)).drop("_cx", "_cy")


def cell_extents(plots: DataFrame, ncols: int, nrows: int) -> DataFrame:
    """Extent of each cell of a plot's (min_x .. max_y) grid; rows count from the top."""
    cells = plots.withColumn("cell_col", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1)))).withColumn("cell_row", F.explode(F.sequence(F.lit(0), F.lit(nrows - 1))))
    w, h = (F.col("max_x") - F.col("min_x")) / ncols, (F.col("max_y") - F.col("min_y")) / nrows
    return cells.withColumns({"cell_min_x": F.col("min_x") + F.col("cell_col") * w, "cell_max_x": F.col("min_x") + (F.col("cell_col") + 1) * w, "cell_max_y": F.col("max_y") - F.col("cell_row") * h, "cell_min_y": F.col("max_y") - (F.col("cell_row") + 1) * h})


def scene_size(scenes: DataFrame, width: Column, height: Column, buffer: float = 1.0, longest: int = 1080) -> DataFrame:
    """Plot heading, image resolution with a fixed longest side, and buffered plot size."""
    aspect = width / height
    wide = aspect >= 1
    return scenes.withColumns({"heading": F.when(height > width, 0.0).otherwise(90.0), "image_width": F.when(wide, longest).otherwise(F.bround(longest * aspect)).cast("int"), "image_height": F.when(wide, F.bround(longest / aspect)).otherwise(longest).cast("int"), "size_x": F.bround(width, 4) * buffer, "size_y": F.bround(height, 4) * buffer})


def dem_mesh(pixels: DataFrame, scale: float = 1.0, scale_z: float = 1.0, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """Vertices (1-based ids in row-major order, centred) and triangles of the fully valid quads of rasters.

    `pixels` is (raster_id, row, col, v), v null for no data.
    """
    from .numbering import numbered

    kept = pixels.where(f"v is not null and row % {stride} = 0 and col % {stride} = 0")
    size = pixels.groupBy("raster_id").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    ids = staged(numbered(kept, ["raster_id", "row"], ["col"], "n"), "mesh-ids")
    first = ids.groupBy("raster_id").agg(F.min("n").alias("first"))
    ids = ids.join(first, "raster_id").withColumn("vertex_id", F.col("n") - F.col("first") + 1).select("raster_id", "row", "col", "v", "vertex_id")
    vertices = ids.join(size, "raster_id").select("raster_id", "vertex_id", "row", "col", ((F.col("col") - F.col("w") / 2) * scale).alias("x"), ((F.col("h") / 2 - F.col("row")) * scale).alias("y"), (F.col("v") * scale_z).alias("z"), (F.col("col") / F.greatest(F.col("w") - 1, F.lit(1))).alias("u"), (1 - F.col("row") / F.greatest(F.col("h") - 1, F.lit(1))).alias("t"))
    # a vertex and its right neighbour are next in a row's order; only the row below needs a join
    w = Window.partitionBy("raster_id", "row").orderBy("col")
    pair = ids.withColumns({"right": F.when(F.lead("col").over(w) == F.col("col") + stride, F.lead("vertex_id").over(w))}).where("right is not null")
    below = pair.select("raster_id", (F.col("row") - stride).alias("row"), "col", F.col("vertex_id").alias("down"), F.col("right").alias("down_right"))
    quads = pair.join(below, ["raster_id", "row", "col"])
    tri = F.array(F.struct(F.col("vertex_id").alias("a"), F.col("down").alias("b"), F.col("right").alias("c")), F.struct(F.col("right").alias("a"), F.col("down").alias("b"), F.col("down_right").alias("c")))
    return vertices, quads.select("raster_id", F.explode(tri).alias("f")).select("raster_id", "f.*")


def field_of_view(length: Column, height: Column, margin: float = 1.0) -> Column:
    """Degrees that cover a ground length from a height."""
    return F.degrees(2 * F.atan(length * margin / (2 * height)))


def vertical_fov(hfov: Column, aspect: Column) -> Column:
    return F.when(aspect <= 0, hfov).otherwise(F.degrees(2 * F.atan(F.tan(F.radians(hfov) / 2) / aspect)))


def diagonal_fov(hfov: Column, aspect: Column) -> Column:
    t = F.tan(F.radians(hfov) / 2)
    return F.when(aspect <= 0, hfov).otherwise(F.degrees(2 * F.atan(F.sqrt(t * t + (t / aspect) * (t / aspect)))))


def camera_plan(scenes: DataFrame, margin: float = 1.1, beds: int = 1, rows: int = 1, focal_difference: float = 0.5, azimuth: float = 0.0, distance: float = 0.01) -> DataFrame:
    """Fields of view, focal distance, canopy centre and camera position of scenes (plot_size_x, plot_size_y, camera_height)."""
    sx, sy, h = F.col("plot_size_x"), F.col("plot_size_y"), F.col("camera_height")
    turn = F.radians(F.lit(azimuth))
    out = scenes.withColumns({"hfov": field_of_view(sx * beds, h), "hfov_margin": field_of_view(sx * beds, h, margin), "vfov_margin": field_of_view(sy * rows, h, margin), "focal_distance": h - focal_difference, "centre_x": sx * (beds - 1) * 0.5, "centre_y": sy * (rows - 1) * 0.5})
    aspect = (sx * beds) / (sy * rows)
    return out.withColumns({"vfov": vertical_fov(F.col("hfov"), aspect), "dfov": diagonal_fov(F.col("hfov"), aspect), "camera_x": F.col("centre_x") + distance * F.sin(turn), "camera_y": F.col("centre_y") - distance * F.cos(turn), "camera_z": h})


def exposure_plan(scenes: DataFrame, iso: Column, lens_m: Column, focal_mm: float = 129.63, shutter: Column | None = None) -> DataFrame:
    """Dynamic ISO from aperture and sun elevation, and the shutter time of "1/125" or a decimal.

    The sine of the elevation counts as 0.1 at least; an ISO above 1000 was
    computed before and starts from 100 again, and so does one of 0.
    """
    lens = F.when(lens_m < 1e-4, 0.0028).otherwise(lens_m) * 1000
    number = focal_mm / F.greatest(lens, F.lit(0.001))
    base = F.when((iso > 1000) | (iso <= 0), 100.0).otherwise(iso.cast("double"))
    sin_el = F.greatest(F.lit(0.1), F.sin(F.radians("sun_elevation")))
    value = (base * F.pow(number / 2.8, F.lit(2.0)) * 0.25 / sin_el).cast("int")
    text = F.lit("1/125") if shutter is None else shutter
    part = F.split(text, "/")
    time = F.when(text.contains("/"), F.try_divide(F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))
    return scenes.withColumns({"iso": value, "exposure": F.concat(F.lit("ISO"), value.cast("string")), "shutter_time": time})


def _unit(v: list[Column], otherwise: list[float]) -> list[Column]:
    """A vector of length 1, or `otherwise` where it has almost none."""
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [F.when(size < 1e-6, F.lit(o)).otherwise(c / size) for c, o in zip(v, otherwise, strict=True)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def focus_camera(vertices: DataFrame, scenes: DataFrame, by: list[str], margin: float = 1.05) -> DataFrame:
    """Turn a scene's camera to the centre of its vertices' box and refit the horizontal field of view to it.

    `scenes` has camera_x.. and lookat_x.. (their difference is kept) and
    resolution_x, resolution_y. The box's eight corners are projected onto the
    view plane (upright where the camera doesn't look straight down); the larger
    half extents, widened by `margin`, give both fields of view, and a vertical
    one that is larger than the image allows widens the horizontal one. A scene
    without vertices, or whose box has no width or no length, keeps its camera,
    with hfov null.
    """
    from .aggregates import bbox3d

    axes = "xyz"
    rows = scenes.join(bbox3d(vertices, by).select(*by, *[f"{e}_{c}" for e in ("min", "max") for c in axes]), by, "left")
    middle = [(F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in axes]
    offset = [(F.col(f"camera_{c}") - F.col(f"lookat_{c}")).cast("double") for c in axes]
    towards = _unit(offset, [0.0, 0.0, 1.0])
    right = _unit([-towards[1], towards[0], F.lit(0.0)], [1.0, 0.0, 0.0])
    rows = rows.withColumns({f"_{n}{c}": v for n, vector in (("o", offset), ("z", towards), ("r", right), ("u", _cross(towards, right))) for c, v in zip(axes, vector, strict=True)})
    ends = lambda c: F.explode(F.array(F.col(f"min_{c}") - middle[axes.index(c)] - F.col(f"_o{c}"), F.col(f"max_{c}") - middle[axes.index(c)] - F.col(f"_o{c}"))).alias(f"_d{c}")
    corners = rows.select("*", ends("x")).select("*", ends("y")).select("*", ends("z"))
    along = lambda n: sum((F.col(f"_d{c}") * F.col(f"_{n}{c}") for c in axes), F.lit(0.0))
    depth = F.greatest(-along("z"), F.lit(1e-4))
    half = corners.groupBy(*by).agg(F.max(F.abs(along("r") / depth)).alias("_hx"), F.max(F.abs(along("u") / depth)).alias("_hy"))
    angle = lambda c: 2 * F.atan(F.greatest(F.col(c) * margin, F.lit(1e-4)))
    aspect = F.col("resolution_x") / F.greatest(F.col("resolution_y"), F.lit(1))
    wide = (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y"))
    # a scene without vertices has no box, and keeps its camera too
    out = rows.join(half, by, "left")
    moved = {f"camera_{c}": F.when(wide, middle[i] + F.col(f"_o{c}")).otherwise(F.col(f"camera_{c}")) for i, c in enumerate(axes)} | {f"lookat_{c}": F.when(wide, middle[i]).otherwise(F.col(f"lookat_{c}")) for i, c in enumerate(axes)}
    hfov = F.when(wide, F.degrees(F.greatest(angle("_hx"), angle("_hy") / aspect)))
    return out.select(*[moved.get(c, F.col(c)).alias(c) for c in scenes.columns], hfov.alias("hfov"))


def field_layout(spark, beds: int, rows: int, spacing_x: float, spacing_y: float, mode: str = "manual") -> DataFrame:
    """Plot origins: `manual` from 0, `auto` from minus half the total, `centred` about 0; with the field's centre."""
    grid = spark.range(beds * rows).select((F.floor(F.col("id") / rows) + 1).cast("long").alias("bed"), (F.col("id") % rows + 1).alias("tier"))
    shift = {"manual": (0.0, 0.0), "auto": (-beds * spacing_x / 2, -rows * spacing_y / 2), "centred": (-(beds - 1) * spacing_x / 2, -(rows - 1) * spacing_y / 2)}[mode]
    out = grid.withColumns({"origin_x": (F.col("bed") - 1) * spacing_x + shift[0], "origin_y": (F.col("tier") - 1) * spacing_y + shift[1]})
    return out.withColumns({"field_x": F.lit((beds - 1) * spacing_x / 2 + shift[0]), "field_y": F.lit((rows - 1) * spacing_y / 2 + shift[1])})


def canopy_grid(layout: DataFrame, nrows: int, ncount: int, row_spacing: float, plant_spacing: float) -> DataFrame:
    """Plants on a grid centred on each plot's origin, rounded to 4 digits."""
    cells = layout.withColumn("canopy_row", F.explode(F.sequence(F.lit(0), F.lit(nrows - 1)))).withColumn("canopy_col", F.explode(F.sequence(F.lit(0), F.lit(ncount - 1))))
    return cells.withColumns({"x": F.round(F.col("origin_x") + (F.col("canopy_row") - (nrows - 1) / 2) * row_spacing, 4), "y": F.round(F.col("origin_y") + (F.col("canopy_col") - (ncount - 1) / 2) * plant_spacing, 4)})


def rescale_translate(vertices: DataFrame, by: list[str], target: tuple[float, float, float], offset: tuple[float, float, float] = (0.0, 0.0, 0.0), degrees: float = 0.0, axes: str = "xyz") -> DataFrame:
    """Scale each group to a target extent along `axes` (an extent of 0 keeps its size), turn it about z and move it."""
    from .aggregates import bbox3d

    size = bbox3d(vertices, by).select(*by, "size_x", "size_y", "size_z")
    out = vertices.join(size, by)
    x, y, z = (F.col(c) * F.when((F.col(f"size_{c}") == 0) | F.lit(c not in axes), 1.0).otherwise(F.lit(t) / F.nullif(F.col(f"size_{c}"), F.lit(0.0))) for c, t in zip("xyz", target, strict=True))
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    moved = {"x": x * c - y * s + offset[0], "y": x * s + y * c + offset[1], "z": z + offset[2]}
    return out.select(*[moved[n].alias(n) if n in moved else F.col(n) for n in vertices.columns])


def copies_on_grid(vertices: DataFrame, beds: int, rows: int, step_x: float, step_y: float) -> DataFrame:
    """A copy of the vertices for each plot (bed, tier) of a grid, moved by whole plot sizes; the first stays where it is."""
    cells = F.array(*[F.struct(F.lit(b + 1).cast("long").alias("bed"), F.lit(r + 1).cast("long").alias("tier")) for b in range(beds) for r in range(rows)])
    copies = vertices.withColumn("_cell", F.explode(cells)).select(*vertices.columns, "_cell.*")
    return copies.withColumns({"x": F.col("x") + (F.col("bed") - 1) * step_x, "y": F.col("y") + (F.col("tier") - 1) * step_y})


def ground_drop(vertices: DataFrame, by: list[str], margin: float = 0.02) -> DataFrame:
    """How far the ground must move so that the lowest vertex lies above it; 0 where none lies below 0."""
    return vertices.groupBy(*by).agg(F.min("z").alias("min_z")).withColumn("shift", F.when(F.col("min_z") < 0, F.col("min_z") - margin).otherwise(0.0))


def bed_pixels_to_metres(plants: DataFrame, w: float = 281, h: float = 376, width: float = 2.0, length: float = 4.0) -> DataFrame:
    """Survey pixels (px, py) to metres on the bed."""
    return plants.withColumns({"bed_x": (w - F.col("px")) / w * 2 * width - width / 2, "bed_y": F.col("py") / h * length - length / 2})
