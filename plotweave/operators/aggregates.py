"""Aggregations over plots, rasters, annotations and biophysical primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.plans.staging import staged
from plotweave.sources.parts import json_text, object_pairs, object_text


def dedupe_plots(files: DataFrame, by: tuple[str, ...] = ("bed", "tier"), order: str = "file_name") -> DataFrame:
    """The first file of each plot by name."""
    rest = [c for c in files.columns if c not in by]
    first = files.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_f"))
    return first.select(*[F.col(c) if c in by else F.col(f"_f.{c}").alias(c) for c in files.columns])


#: Defaults of a field's means.
FIELD_DEFAULTS = {"plot_size_x": 1.35, "plot_size_y": 3.84, "plot_size_z": 0.2, "sun_elevation": 45.0, "sun_azimuth": 180.0, "chlorophyll": 30.0}


def merge_field(plots: DataFrame, beds: tuple[int, int], tiers: tuple[int, int], left_to_right: bool = True, bottom_to_top: bool = True, by: list[str] | None = None) -> DataFrame:
    """Plots of a grid range with their renumbered place and their field's means; `by` names the field, without it all plots are one.

    Means count a missing value by its default. Numbers start at 1 on the left
    and at the bottom, or at the other end where a flag is off.
    """
    inside = plots.where(F.col("bed").between(*beds) & F.col("tier").between(*tiers))
    means = inside.groupBy(*(by or [])).agg(*[F.avg(F.coalesce(F.col(c), F.lit(d))).alias(f"mean_{c}") for c, d in FIELD_DEFAULTS.items() if c in plots.columns])
    bed = F.col("bed") - beds[0] + 1 if left_to_right else beds[1] - F.col("bed") + 1
    tier = F.col("tier") - tiers[0] + 1 if bottom_to_top else tiers[1] - F.col("tier") + 1
    placed = inside.withColumns({"new_bed": bed, "new_tier": tier})
    # without a field the means are one row
    return placed.join(means, by) if by else placed.join(F.broadcast(means))


def merged_documents(docs: DataFrame, beds: tuple[int, int], tiers: tuple[int, int], left_to_right: bool = True, bottom_to_top: bool = True, by: list[str] | None = None, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(heads, items) of the document that merges the plots of each field (`by`) of a grid range, for `write_document_parts` with the end `]}}`.

    `docs` is (bed, tier, doc) with scene documents as variants, one per plot
    (`dedupe_plots`). The first plot by bed and tier is the template: sun,
    chlorophyll and plot sizes become the field's means (a missing value counts
    by its default), layout and plot shape get them where the template has
    these sections, the camera looks at the whole grid. Items are the first
    plot of each document, with its place in the grid; documents without plots
    have none.
    """
    keys, d = by or [], F.col(doc)
    number = lambda path: F.try_variant_get(d, path, "double")
    paths = {"plot_size_x": "$.field.layout.plot_size_x", "plot_size_y": "$.field.layout.plot_size_y", "plot_size_z": "$.field.layout.plot_size_z", "sun_elevation": "$.environment.sun.elevation_degrees", "sun_azimuth": "$.environment.sun.azimuth_degrees", "chlorophyll": "$.plant_properties.leaf_optics.chlorophyll_content"}
    placed = merge_field(docs.withColumns({n: number(path) for n, path in paths.items()}), beds, tiers, left_to_right, bottom_to_top, by)
    n_beds, n_tiers = beds[1] - beds[0] + 1, tiers[1] - tiers[0] + 1
    # variants can't be compared, so the template travels as text
    field = placed.groupBy(*keys).agg(F.min_by(F.to_json(d), F.struct("bed", "tier")).alias("_t"), *[F.first(f"mean_{n}").alias(n) for n in paths])
    field = field.withColumn("_t", F.parse_json("_t"))
    camera = merged_camera(field.withColumns({"total_x": F.col("plot_size_x") * n_beds, "total_y": F.col("plot_size_y") * n_tiers}))
    at = lambda path: F.try_variant_get(F.col("_t"), path, "variant")
    text = lambda **sets: {k: json_text(F.col(v) if isinstance(v, str) else F.lit(v)) for k, v in sets.items()}
    grid = text(num_beds=n_beds, num_rows=n_tiers)
    sizes = {"mode": F.lit('"manual"'), **text(plot_size_x="plot_size_x", plot_size_y="plot_size_y", plot_size_z="plot_size_z"), **grid}
    section = lambda name: {name: F.when(at(f"$.field.{name}").isNotNull(), object_text(at(f"$.field.{name}"), sizes))}
    sets = {
        "environment": object_text(at("$.environment"), {"sun": object_text(at("$.environment.sun"), text(elevation_degrees="sun_elevation", azimuth_degrees="sun_azimuth"))}),
        "plant_properties": object_text(at("$.plant_properties"), {"leaf_optics": object_text(at("$.plant_properties.leaf_optics"), text(chlorophyll_content="chlorophyll"))}),
        "camera": object_text(at("$.camera"), {"sensor": object_text(at("$.camera.sensor"), text(resolution_x="resolution_x", resolution_y="resolution_y")), "positioning": object_text(at("$.camera.positioning"), text(camera_height="camera_height", focusing_plants=False, lookat_offset_x="lookat_offset_x", lookat_offset_y="lookat_offset_y", lookat_offset_z="lookat_offset_z"))}),
    }
    # the field comes last, and in it the list of plots
    inner = object_pairs(at("$.field"), {**grid, **section("layout"), **section("plot_shape"), "plots": F.lit(None).cast("string")})
    heads = camera.select(*keys, F.concat(F.lit("{"), object_pairs(F.col("_t"), {**sets, "field": F.lit(None).cast("string")}), F.lit(',"field":{'), inner, F.lit(',"plots":[')).alias("value"))
    plot = F.try_variant_get(d, "$.field.plots[0]", "variant")
    items = placed.where(plot.isNotNull()).select(*keys, F.col("bed").alias("_bed"), F.col("tier").alias("_tier"), object_text(plot, {"bed": F.col("new_bed").cast("string"), "row": F.col("new_tier").cast("string")}).alias("value"))
    return heads, items


def merged_camera(field: DataFrame, width: int = 2000, height: float = 5.0) -> DataFrame:
    """Camera of a merged field (total_x, total_y): fixed image width, height by the field's proportions."""
    return field.withColumns({"resolution_x": F.lit(width), "resolution_y": (F.col("total_y") / F.col("total_x") * width).cast("int"), "camera_height": F.lit(height), "lookat_offset_x": F.lit(0.0), "lookat_offset_y": F.lit(0.0), "lookat_offset_z": F.lit(0.0)})


def total_bounds(geoms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return geoms.groupBy(*(by or [])).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def bbox3d(vertices: DataFrame, by: list[str]) -> DataFrame:
    """Corners, extent and centre per group; a group without coordinates has zeros."""
    ends = [F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    out = vertices.groupBy(*by).agg(*ends)
    return out.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"} | {f"centre_{c}": (F.col(f"max_{c}") + F.col(f"min_{c}")) / 2 for c in "xyz"})


def run_summary(results: DataFrame, errors: int = 100) -> DataFrame:
    """Counts of a run (status, n_plants, error) and its first errors by text."""
    out = results.agg(F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"), F.count(F.lit(1)).alias("total"), F.sum("n_plants").alias("total_plants"))
    first = results.where("error is not null").groupBy("error").count().orderBy("error").limit(errors)
    return out.join(F.broadcast(first.agg(F.array_sort(F.collect_list("error")).alias("errors"))))


#: Bins into which the range that still holds a quantile is cut on each pass.
QUANTILE_BINS = 1024


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, one column for each of `shares` (name: share): null for a group without values.

    No group's values are gathered. A pass counts the range that holds a rank in
    `QUANTILE_BINS` bins, aggregated before the shuffle, and goes on with the
    ends of what the rank's bin holds, until these are one value: two passes for
    a million different values, three for a thousand million.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if not by:
        own, by = own.withColumn("_all", F.lit(0)), ["_all"]
    ends = own.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("_n"))
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    # ranks from 0 of the values around each quantile's place
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(place(p)).cast("long").alias("rank")) for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    open_ = staged(ends.select(*by, "lo", "hi", F.explode(F.array(*wanted)).alias("w")).select(*by, "lo", "hi", "w.*"), "quantile-ranges")
    done = open_.where("lo = hi")
    same = ["name", "side"]
    while open_.where("lo < hi").limit(1).count():
        open_ = open_.where("lo < hi")
        # ranks of a group mostly share a range: count it once
        ranges = open_.select(*by, "lo", "hi").distinct()
        at = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1))
        counts = own.join(ranges, by).where("_v >= lo and _v <= hi").groupBy(*by, "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        upto = F.sum("n").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        found = open_.join(counts, [*by, "lo", "hi"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        open_ = staged(found.select(*by, F.col("a").alias("lo"), F.col("b").alias("hi"), *same, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "quantile-ranges")
        done = done.unionByName(open_.where("lo = hi"))
    end = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("lo")))
    values = done.groupBy(*by).agg(*[end(n, s).alias(f"{n}_{s}") for n in shares for s in ("low", "high")]).join(ends.select(*by, "_n"), by)
    out = [(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (place(p) - F.floor(place(p)))).alias(n) for n, p in shares.items()]
    return values.select(*[c for c in by if c != "_all"], *out)


def raster_stats(pixels: DataFrame, by: list[str], value: str = "v", nodata: float | None = None, accuracy: int | None = None) -> DataFrame:
    """min, max, mean, population deviation, median, range, valid count and share; `accuracy` makes the median approximate."""
    v = valid_value(F.col(value), nodata)
    approximate = [F.percentile_approx(v, 0.5, accuracy).alias("median")] if accuracy else []
    out = pixels.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *approximate, F.count(v).alias("valid"), F.count(F.lit(1)).alias("pixels"))
    if not accuracy:
        median = exact_quantiles(pixels.select(*by, v.alias("_valid")), by, "_valid", {"median": 0.5})
        out = out.join(median, by, "left") if by else out.join(F.broadcast(median))  # without `by` one row
    out = out.select(*by, "min", "max", "mean", "std", "median", "valid", "pixels")
    return out.withColumns({"range": F.col("max") - F.col("min"), "valid_percent": F.col("valid") * 100.0 / F.col("pixels")})


def valid_value(v: Column, nodata: float | None) -> Column:
    """`v`, or null where it is no data: equal to `nodata`, or NaN when that is None."""
    d = v.cast("double")
    return F.when(~F.isnan(d) if nodata is None else d != nodata, d)


def raster_histogram(pixels: DataFrame, by: list[str], bins: int = 50, value: str = "v", accuracy: int | None = None) -> DataFrame:
    """Counts of equal-width bins between a raster's ends; the last bin is closed.

    With `accuracy` the values are read once, into a mergeable histogram of that
    many uneven bins per group, whose centres are then counted: approximate.
    """
    own = pixels.where(F.col(value).isNotNull())
    if accuracy:
        sketch = own.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.histogram_numeric(F.col(value).cast("double"), F.lit(accuracy)).alias("h"))
        joined, n = sketch.select(*by, "lo", "hi", F.explode("h").alias("h")).select(*by, "lo", "hi", F.col("h.x").alias("_x"), F.col("h.y").alias("_n")), F.sum("_n").cast("long")
    else:
        ends = own.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        own = own.select(*by, F.col(value).alias("_x"))
        joined, n = own.join(ends, by) if by else own.join(F.broadcast(ends)), F.count(F.lit(1))  # without `by` one row
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    return joined.groupBy(*by, at.alias("bin")).agg(n.alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).withColumn("bin_start", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).drop("lo", "hi")


def masked_mean(pixels: DataFrame, by: list[str], inside: Column, value: str = "v", digits: int | None = None, scale: float = 1.0) -> DataFrame:
    """Mean of the pixels that `inside` selects, null for a group without any; `scale` divides, `digits` rounds."""
    mean = F.avg(F.when(inside, F.col(value))) / scale
    return pixels.groupBy(*by).agg((F.bround(mean, digits) if digits is not None else mean).alias("mean"), F.count_if(inside).alias("n"))


def plant_survey(boxes: DataFrame, plots: DataFrame, pixels: DataFrame, meta: dict[str, float], tile: int = 64) -> DataFrame:
    """Survey row of each plant box (raster_id, plant_id, x1, y1, x2, y2).

    Centre in pixels, size, offset of the centre from the plot's (raster_id,
    centre_x, centre_y in metres), height above the plot's bare ground and
    colour of masked pixels (raster_id, row, col, red, green, blue, dem, mask).
    """
    from .joins import pixels_in_box

    base = pixels.groupBy("raster_id").agg(F.avg(F.when(F.col("mask") == 0, F.col("dem"))).alias("base_height"))
    under = pixels_in_box(pixels, boxes.select("raster_id", "plant_id", "x1", "y1", "x2", "y2"), tile, "raster_id").where("mask > 0")
    traits = under.groupBy("raster_id", "plant_id").agg(F.avg("dem").alias("top"), *[F.bround(F.avg(c) / 255, 2).alias(c) for c in ("red", "green", "blue")])
    cx, cy = ((F.col("x1") + F.col("x2")) / 2).cast("int"), ((F.col("y1") + F.col("y2")) / 2).cast("int")
    out = boxes.join(traits, ["raster_id", "plant_id"], "left").join(base, "raster_id", "left").join(plots, "raster_id", "left")
    x, y = meta["xinit"] + cx * meta["xsize"], meta["yinit"] + cy * meta["ysize"]
    return out.select("raster_id", "plant_id", cx.alias("x"), cy.alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), F.bround(x - F.col("centre_x"), 6).alias("offset_x"), F.bround(y - F.col("centre_y"), 6).alias("offset_y"), F.bround(F.col("top") - F.col("base_height"), 3).alias("crop_height"), F.array("red", "green", "blue").alias("plant_color"))


def class_counts(annotations: DataFrame, image: str = "image_id", category: str = "category_id") -> DataFrame:
    """Annotations per image and class, with the number of classes present in the image."""
    counts = annotations.groupBy(image, category).agg(F.count(F.lit(1)).alias("n"))
    present = F.count(F.lit(1)).over(Window.partitionBy(image))
    return counts.withColumn("n_classes", present)


def organ_counts(objects: DataFrame, by: list[str], organ: str = "organ") -> DataFrame:
    """Objects per organ class as columns."""
    names = ORGANS
    return objects.groupBy(*by).agg(*[F.count_if(F.col(organ) == i).alias(f"n_{n}") for i, n in enumerate(names)])


#: Organ classes by number.
ORGANS = ["internode", "petiole", "leaf", "floral_bud", "flower", "pod"]


def with_par(primitives: DataFrame) -> DataFrame:
    """Add par, the sum of red, green and blue flux; missing bands are 0."""
    return primitives.withColumn("par", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("flux_red", "flux_green", "flux_blue")), F.lit(0.0)))


def with_stomatal_proxy(primitives: DataFrame) -> DataFrame:
    """Add gs, stomatal conductance from PAR, at most 0.6."""
    return primitives.withColumn("gs", F.least(F.lit(0.6), 0.05 + F.col("par") / 400 * 0.55))


def with_wue(primitives: DataFrame) -> DataFrame:
    """Add transpiration and water-use efficiency; without transpiration that is 0."""
    out = primitives.withColumn("transpiration", F.col("latent_flux") / 44000 * 1000)
    return out.withColumn("wue", F.when(F.col("transpiration") > 1e-6, F.try_divide(F.col("net_photosynthesis"), F.col("transpiration"))).otherwise(0.0))


def wue(primitives: DataFrame, by: list[str]) -> DataFrame:
    return with_wue(primitives).groupBy(*by).agg(F.avg("wue").alias("wue"), F.avg("transpiration").alias("transpiration"))


def surface_temperature(primitives: DataFrame, by: list[str]) -> DataFrame:
    """Mean temperature of leaf and ground, in K and degrees C, missing values left out."""
    mean = lambda s: F.avg(F.when(F.col("surface") == s, F.col("temperature")))
    out = primitives.groupBy(*by).agg(mean("leaf").alias("leaf_k"), mean("ground").alias("ground_k"))
    return out.withColumns({"leaf_c": F.col("leaf_k") - 273.15, "ground_c": F.col("ground_k") - 273.15})


def with_air_difference(temperatures: DataFrame, air: str = "air_temperature") -> DataFrame:
    return temperatures.withColumns({"leaf_dt": F.col("leaf_k") - F.col(air), "ground_dt": F.col("ground_k") - F.col(air)})


def evapotranspiration(primitives: DataFrame, by: list[str], ground_area: Column, et0: Column | None = None) -> DataFrame:
    """Latent flux per ground area, water depth per hour and, with et0, the crop coefficient."""
    out = primitives.groupBy(*by).agg((F.sum(F.col("latent_flux") * F.col("area")) / F.first(ground_area)).alias("latent"))
    out = out.withColumn("et_mm", F.col("latent") / 2264705 * 3600)
    return out if et0 is None else out.withColumn("kc", F.try_divide(F.col("et_mm"), et0))


def plant_traits(organs: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Height, stem height, leaf count and area, and the area-weighted inclination histogram of leaves.

    `organs` is (x, y, z, organ, area, inclination in radians from the
    vertical); a null inclination falls in no bin.
    """
    leaf, stem = F.col("organ") == 2, F.col("organ") == 0
    span = lambda c: F.max(c) - F.min(c)
    width = 3.141592653589793 / 2 / bins
    at = F.least(F.floor(F.abs(F.col("inclination")) / width), F.lit(bins - 1))
    hist = F.array(*[F.coalesce(F.sum(F.when(leaf & (at == i), F.col("area"))), F.lit(0.0)) for i in range(bins)])
    return organs.groupBy(*by).agg(span(F.col("z")).alias("height"), span(F.when(stem, F.col("z"))).alias("stem_height"), F.count_if(leaf).alias("leaf_count"), F.coalesce(F.sum(F.when(leaf, F.col("area"))), F.lit(0.0)).alias("leaf_area"), hist.alias("inclination_area"))


def triangles(vertices: DataFrame, faces: DataFrame, mesh: str = "raster_id") -> DataFrame:
    """Faces (mesh, a, b, c, ...) with their lowest and highest z, area, and inclination: the angle of the normal from the vertical.

    `vertices` is (mesh, vertex_id, x, y, z). A face is joined to its corners
    one by one, each on mesh and vertex, so a large mesh is spread like any
    other. A face without an area has no inclination; one whose corner is
    missing is left out.
    """
    out = faces
    for corner in "abc":
        out = out.join(vertices.select(mesh, F.col("vertex_id").alias(corner), F.struct("x", "y", "z").alias(f"_{corner}")), [mesh, corner])
    side = lambda to: [F.col(f"_{to}")[c] - F.col("_a")[c] for c in "xyz"]
    (ux, uy, uz), (vx, vy, vz) = side("b"), side("c")
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    zs = [F.col(f"_{c}")["z"] for c in "abc"]
    tilt = F.acos(F.least(F.lit(1.0), F.try_divide(F.abs(nz), length)))
    return out.select(*faces.columns, F.least(*zs).alias("z_min"), F.greatest(*zs).alias("z_max"), (length / 2).alias("area"), F.when(length > 0, tilt).alias("inclination"))


def mesh_traits(vertices: DataFrame, faces: DataFrame, mesh: str = "raster_id", bins: int = 10) -> DataFrame:
    """`plant_traits` of a plant's triangles: faces (mesh, a, b, c, organ, part) tell the organ and which of its kind they belong to."""
    leaf, stem = F.col("organ") == 2, F.col("organ") == 0
    own = triangles(vertices, faces, mesh)
    span = lambda on: F.max(F.when(on, F.col("z_max"))) - F.min(F.when(on, F.col("z_min")))
    at = F.least(F.floor(F.col("inclination") / (3.141592653589793 / 2 / bins)), F.lit(bins - 1))
    hist = F.array(*[F.coalesce(F.sum(F.when(leaf & (at == i), F.col("area"))), F.lit(0.0)) for i in range(bins)])
    return own.groupBy(mesh).agg(span(F.lit(True)).alias("height"), span(stem).alias("stem_height"), F.count_distinct(F.when(leaf, F.col("part"))).alias("leaf_count"), F.coalesce(F.sum(F.when(leaf, F.col("area"))), F.lit(0.0)).alias("leaf_area"), hist.alias("inclination_area"))


def blend_spectra(spectra: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sums of named spectra (name, wavelength, value) by (target, name, weight)."""
    return spectra.join(weights, "name").groupBy("target", "wavelength").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


#: Blends of reproductive organs, (target, first share, second share).
ORGAN_BLENDS = [("flower_closed", 0.35, 0.65), ("flower_open", 0.10, 0.90), ("pod", 0.95, 0.05)]
