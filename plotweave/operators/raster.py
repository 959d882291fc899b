"""Operators on pixel tables (raster_id, row, col, v): indices, filters, thresholds, morphology, components, plants."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.colour import lab_to_rgb, rgb_to_lab
from plotweave.plans.staging import staged

from . import tiles as T
from .tiles import ID


def bands_to_columns(pixels: DataFrame, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(raster_id, row, col, band, v) to one column per band."""
    return pixels.groupBy(ID, "row", "col").agg(*[F.max(F.when(F.col("band") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def exg(rgb: DataFrame, wrap_uint8: bool = False) -> DataFrame:
    """Normalised excess green in -1 to 1; `wrap_uint8` sums the bands modulo 256 as 8-bit arithmetic would."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    total = r + g + b
    total = F.pmod(total, F.lit(256.0)) if wrap_uint8 else total
    return rgb.withColumn("v", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * g - r - b) / (total + 1e-6))))


def exg_raw(rgb: DataFrame) -> DataFrame:
    return rgb.withColumn("v", 2 * F.col("g") - F.col("b") - F.col("r"))


def minmax_scale(pixels: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Per raster from its smallest and largest value to `low` and `high`; a flat raster becomes `low`."""
    ends = pixels.groupBy(ID).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    part = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return pixels.join(ends, ID).withColumn("v", low + F.coalesce(part, F.lit(0.0)) * (high - low)).drop("_lo", "_hi")


def raster_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(ID).agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))


#: Smoothing weights by kernel size.
GAUSS = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625)}


def gaussian_blur(pixels: DataFrame, k: int = 3, size: int = T.SIZE) -> DataFrame:
    """Separable blur with reflect-101 borders, in tiles of `size` with a halo of half the kernel."""
    tiled = staged(T.to_tiles(pixels, size), "raster-tiles")
    return T.from_tiles(T.map_tiles(tiled, k // 2, T.blur_kernel(GAUSS[k]), size), size=size)


def otsu(pixels: DataFrame) -> DataFrame:
    """Per raster of values 0 to 255 the threshold with the largest between-class variance, also scaled back to -1 to 1.

    The first of equal maxima counts. Windows run over at most 256 histogram rows of a raster.
    """
    return _otsu(pixels.groupBy(ID, F.col("v").cast("int").alias("t")).agg(F.count(F.lit(1)).alias("n")))


def _otsu(hist: DataFrame) -> DataFrame:
    upto = Window.partitionBy(ID).orderBy("t")
    whole = Window.partitionBy(ID)
    moment = F.col("n") * F.col("t")
    h = hist.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(moment).over(upto), "total": F.sum("n").over(whole), "s": F.sum(moment).over(whole)})
    w0, w1 = F.col("w0").cast("double"), (F.col("total") - F.col("w0")).cast("double")
    gap = F.try_divide(F.col("s0").cast("double"), w0) - F.try_divide((F.col("s") - F.col("s0")).cast("double"), w1)
    h = h.withColumn("between", F.coalesce(w0 * w1 * gap * gap, F.lit(0.0)))
    best = h.groupBy(ID).agg(F.min_by("t", F.struct(-F.round("between", 3), "t")).alias("threshold"))
    return best.withColumn("scaled", F.col("threshold") / 127.5 - 1)


def threshold(pixels: DataFrame, t: Column) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > t, 255).otherwise(0))


def ellipse(size: int) -> list[tuple[int, int]]:
    """(dy, dx) offsets of an elliptic kernel."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round(r * sqrt((r * r - dy * dy) / (r * r)))]


#: Passes of each operation: the largest value under the kernel, or the smallest.
PASSES = {"erode": [False], "dilate": [True], "open": [False, True], "close": [True, False]}


def _passes(op: str, kernel: list[tuple[int, int]], iterations: int) -> list:
    return [(largest, kernel) for largest in PASSES[op] for _ in range(iterations)]


def morphology(mask: DataFrame, op: str, kernel: list[tuple[int, int]], iterations: int = 1, size: int = T.SIZE) -> DataFrame:
    """erode, dilate, open or close; pixels outside the raster don't count. All passes run inside tiles of `size` after one exchange of borders."""
    run, halo = T.morphology_kernel(_passes(op, kernel, iterations))
    tiled = staged(T.to_tiles(mask, size), "raster-tiles")
    return T.from_tiles(T.map_tiles(tiled, halo, run, size), mask.schema["v"].dataType.simpleString(), size)


def label_components(mask: DataFrame, size: int = T.SIZE) -> DataFrame:
    """8-connected components of the pixels above 0, each labelled by its smallest row * width + col; labelled inside tiles of `size` first."""
    runs = T.labelled_runs(staged(T.to_tiles(mask, size), "raster-tiles"), size)
    return runs.select(ID, "row", F.explode(F.sequence("c1", "c2")).alias("col"), "label")


def region_props(labels: DataFrame) -> DataFrame:
    """Half-open box, area and centroid of each label."""
    return labels.groupBy(ID, "label").agg(F.min("row").alias("y1"), F.min("col").alias("x1"), (F.max("row") + 1).alias("y2"), (F.max("col") + 1).alias("x2"), F.count(F.lit(1)).alias("area"), F.avg("row").alias("cy"), F.avg("col").alias("cx"))


def _run_size(a: Column, b: Column) -> tuple[Column, Column]:
    """How many columns from a to b, and their sum."""
    return b - a + 1, F.shiftright((a + b) * (b - a + 1), 1)


def run_props(runs: DataFrame) -> DataFrame:
    """`region_props` of labelled runs (raster_id, row, c1, c2, label)."""
    n, cols = _run_size(F.col("c1"), F.col("c2"))
    return runs.groupBy(ID, "label").agg(F.min("row").alias("y1"), F.min("c1").alias("x1"), (F.max("row") + 1).alias("y2"), (F.max("c2") + 1).alias("x2"), F.sum(n).alias("area"), (F.sum(F.col("row") * n) / F.sum(n)).alias("cy"), (F.sum(cols) / F.sum(n)).alias("cx"))


def _large(props: DataFrame, min_size: int) -> DataFrame:
    return props.where(F.greatest(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) >= min_size)


def drop_small(labels: DataFrame, min_size: int) -> DataFrame:
    """Labels whose box is at least `min_size` in one direction."""
    large = _large(region_props(labels), min_size)
    return labels.join(large.select(ID, "label"), [ID, "label"], "left_semi")


def split_blobs(regions: DataFrame, vertical: bool = True) -> DataFrame:
    """Near-square segments along a region's longer side, of floor width (the remainder is not covered).

    Without `vertical`, regions higher than wide are left out.
    """
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    wide = w >= h
    n = F.ceil(F.greatest(w, h) / F.least(w, h)).cast("int")
    out = regions if vertical else regions.where(wide)
    out = out.withColumn("segment", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_step", F.floor(F.greatest(w, h) / n).cast("long"))
    at = F.col("segment") * F.col("_step")
    ends = {"sx1": F.when(wide, F.col("x1") + at).otherwise(F.col("x1")), "sx2": F.when(wide, F.least(F.col("x1") + at + F.col("_step"), F.col("x2"))).otherwise(F.col("x2")), "sy1": F.when(wide, F.col("y1")).otherwise(F.col("y1") + at), "sy2": F.when(wide, F.col("y2")).otherwise(F.least(F.col("y1") + at + F.col("_step"), F.col("y2")))}
    return out.withColumns(ends).select(ID, "label", "segment", *ends)


def segment_props(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Centroid and inclusive box of a label's pixels in each segment; a segment without any has its own centre and box."""
    inside = F.col("col").between(F.col("sx1"), F.col("sx2") - 1) & F.col("row").between(F.col("sy1"), F.col("sy2") - 1)
    hit = segments.join(labels, [ID, "label"], "left").withColumn("_in", F.coalesce(inside, F.lit(False)))
    pick = lambda f, c: f(F.when(F.col("_in"), F.col(c)))
    ends = [ID, "label", "segment", "sx1", "sy1", "sx2", "sy2"]
    out = hit.groupBy(*ends).agg(pick(F.avg, "col").alias("cx"), pick(F.avg, "row").alias("cy"), pick(F.min, "col").alias("bx1"), pick(F.min, "row").alias("by1"), pick(F.max, "col").alias("bx2"), pick(F.max, "row").alias("by2"))
    return _or_own_box(out)


def segment_run_props(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """`segment_props` of labelled runs: each run counts with the part that lies in the segment."""
    a, b = F.greatest("c1", "sx1"), F.least(F.col("c2"), F.col("sx2") - 1)
    inside = F.coalesce(F.col("row").between(F.col("sy1"), F.col("sy2") - 1) & (a <= b), F.lit(False))
    hit = segments.join(runs, [ID, "label"], "left").select(ID, "label", "segment", "sx1", "sy1", "sx2", "sy2", *[F.when(inside, x).alias(n) for n, x in (("row", F.col("row")), ("a", a), ("b", b))])
    n, cols = _run_size(F.col("a"), F.col("b"))
    out = hit.groupBy(ID, "label", "segment", "sx1", "sy1", "sx2", "sy2").agg((F.sum(cols) / F.sum(n)).alias("cx"), (F.sum(F.col("row") * n) / F.sum(n)).alias("cy"), F.min("a").alias("bx1"), F.min("row").alias("by1"), F.max("b").alias("bx2"), F.max("row").alias("by2"))
    return _or_own_box(out)


def _or_own_box(found: DataFrame) -> DataFrame:
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return found.select(ID, "label", "segment", F.coalesce("cx", mid("sx1", "sx2")).alias("cx"), F.coalesce("cy", mid("sy1", "sy2")).alias("cy"), *[F.coalesce(f"b{c}", f"s{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def detect_plants(rgb: DataFrame, pixel: float, min_size: int = 3, kernel_small: int = 5, kernel_large: int = 9, wrap_uint8: bool = False, tile: int = T.SIZE) -> DataFrame:
    """Plants of each image (raster_id, row, col, r, g, b): centre, box and centre in metres from the image's centre.

    Excess green, blur, Otsu, opening and closing, small components dropped,
    components split into near-square segments. Pixels are gathered into tiles
    once; filters and labelling run inside the tiles.
    """
    from .geo import pixels_to_local

    size = staged(raster_sizes(rgb), "raster-sizes")
    blur = T.blur_kernel(GAUSS[3])
    tiled = staged(T.to_tiles(exg(rgb, wrap_uint8), tile, size), "raster-tiles")
    # values stay exact small integers from here on
    blurred = staged(T.map_tiles(tiled, 1, lambda stack, place: np.floor((blur(stack, place) + 1) * 127.5), tile), "raster-blur")
    mask = staged(T.threshold_tiles(blurred, _otsu(T.tile_histogram(blurred)).select(ID, "threshold")), "raster-mask")
    small, large = ellipse(kernel_small), ellipse(kernel_large)
    cleaned, halo = T.morphology_kernel(_passes("open", small, 2) + _passes("close", large, 2) + _passes("open", small, 1))
    runs = staged(T.labelled_runs(staged(T.map_tiles(mask, halo, cleaned, tile), "raster-mask"), tile), "raster-runs")
    # plants are measured on runs, not on pixels
    kept = _large(run_props(runs), min_size)
    plants = segment_run_props(split_blobs(kept), runs).join(size, ID)
    return pixels_to_local(plants, "drone", F.col("width"), F.col("height"), F.lit(pixel)).drop("width", "height")


def _tile_tables(cells: DataFrame, clip: float) -> DataFrame:
    """Per tile (raster_id, ty, tx) of values 0 to 255 the equalised value of each, as one array of 256.

    Counts above the limit are spread evenly over all values: a value's sum has
    the kept counts up to it and its share of what was cut off.
    """
    counts = cells.groupBy(ID, "ty", "tx", "v").agg(F.count(F.lit(1)).alias("n"))
    tile = counts.groupBy(ID, "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("n"), F.sum("n").alias("area"))
    tile = tile.withColumn("limit", F.greatest(F.lit(1.0), clip * F.col("area") / 256))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.try_element_at("n", v), F.lit(0)).cast("double"))
    tile = tile.withColumn("dense", dense).withColumn("extra", F.aggregate("dense", F.lit(0.0), lambda s, n: s + F.greatest(n - F.col("limit"), F.lit(0.0))))
    grow = lambda s, n: F.struct((s["sum"] + F.least(n, F.col("limit"))).alias("sum"), F.array_append(s["upto"], s["sum"] + F.least(n, F.col("limit"))).alias("upto"))
    upto = F.aggregate("dense", F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("upto")), grow)["upto"]
    return tile.select(ID, "ty", "tx", F.transform(upto, lambda s, v: (s + F.col("extra") * (v + 1) / 256) / F.col("area") * 255).alias("table"))


def clahe(pixels: DataFrame, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Contrast-limited equalisation of values 0 to 255 with bilinear blending of four tile tables; other columns stay.

    Pixels between the same four tile centres form a cell and need the same four
    tables, so a pixel meets one row of them and is never copied.
    """
    size = raster_sizes(pixels)
    th, tw = F.ceil(F.col("height") / tiles), F.ceil(F.col("width") / tiles)
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.col("v"))).cast("int")
    own = pixels.join(size, ID).withColumns({"_th": th, "_tw": tw, "_v": value})
    luts = _tile_tables(own.where("_v is not null").select(ID, F.floor(F.col("row") / F.col("_th")).cast("int").alias("ty"), F.floor(F.col("col") / F.col("_tw")).cast("int").alias("tx"), F.col("_v").alias("v")), clip)
    last = [(F.ceil(F.col(n) / t) - 1).cast("int") for n, t in (("height", th), ("width", tw))]
    places = size.select(ID, last[0].alias("_ly"), last[1].alias("_lx"), F.explode(F.sequence(F.lit(-1), last[0])).alias("_cy")).withColumn("_cx", F.explode(F.sequence(F.lit(-1), F.col("_lx"))))
    clamp = lambda at, end: F.greatest(F.lit(0), F.least(at, F.col(end)))
    corners = places.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"ty": clamp(F.col("_cy") + F.floor(F.col("_k") / 2).cast("int"), "_ly"), "tx": clamp(F.col("_cx") + F.col("_k") % 2, "_lx")})
    cells = corners.join(luts, [ID, "ty", "tx"], "left").groupBy(ID, "_cy", "_cx").agg(*[F.any_value(F.when(F.col("_k") == k, F.col("table")), True).alias(f"_t{k}") for k in range(4)])
    fy, fx = (F.col("row") + 0.5) / F.col("_th") - 0.5, (F.col("col") + 0.5) / F.col("_tw") - 0.5
    own = own.withColumns({"_fy": fy - F.floor(fy), "_fx": fx - F.floor(fx), "_cy": F.floor(fy).cast("int"), "_cx": F.floor(fx).cast("int")})
    part = lambda k: (F.col("_fy") if k // 2 else 1 - F.col("_fy")) * (F.col("_fx") if k % 2 else 1 - F.col("_fx")) * F.coalesce(F.get(f"_t{k}", F.col("_v")), F.col("_v").cast("double"))
    # sums that differ in the last bits round alike
    mixed = F.round(F.round(part(0) + part(1) + part(2) + part(3), 6)).cast("int")
    return own.join(cells, [ID, "_cy", "_cx"]).select(*[mixed.alias("v") if c == "v" else F.col(c) for c in pixels.columns])


def equalize_colour(rgb: DataFrame, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """`clahe` on the lightness of colour rasters (raster_id, row, col, r, g, b), as an 8-bit Lab image holds it; hue and chroma stay."""
    light, a, b = (F.round(c) for c in rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    lab = rgb.select(ID, "row", "col", light.cast("int").alias("v"), a.alias("_a"), b.alias("_b"))
    out = lab_to_rgb(F.col("v"), F.col("_a"), F.col("_b"))
    return clahe(lab, tiles, clip).select(ID, "row", "col", *[c.alias(n) for c, n in zip(out, "rgb", strict=True)])


def depth_stretch(pixels: DataFrame, background: int = 220) -> DataFrame:
    """Values above `background` become 255, the rest is stretched to 0 to 220; a flat rest becomes 100."""
    near = F.when(F.col("v") <= background, F.col("v"))
    ends = pixels.groupBy(ID).agg(F.min(near).alias("_lo"), F.max(near).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, F.try_divide((F.col("v") - F.col("_lo")).cast("double"), span.cast("double")) * 220).otherwise(100.0).cast("int")
    return pixels.join(ends, ID).withColumn("v", F.when(F.col("v") > background, 255).otherwise(value)).drop("_lo", "_hi")


def apply_lut(pixels: DataFrame, lut: DataFrame) -> DataFrame:
    """Values to colours by a table (v, red, green, blue) of at most 256 rows."""
    return pixels.join(F.broadcast(lut), "v", "left")


def dem_valid(pixels: DataFrame, nodata: Column | None = None) -> DataFrame:
    """Add `valid`: unlike `nodata`, or not NaN where that is null."""
    v = F.col("v").cast("double")
    none = F.lit(None).cast("double") if nodata is None else nodata
    return pixels.withColumn("valid", F.coalesce(F.when(none.isNotNull(), v != none).otherwise(~F.isnan(v)), F.lit(False)))


def downsample(pixels: DataFrame, k: int) -> DataFrame:
    """Every k-th pixel of every k-th row, from the middle of each block."""
    m = k // 2
    out = pixels.where((F.col("row") % k == m) & (F.col("col") % k == m))
    return out.withColumns({"row": F.floor(F.col("row") / k).cast("long"), "col": F.floor(F.col("col") / k).cast("long")})


def mosaic(tiles: DataFrame, ncols: int, nrows: int, height: int, width: int, tile: str = "tile") -> DataFrame:
    """Tile pixels (composite, tile, row, col, v) in the composite's coordinates; composites with other than ncols x nrows tiles are left out."""
    full = tiles.groupBy("composite").agg(F.count_distinct(tile).alias("n")).where(F.col("n") == ncols * nrows).select("composite")
    out = tiles.join(full, "composite", "left_semi")
    return out.select("composite", (F.floor(F.col(tile) / ncols) * height + F.col("row")).alias("row"), (F.col(tile) % ncols * width + F.col("col")).alias("col"), "v")


def _weights(f: Column, method: str) -> list[tuple[int, Column]]:
    """(offset, weight) of the source pixels around a position with fraction f."""
    if method == "bilinear":
        return [(0, 1 - f), (1, f)]
    a = -0.75  # the usual cubic convolution of image libraries
    near = lambda t: (a + 2) * t * t * t - (a + 3) * t * t + 1
    far = lambda t: a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a
    return [(-1, far(1 + f)), (0, near(f)), (1, near(1 - f)), (2, far(2 - f))]


def resample_affine(pixels: DataFrame, width: int, height: int, inverse: tuple[float, float, float, float, float, float], method: str = "nearest", sizes: DataFrame | None = None) -> DataFrame:
    """A destination grid of each raster, filled by its source pixels.

    `inverse` maps destination pixel centres to source coordinates (a, b, c, d,
    e, f): sx = a x + b y + c, sy = d x + e y + f. Outside pixels are clamped to
    the border for the weighted methods and left out for `nearest`.
    """
    size = raster_sizes(pixels) if sizes is None else sizes
    cells = size.select(ID, F.col("width").alias("sw"), F.col("height").alias("sh"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    a, b, c, d, e, f = inverse
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    sx, sy = a * x + b * y + c - 0.5, d * x + e * y + f - 0.5
    source = pixels.select(ID, F.col("row").cast("long").alias("srow"), F.col("col").cast("long").alias("scol"), "v")
    if method == "nearest":
        at = cells.withColumns({"scol": F.floor(sx + 0.5).cast("long"), "srow": F.floor(sy + 0.5).cast("long")})
        return at.join(source, [ID, "srow", "scol"]).select(ID, "row", "col", "v")
    clamp = lambda p, n: F.greatest(F.lit(0), F.least(p, F.col(n) - 1)).cast("long")
    hits = [F.struct(clamp(F.floor(sy) + oy, "sh").alias("srow"), clamp(F.floor(sx) + ox, "sw").alias("scol"), (wy * wx).alias("w")) for oy, wy in _weights(sy - F.floor(sy), method) for ox, wx in _weights(sx - F.floor(sx), method)]
    rows = cells.select(ID, "row", "col", F.explode(F.array(*hits)).alias("hit")).select(ID, "row", "col", "hit.*")
    return rows.join(source, [ID, "srow", "scol"]).groupBy(ID, "row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def resize_raster(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str = "bilinear") -> DataFrame:
    """Resize rasters of (width, height) `source` to `target`; v null marks no data.

    No data is filled by the raster's mean for the weighted methods, and put
    back where the nearest source pixel has none.
    """
    (sw, sh), (tw, th) = source, target
    inverse = (sw / tw, 0.0, 0.0, 0.0, sh / th, 0.0)
    mask = resample_affine(pixels, tw, th, inverse, "nearest")
    if method == "nearest":
        return mask
    mean = pixels.groupBy(ID).agg(F.avg("v").alias("_mean"))
    filled = pixels.join(mean, ID).withColumn("v", F.coalesce(F.col("v").cast("double"), F.col("_mean"))).drop("_mean")
    smooth = resample_affine(filled, tw, th, inverse, method)
    return smooth.join(mask.withColumnRenamed("v", "_near"), [ID, "row", "col"]).withColumn("v", F.when(F.col("_near").isNotNull(), F.col("v"))).drop("_near")
