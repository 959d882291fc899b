"""Joins of images, annotations, artefacts, plots, rasters and weather."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.plans.staging import staged


def images_with_sidecars(images: DataFrame, labels: DataFrame, params: DataFrame, stem: str = "stem") -> DataFrame:
    """Each image with its label and parameter file, null where one is missing."""
    return images.join(labels, stem, "left").join(params, stem, "left")


def annotations_for_image(images: DataFrame, coco_images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of each image (stem, file_name): by base name, else those of the file's first image, else all.

    `coco_images` is (stem, id, file_name) and `annotations` (stem, image_id, ...):
    a stem's annotation file.
    """
    base = lambda c: F.element_at(F.split(F.col(c), r"[/\\]"), -1)
    first = coco_images.groupBy("stem").agg(F.min("id").alias("first_id"))
    named = coco_images.select("stem", base("file_name").alias("_base"), F.col("id").alias("matched_id")).groupBy("stem", "_base").agg(F.min("matched_id").alias("matched_id"))
    wanted = images.withColumn("_base", base("file_name")).join(named, ["stem", "_base"], "left").join(first, "stem", "left")
    wanted = wanted.withColumn("_want", F.coalesce("matched_id", "first_id")).drop("_base", "matched_id", "first_id")
    joined = wanted.join(annotations, "stem")
    return joined.where(F.col("_want").isNull() | (F.col("image_id") == F.col("_want"))).drop("_want")


def with_category(annotations: DataFrame, categories: DataFrame, fallback: str = "prefix") -> DataFrame:
    """Add category_name from (id, name); unknown ids become `Category {id}`, the id itself (`id`) or `Unknown`."""
    number = F.col("category_id").cast("string")
    other = {"prefix": F.concat(F.lit("Category "), number), "id": number}.get(fallback, F.lit("Unknown"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_name"))
    return annotations.join(names, "category_id", "left").withColumn("category_name", F.coalesce("_name", other)).drop("_name")


def artifacts_to_plots(artifacts: DataFrame, plots: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    return artifacts.join(plots, ["bed", "tier"], "left" if keep_unmatched else "inner")


def expected_grid(spark, beds: int, tiers: int) -> DataFrame:
    """(bed, tier) of a full grid."""
    return spark.range(beds * tiers).select((F.floor(F.col("id") / tiers) + 1).cast("long").alias("bed"), (F.col("id") % tiers + 1).alias("tier"))


def missing_artifacts(grid: DataFrame, kinds: list[str], artifacts: DataFrame, by: tuple[str, ...] = ("bed", "tier")) -> DataFrame:
    """(`by`, kind) of the grid for which no artefact of a length above 0 exists."""
    wanted = grid.select(*by, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    there = artifacts.where(F.col("length") > 0) if "length" in artifacts.columns else artifacts
    return wanted.join(there.select(*by, "kind").distinct(), [*by, "kind"], "left_anti")


def todo(scenes: DataFrame, existing: DataFrame, keys: list[str], iteration: str | None = None, start: int = 0) -> DataFrame:
    """Scenes without output; with `iteration`, those from `start` (at least 0) on."""
    left = scenes.join(existing.select(*keys).distinct(), keys, "left_anti")
    return left.where(F.col(iteration) >= max(0, start)) if iteration else left


def pick_by_dap(artifacts: DataFrame, daps: DataFrame) -> DataFrame:
    """For each wanted dap the file taken on that day, else the first file by name."""
    own = artifacts.groupBy("dap").agg(F.min("file_name").alias("_same_day"))
    first = artifacts.agg(F.min("file_name").alias("_first"))
    return daps.join(own, "dap", "left").join(F.broadcast(first)).select(*daps.columns, F.coalesce("_same_day", "_first").alias("file_name"))


def method_or_general(files: DataFrame, method: str, group: str = "dap") -> DataFrame:
    """Per group the files of `method`; where there is none, those without a method."""
    rank = F.when(F.col("method") == method, 0).when(F.col("method").isNull(), 1)
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    # one row per group, aggregated before the shuffle
    best = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_rank") == F.col("_best"))).drop("_rank", "_best", "_group")


def weather_at(events: DataFrame, weather: DataFrame, ts: str, hour: str = "hour_ts") -> DataFrame:
    """Events with the weather of their own hour."""
    return events.withColumn(hour, F.date_trunc("hour", F.col(ts))).join(weather, hour, "left")


def weather_as_of(events: DataFrame, weather: DataFrame, ts: str, hour: str = "hour_ts") -> DataFrame:
    """Events with the latest weather at or before them.

    Both sides meet in ranges of time of bounded size, sorted inside; the last
    weather of the ranges before is carried into each, so no range join is needed
    and neither a busy day nor a busy instant is one task.
    """
    values = [c for c in weather.columns if c != hour]
    packed = weather.select(F.col(hour).alias("_at"), F.struct(*values).alias("_w"))
    rows = events.withColumns({"_at": F.col(ts), "_w": F.lit(None).cast(packed.schema["_w"].dataType), "_mine": F.lit(1), "_tie": F.xxhash64(*events.columns)})
    rows = rows.unionByName(packed.withColumns({"_mine": F.lit(0), "_tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    order = ["_at", "_mine", "_tie"]
    rows = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "as-of")
    # one row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("_part").agg(F.max_by("_w", F.when(F.col("_mine") == 0, F.col("_at"))).alias("_close"))
    carry = last.select("_part", F.last("_close", ignorenulls=True).over(before).alias("_carry"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_now", F.last("_w", ignorenulls=True).over(upto)).where("_mine = 1").join(carry, "_part")
    return out.withColumn("_now", F.coalesce("_now", "_carry")).select(*events.columns, *[F.col(f"_now.{v}").alias(v) for v in values])


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over the edges of a closed or open ring of (x, y) structs; edges are half open in y."""
    n = F.size(ring)

    def crossing(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when(spans & (x < at), ~acc).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossing)


#: Sides of a cell's children, and how often a cell is split at most: 64 times finer along each axis.
SPLIT, LEVELS = 4, 3
#: Cells that are split on one level at most; each holds more than that share of all points.
SPLIT_CELLS = 1 << 14


def crowded_cells(points: DataFrame, cell: float, x: str, y: str, most: int) -> DataFrame:
    """(level, cx, cy) of the cells with more than `most` points: a quadtree's inner nodes, from one histogram of the finest cells.

    Where the table is so large that more than `SPLIT_CELLS` cells of a level
    could hold as many, `most` grows with it, so this table has a fixed bound.
    """
    finest = cell / SPLIT**LEVELS
    fine = points.select(F.floor(F.col(x) / finest).cast("long").alias("fx"), F.floor(F.col(y) / finest).cast("long").alias("fy")).groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n"))
    up = lambda c, level: F.floor(F.col(c) / SPLIT ** (LEVELS - level)).cast("long")
    nodes = fine.select("n", F.explode(F.array(*[F.struct(F.lit(level).alias("level"), up("fx", level).alias("cx"), up("fy", level).alias("cy")) for level in range(LEVELS)])).alias("c"))
    counts = staged(nodes.groupBy("c.level", "c.cx", "c.cy").agg(F.sum("n").alias("n")), "cell-counts")
    total = counts.where("level = 0").agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(most, total // SPLIT_CELLS)).select("level", "cx", "cy")


def _wholly_inside(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Whether a box surely lies inside a ring: its corners do, and no edge comes near it."""
    n = F.size(ring)

    def near(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        apart = (F.greatest(a["x"], b["x"]) < x1) | (F.least(a["x"], b["x"]) > x2) | (F.greatest(a["y"], b["y"]) < y1) | (F.least(a["y"], b["y"]) > y2)
        side = lambda x, y: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        sides = [side(x, y) for x in (x1, x2) for y in (y1, y2)]
        return ~(apart | (F.least(*sides) > 0) | (F.greatest(*sides) < 0))

    corners = inside(x1, y1, ring) & inside(x1, y2, ring) & inside(x2, y1, ring) & inside(x2, y2, ring)
    return corners & ~F.exists(F.sequence(F.lit(0), n - 1), near)


def points_in_plots(points: DataFrame, plots: DataFrame, cell: float, x: str = "x", y: str = "y", most: int = 1_000_000) -> DataFrame:
    """Points with the plot (ring, min_x, min_y, max_x, max_y, ...) that holds them.

    Plots are listed under the grid cells that their boxes touch, so the join is
    an equi join on cells. Cells with more than `most` points are split into
    smaller ones, again and again, so a plot with most of all points is many
    keys. The ring is tested only for points of cells that it may cross.
    """
    # fewer points than a cell may hold need no histogram
    crowded = staged(crowded_cells(points, cell, x, y, most), "crowded-cells") if points.count() > most else None
    step = lambda level: cell / SPLIT**level
    at = lambda c, level: F.floor(c / step(level)).cast("long")
    split = lambda level: F.broadcast(crowded.where(F.col("level") == level).select("cx", "cy", F.lit(True).alias("_split")))
    own = points.withColumns({"_l": F.lit(0), "_cx": at(F.col(x), 0), "_cy": at(F.col(y), 0)})
    boxes = plots.withColumns({"_l": F.lit(0), "_cx": F.explode(_cells(F.col("min_x"), F.col("max_x"), cell))}).withColumn("_cy", F.explode(_cells(F.col("min_y"), F.col("max_y"), cell)))
    settled = []
    # without a crowded cell nothing is looked up
    for level in range(LEVELS if crowded is not None and crowded.limit(1).count() else 0):
        hit = lambda rows: (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy")) & (rows == level)
        down = F.col("_split").isNotNull()
        own = own.join(split(level), hit(F.col("_l")), "left").withColumns({"_l": F.when(down, level + 1).otherwise(F.col("_l")), "_cx": F.when(down, at(F.col(x), level + 1)).otherwise(F.col("_cx")), "_cy": F.when(down, at(F.col(y), level + 1)).otherwise(F.col("_cy"))}).drop("cx", "cy", "_split")
        found = boxes.join(split(level), hit(F.lit(level)), "left")
        settled.append(found.where(~down | down.isNull()).drop("cx", "cy", "_split"))
        inner = lambda c, lo, hi: F.sequence(F.greatest(F.col(c) * SPLIT, at(F.col(lo), level + 1)), F.least(F.col(c) * SPLIT + SPLIT - 1, at(F.col(hi), level + 1)))
        # cells that a box only grazes by rounding have no child
        some = (F.col("_cx") * SPLIT <= at(F.col("max_x"), level + 1)) & (F.col("_cx") * SPLIT + SPLIT > at(F.col("min_x"), level + 1)) & (F.col("_cy") * SPLIT <= at(F.col("max_y"), level + 1)) & (F.col("_cy") * SPLIT + SPLIT > at(F.col("min_y"), level + 1))
        boxes = found.where(down & some).drop("cx", "cy", "_split").withColumns({"_l": F.lit(level + 1), "_nx": F.explode(inner("_cx", "min_x", "max_x"))}).withColumn("_cy", F.explode(inner("_cy", "min_y", "max_y"))).withColumn("_cx", F.col("_nx")).drop("_nx")
    keyed = reduce(DataFrame.unionByName, [*settled, boxes])
    side = F.lit(cell) / F.pow(F.lit(SPLIT), F.col("_l"))
    # a hair wider than the cell, so that rounding can't put a point beside it
    hair = side * 1e-6
    keyed = keyed.withColumn("_whole", _wholly_inside(F.col("_cx") * side - hair, F.col("_cy") * side - hair, (F.col("_cx") + 1) * side + hair, (F.col("_cy") + 1) * side + hair, F.col("ring")))
    in_box = F.col(x).between(F.col("min_x"), F.col("max_x")) & F.col(y).between(F.col("min_y"), F.col("max_y"))
    tested = F.when(F.col("_whole"), True).otherwise(in_box & inside(F.col(x), F.col(y), F.col("ring")))
    return own.join(keyed, ["_l", "_cx", "_cy"]).where(tested).drop("_l", "_cx", "_cy", "_whole")


def pixels_in_box(pixels: DataFrame, boxes: DataFrame, tile: int = 64, raster: str | None = None) -> DataFrame:
    """Pixels (row, col, ...) under boxes (x1, y1, x2, y2; ends exclusive), by an equi join on tiles of `tile` pixels."""
    by = [raster] if raster else []
    last = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    keyed = boxes.where("x2 > x1 and y2 > y1").withColumn("_tx", F.explode(_cells(F.greatest("x1", F.lit(0)), last("x2"), tile))).withColumn("_ty", F.explode(_cells(F.greatest("y1", F.lit(0)), last("y2"), tile)))
    own = pixels.withColumns({"_tx": F.floor(F.col("col") / tile).cast("long"), "_ty": F.floor(F.col("row") / tile).cast("long")})
    hit = (F.col("col") >= F.col("x1")) & (F.col("col") < F.col("x2")) & (F.col("row") >= F.col("y1")) & (F.col("row") < F.col("y2"))
    return own.join(keyed, [*by, "_tx", "_ty"]).where(hit).drop("_tx", "_ty")


def sample_raster(points: DataFrame, meta: DataFrame, pixels: DataFrame, flip_y: bool = False) -> DataFrame:
    """Add z, the raster's value under each point less the mean of its plot.

    `points` is (raster_id, x, y, ...) in metres from the plot's centre, `meta`
    (raster_id, width, height, scale), `pixels` (raster_id, row, col, v), v null
    for no data, which counts as 0.
    """
    at = lambda c, n, sign=1: F.least(F.greatest((sign * F.col(c) / F.col("scale") + F.col(n) / 2).cast("int"), F.lit(0)), F.col(n) - 1).cast("long")
    own = points.join(meta, "raster_id").withColumns({"col": at("x", "width"), "row": at("y", "height", -1 if flip_y else 1)})
    found = own.join(pixels.select("raster_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "v"), ["raster_id", "row", "col"], "left").withColumn("elevation", F.coalesce(F.col("v").cast("double"), F.lit(0.0)))
    mean = found.groupBy("raster_id").agg(F.avg("elevation").alias("_mean"))
    return found.join(mean, "raster_id").withColumn("z", F.col("elevation") - F.col("_mean")).select(*points.columns, "row", "col", "elevation", "z")


def gt_vs_pred(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Plant counts and layouts of both sides per (dap, bed, tier, method).

    `truth` is (dap, bed, tier, plot_size_x, plot_size_y) per plant, `predicted`
    the same with method; a prediction without a layout uses the truth's.
    """
    key = ["dap", "bed", "tier"]
    t = truth.groupBy(*key).agg(F.count(F.lit(1)).alias("n_truth"), F.max("plot_size_x").alias("_tx"), F.max("plot_size_y").alias("_ty"))
    p = predicted.groupBy(*key, "method").agg(F.count(F.lit(1)).alias("n_pred"), F.max("plot_size_x").alias("_px"), F.max("plot_size_y").alias("_py"))
    out = t.join(p, key, "full")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_truth", "n_pred")]
    return out.select(*key, "method", *counts, F.coalesce("_px", "_tx").alias("plot_size_x"), F.coalesce("_py", "_ty").alias("plot_size_y"))


def overlay_priority(base: DataFrame, tiles: DataFrame, keys: list[str], background: tuple[int, int, int] | None = (119, 115, 102)) -> DataFrame:
    """Base pixels (keys, band, v) replaced by tile pixels where a tile covers them; empty pixels show the background."""
    over = tiles.groupBy(*keys, "band").agg(F.max("v").alias("_over"))
    out = base.join(over, [*keys, "band"], "left")
    empty = F.element_at(F.array(*[F.lit(b) for b in background]), (F.col("band") + 1).cast("int")) if background else F.lit(None).cast("int")
    return out.withColumn("v", F.coalesce("_over", "v", empty)).drop("_over")
