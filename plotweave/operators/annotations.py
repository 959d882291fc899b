"""Conversions and stitching of boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coco_to_yolo(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Corner boxes (x, y, w, h in pixels) to centre boxes in shares of the image (image_id, width, height)."""
    out = annotations.join(images.select("image_id", "width", "height"), "image_id")
    return out.withColumns({"x_c": (F.col("x") + F.col("w") / 2) / F.col("width"), "y_c": (F.col("y") + F.col("h") / 2) / F.col("height"), "w_n": F.col("w") / F.col("width"), "h_n": F.col("h") / F.col("height")})


def yolo_to_pixels(boxes: DataFrame, width: Column, height: Column, clamp: bool = False) -> DataFrame:
    """Corner boxes x1, y1, x2, y2 in pixels; clamped to the image on request."""
    x, y, w, h = (F.col(c) for c in ("x_c", "y_c", "w", "h"))
    ends = {"x1": (x - w / 2) * width, "y1": (y - h / 2) * height, "x2": (x + w / 2) * width, "y2": (y + h / 2) * height}
    if clamp:
        most = {"x": width, "y": height}
        ends = {n: F.least(F.greatest(c, F.lit(0.0)), most[n[0]].cast("double")) for n, c in ends.items()}
    return boxes.withColumns(ends)


def yolo_flip_to_coco(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes with a bottom-left origin to whole-pixel corner boxes with a top-left one, by truncation."""
    x, y, w, h = (F.col(c) for c in ("x_c", "y_c", "w", "h"))
    return boxes.withColumns({"x_min": ((x - w / 2) * width).cast("int"), "y_min": ((1 - y - h / 2) * height).cast("int"), "box_w": (w * width).cast("int"), "box_h": (h * height).cast("int")})


def with_grid_layout(plots: DataFrame, beds: tuple[int, int], tiers: tuple[int, int], tile_w: Column, tile_h: Column, left_to_right: bool = True, bottom_to_top: bool = True) -> DataFrame:
    """Add col, row and pixel offsets of a plot's tile in the stitched grid."""
    col = F.col("bed") - beds[0] if left_to_right else beds[1] - F.col("bed")
    row = tiers[1] - F.col("tier") if bottom_to_top else F.col("tier") - tiers[0]
    return plots.withColumns({"col": col, "row": row}).withColumns({"x_offset": F.col("col") * tile_w, "y_offset": F.col("row") * tile_h})


def grid_layout(spark, beds: tuple[int, int], tiers: tuple[int, int], tile_w: int, tile_h: int, **flags: bool) -> DataFrame:
    """Every (bed, tier) of the range with its tile."""
    n = tiers[1] - tiers[0] + 1
    grid = spark.range((beds[1] - beds[0] + 1) * n).select((F.floor(F.col("id") / n) + beds[0]).alias("bed"), (F.col("id") % n + tiers[0]).alias("tier"))
    return with_grid_layout(grid, beds, tiers, F.lit(tile_w), F.lit(tile_h), **flags)


def stitch_coco(annotations: DataFrame, layout: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Boxes and polygons of plot images in the coordinates of the stitched image.

    `annotations` has bed, tier, bbox (array of 4), segmentation (array of flat
    rings) and the source image's width and height, null for a tile's size.
    """
    out = annotations.join(layout.select("bed", "tier", "x_offset", "y_offset"), ["bed", "tier"])
    sx, sy = (F.lit(float(n)) / F.coalesce(F.col(c), F.lit(n)) for n, c in ((tile_w, "width"), (tile_h, "height")))
    b, xo, yo = F.col("bbox"), F.col("x_offset"), F.col("y_offset")
    box = F.array(b[0] * sx + xo, b[1] * sy + yo, b[2] * sx, b[3] * sy)
    ring = lambda seg: F.transform(seg, lambda v, i: F.when(i % 2 == 0, v * sx + xo).otherwise(v * sy + yo))
    out = out.withColumn("bbox", box)
    if "segmentation" in annotations.columns:
        out = out.withColumn("segmentation", F.coalesce(F.transform("segmentation", ring), F.array().cast("array<array<double>>")))
    return out.drop("x_offset", "y_offset")


def stitch_field(annotations: DataFrame, categories: DataFrame, layout: DataFrame, tile_w: int, tile_h: int, in_file: list[str], file_name: str, width: int, height: int) -> dict[str, DataFrame]:
    """One annotation set of a whole field: images (one row), annotations and categories.

    Annotations are those of `stitch_coco`, numbered from 0 by bed, tier and
    `in_file`, all of image 0. Categories (bed, tier, id, name) are those of the
    first file, by bed and tier, that has any.
    """
    from .numbering import global_annotation_ids

    placed = global_annotation_ids(stitch_coco(annotations, layout, tile_w, tile_h), in_file)
    placed = placed.withColumns({"id": F.col("annotation_id"), "image_id": F.lit(0)}).drop("annotation_id")
    files = categories.join(layout.select("bed", "tier"), ["bed", "tier"])
    # one row
    first = files.agg(F.min(F.struct("bed", "tier")).alias("_first"))
    names = files.join(F.broadcast(first), F.struct("bed", "tier") == F.col("_first")).select("id", "name").distinct()
    image = layout.sparkSession.range(1).select(F.lit(0).alias("id"), F.lit(file_name).alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    return {"images": image, "annotations": placed, "categories": names}


def stitch_yolo(boxes: DataFrame, layout: DataFrame, n_beds: int, n_tiers: int) -> DataFrame:
    """Normalised boxes of plots (bed, tier) normalised to the whole grid, with the text line of each."""
    out = boxes.join(layout.select("bed", "tier", "col", "row"), ["bed", "tier"])
    out = out.withColumns({"x_c": (F.col("x_c") + F.col("col")) / n_beds, "y_c": (F.col("y_c") + F.col("row")) / n_tiers, "w": F.col("w") / n_beds, "h": F.col("h") / n_tiers})
    return out.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("category_id").cast("long"), "x_c", "y_c", "w", "h")).drop("col", "row")


def polygon_points(annotations: DataFrame, keys: list[str], first_only: bool = False, segmentation: str = "segmentation") -> DataFrame:
    """Flat rings x, y, x, y, ... to one row per point, numbered within its ring."""
    rings = F.slice(segmentation, 1, 1) if first_only else F.col(segmentation)
    out = annotations.select(*keys, F.posexplode(rings).alias("ring", "_flat"))
    n = F.floor(F.size("_flat") / 2).cast("int")
    out = out.where(n > 0).select(*keys, "ring", "_flat", F.explode(F.sequence(F.lit(0), n - 1)).alias("point"))
    return out.select(*keys, "ring", "point", F.get("_flat", F.col("point") * 2).alias("x"), F.get("_flat", F.col("point") * 2 + 1).alias("y"))


def boxes_from_masks(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Inclusive box and centre of the pixels (row, col) of each instance."""
    out = pixels.groupBy(*by).agg(F.min("col").alias("x1"), F.min("row").alias("y1"), F.max("col").alias("x2"), F.max("row").alias("y2"))
    return out.withColumns({"centre_x": (F.col("x1") + F.col("x2")) / 2, "centre_y": (F.col("y1") + F.col("y2")) / 2})
