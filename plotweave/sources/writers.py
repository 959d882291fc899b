"""Writers of scene documents, annotations, surveys, primitive data and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import write_document_parts


def write_scene_params(scenes: DataFrame, path: str, partition: tuple[str, ...] = ("dap", "bed"), prefix: bool = False) -> None:
    """One JSON line per scene in directories by `partition`; `prefix` adds name, `dap_D_plot_BED_TIER`."""
    body = [c for c in scenes.columns if c not in partition]
    out = scenes.withColumn("name", F.format_string("dap_%d_plot_%d_%d", "dap", "bed", "tier")) if prefix else scenes
    body += ["name"] if prefix else []
    out.select(*partition, F.to_json(F.struct(*body)).alias("value")).write.partitionBy(*partition).text(path)


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One COCO document per image (image_id, ...), annotations ordered by id; the small category list goes into each."""
    anns = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id"), *[c for c in annotations.columns if c != "id"]))).alias("annotations"))
    cats = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    image = F.array(F.struct(F.col("image_id").alias("id"), *[c for c in images.columns if c != "image_id"]))
    # one row: a set has few categories, and each document repeats them all
    out = images.join(anns, "image_id", "left").join(F.broadcast(cats))
    return out.select("image_id", F.to_json(F.struct(image.alias("images"), F.coalesce("annotations", F.array().cast(anns.schema["annotations"].dataType)).alias("annotations"), "categories")).alias("value"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, by: tuple[str, ...] = ("image_id",)) -> None:
    """A document per image, as lines of text files in directories by `by`, columns of `images` (many images: a bucket of their ids)."""
    docs = coco_documents(images, annotations, categories)
    docs.join(images.select("image_id", *[c for c in by if c != "image_id"]), "image_id").select(*by, "value").write.partitionBy(*by).text(path)


def write_field_coco(field: dict[str, DataFrame], path: str, compression: str = "none") -> None:
    """One document of a whole field: the text files of `path`, in the order of their names, are its parts.

    Every annotation is a line, dealt and sorted by its id, so no task holds the
    document. `compression` is a codec of Spark's text writer; gzip parts joined
    in order are one gzip file.
    """
    listed = lambda df: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("v"))
    head = listed(field["images"]).withColumnRenamed("v", "i").join(F.broadcast(listed(field["categories"]).withColumnRenamed("v", "c")))
    begin = head.select(F.lit(-1).cast("long").alias("id"), F.concat(F.lit('{"images":'), "i", F.lit(',"categories":'), "c", F.lit(',"annotations":[')).alias("fixed"))
    anns = field["annotations"]
    whole = [c for c in anns.columns if c not in ("bed", "tier", "width", "height")]
    end = anns.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("id"), F.lit("]}").alias("fixed"))
    rows = anns.select(*whole).unionByName(begin, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    # rows are dealt as they are and become text behind the shuffle, whose ranges come from a first look at them
    line = F.coalesce("fixed", F.concat(F.when(F.col("id") > 0, ",").otherwise(""), F.to_json(F.struct(*whole))))
    rows.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value")).write.text(path, compression=compression)


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """Add value, `class x y w h` with six decimals."""
    return boxes.withColumn("value", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("category_id").cast("long"), *[F.col(c).cast("double") for c in ("x_c", "y_c", "w", "h")]))


def write_yolo(boxes: DataFrame, path: str, by: tuple[str, ...] = ("image_id",)) -> None:
    """Lines of boxes in directories by `by`: the image itself, or for many images a bucket or the plot's bed and tier."""
    yolo_lines(boxes).select(*by, "value").write.partitionBy(*by).text(path)


def write_survey(plants: DataFrame, header: list[str], plot: list[str], path: str) -> None:
    """A survey document per plot: its header, crop types and numbers of beds and rows, then its crops by bed, row, x and y, a line each.

    The numbers and types of a plot are few; its crops are never gathered.
    """
    order, keys = ["bed", "row", "x", "y"], [*plot, *header]
    rest = [c for c in plants.columns if c not in {*keys, *order}]
    heads = plants.groupBy(*keys).agg(F.array_sort(F.collect_set("crop_type")).alias("crop_types"), F.count_distinct("bed").alias("n_beds"), F.count_distinct("row").alias("n_rows"))
    opened = F.to_json(F.struct(*keys, "crop_types", "n_beds", "n_rows"), {"ignoreNullFields": "false"})
    heads = heads.select(*keys, F.concat(F.substring(opened, F.lit(1), F.length(opened) - 1), F.lit(',"crops":[')).alias("value"))
    # an item repeats the bed and row of its place where these name the plot
    inside = [F.col(c) for c in [*order, *rest]]
    items = plants.select(*keys, *[F.col(c).alias(f"_{c}") for c in order], F.to_json(F.struct(*inside)).alias("value"))
    write_document_parts(heads, items, keys, [f"_{c}" for c in order], path)


def write_primitive_data(primitives: DataFrame, cols: list[str], path: str) -> None:
    primitives.select(*cols).write.option("header", True).csv(path)


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """Two Parquet tables, rows ordered within each raster."""
    vertices.repartitionByRange("raster_id", "vertex_id").sortWithinPartitions("raster_id", "vertex_id").write.parquet(f"{path}/vertices")
    faces.repartitionByRange("raster_id", "a").sortWithinPartitions("raster_id", "a", "b", "c").write.parquet(f"{path}/faces")
