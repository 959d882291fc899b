"""Readers of scene documents, plot boundaries, annotations, matrices, artefact listings and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.names import artifact_parts


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def read_scene_params(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per row as a variant, with the parts of its file name; files that don't parse have a null document."""
    files = _named(spark.read.text(path, wholetext=True)).select("file_name", F.try_parse_json("value").alias("doc"))
    return files.withColumns(artifact_parts(F.col("file_name")))


def read_scene_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line as a variant, with the columns of its directory; lines that don't parse have a null document."""
    lines = spark.read.text(path)
    return lines.select(*[c for c in lines.columns if c != "value"], F.try_parse_json("value").alias("doc"))


_PLOTS = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<plot:string,column:int,bed:int,row:int,population:string>>>"


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    """One row per boundary: ring, its box and properties; bed falls back to column, then to the feature's index, row to 0."""
    docs = spark.read.schema(_PLOTS).option("multiLine", True).json(path)
    rows = docs.select(F.posexplode("features").alias("idx", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    props = F.col("f.properties")
    out = rows.select("idx", F.coalesce(props["bed"], props["column"], F.col("idx")).alias("bed"), F.coalesce(props["row"], F.lit(0)).alias("tier"), props["plot"].alias("plot"), props["population"].alias("population"), ring.alias("ring"))
    ends = {f"{n}_{c}": f(F.col(f"ring.{c}")) for c in ("x", "y") for n, f in (("min", F.array_min), ("max", F.array_max))}
    return out.withColumns(ends)


_COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,segmentation:array<array<double>>,area:double>>, categories array<struct<id:long,name:string>>"


def read_coco(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """images, annotations and categories of COCO files, each with its file name; what doesn't parse is listed under `corrupt`.

    A file is a document, or with `lines` each of its lines is one.
    """
    text = _named(spark.read.text(path, wholetext=not lines))
    docs = text.select("file_name", F.from_json("value", _COCO).alias("d"))
    parts = {k: docs.select(F.col("file_name").alias("source"), F.posexplode(f"d.{k}").alias("pos", "x")).select("source", "pos", "x.*") for k in ("images", "annotations", "categories")}
    corrupt = text.where(F.try_parse_json("value").isNull()).select(F.col("file_name").alias("source"))
    return parts | {"corrupt": corrupt}


def parse_yolo(lines: DataFrame, value: str = "value") -> DataFrame:
    """Box columns of lines `class x_c y_c w h`; blank and shorter lines are skipped."""
    part = F.split(F.trim(F.regexp_replace(value, r"[\r\n\t]", " ")), r"\s+")
    rows = lines.where(F.size(part) >= 5)
    number = lambda i: part[i].try_cast("double")
    return rows.withColumns({"category_id": part[0].try_cast("int"), "x_c": number(1), "y_c": number(2), "w": number(3), "h": number(4)}).drop(value)


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    return parse_yolo(_named(spark.read.text(path)))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of lines split once at white space; a name may hold blanks."""
    part = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.size(part) == 2).select(part[0].try_cast("int").alias("id"), part[1].alias("name"))


def parse_label_matrix(text: Column) -> Column:
    """Rows of cells of a white-space matrix, the empty column after a trailing blank dropped."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    return F.transform(lines, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda c: c.try_cast("int")))


def read_label_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, columns of its directory, row, col, class)."""
    files = _named(spark.read.text(path, wholetext=True))
    own = [c for c in files.columns if c != "value"]
    rows = files.select(*own, F.posexplode(parse_label_matrix(F.col("value"))).alias("row", "cells"))
    return rows.select(*own, "row", F.posexplode("cells").alias("col", "class"))


def read_labelme(spark: SparkSession, path: str) -> DataFrame:
    """One row per shape with its points and the image's size."""
    schema = "imageHeight int, imageWidth int, shapes array<struct<label:string,points:array<array<double>>>>"
    docs = _named(spark.read.schema(schema).option("multiLine", True).json(path))
    rows = docs.select("file_name", "imageHeight", "imageWidth", F.posexplode("shapes").alias("shape", "s"))
    return rows.select("file_name", "imageHeight", "imageWidth", "shape", F.col("s.label").alias("label"), F.transform("s.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))


def read_artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Listing of artefact files with length, time and the parts of their names; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = files.select("path", "length", "modificationTime").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return files.withColumns(artifact_parts(F.col("file_name")))


def read_raster_table(spark: SparkSession, path: str, bands: list[str] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A pixel table; `bands` prunes columns (or the band column), `window` (row1, row2, col1, col2; ends exclusive) reaches the scan."""
    out = spark.read.parquet(path)
    if window:
        r1, r2, c1, c2 = window
        out = out.where((F.col("row") >= r1) & (F.col("row") < r2) & (F.col("col") >= c1) & (F.col("col") < c2))
    if bands and "band" in out.columns:
        out = out.where(F.col("band").isin(bands))
    elif bands:
        out = out.select(*[c for c in out.columns if c in bands or c in ("raster_id", "image_id", "row", "col")])
    return out


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Primitive, mesh or weather tables of a declared schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
