"""Tile tables with overview levels in Parquet, laid out so that a window of a level reads few row groups and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators.tiles import ID, SIZE, from_tiles

#: Small pages, and groups that are checked for their size every few tiles: blocks are large values.
FORMAT = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size": str(1 << 20), "parquet.page.row.count.limit": "8", "compression": "zstd"}


def write_tiles(tiles: DataFrame, path: str, **options: str) -> None:
    """Write tiles (raster_id, level, ty, tx, height, width, v), dealt and sorted by ranges of raster, level and place."""
    order = [ID, "level", "ty", "tx"]
    tiles.select(*order, "height", "width", "v").repartitionByRange(*order).sortWithinPartitions(*order).write.options(**(FORMAT | options)).parquet(path)


def read_tiles(spark: SparkSession, path: str, raster_id: int | str | None = None, level: int = 0, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, size: int = SIZE) -> DataFrame:
    """Tiles of a level that touch a window (rows and columns of the level, ends exclusive); filters reach row groups and pages."""
    out = spark.read.parquet(path).where(F.col("level") == level)
    if raster_id is not None:
        out = out.where(F.col(ID) == raster_id)
    for name, window in (("ty", rows), ("tx", cols)):
        if window is not None:
            out = out.where((F.col(name) >= window[0] // size) & (F.col(name) <= (window[1] - 1) // size))
    return out


def read_window(spark: SparkSession, path: str, raster_id: int | str | None = None, level: int = 0, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, kind: str = "double", size: int = SIZE) -> DataFrame:
    """Pixels (raster_id, row, col, v) of a window, in the level's rows and columns."""
    pixels = from_tiles(read_tiles(spark, path, raster_id, level, rows, cols, size), kind, size)
    for name, window in (("row", rows), ("col", cols)):
        if window is not None:
            pixels = pixels.where((F.col(name) >= window[0]) & (F.col(name) < window[1]))
    return pixels
