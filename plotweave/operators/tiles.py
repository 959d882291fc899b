"""Rasters as tables of tiles: (raster_id, ty, tx, height, width, v), where v holds a tile's values as one block.

A block is row-major, little-endian float64; NaN stands for a pixel that the
table lacks. `height` and `width` are the raster's. A filter that looks `halo`
pixels around runs inside the tiles once neighbours have handed over strips of
that width: one shuffle of borders, whatever the number of passes whose reach
adds up to `halo`. Rasters of one tile exchange nothing.

Tiles are the unit of work: a raster with a third of all pixels is spread over
its tiles, and a task holds a batch of tiles of bounded bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.plans.staging import staged

ID = "raster_id"
SIZE = 256
KEY = [ID, "ty", "tx"]
_DTYPE = "<f8"
#: Pixels from which a batch of pixel rows is handed on.
_ROWS = 1 << 17
#: Where a block lies: first and last-plus-one row and column of the tile, then the raster's height and width, then the block's own first row and column.
Place = tuple[int, int, int, int, int, int, int, int]
Kernel = Callable[[np.ndarray, Place], np.ndarray]


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Limit the bytes of an Arrow batch, unless the session has a limit of its own: blocks are large rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, size)


def _id_type(df: DataFrame) -> str:
    return df.schema[ID].dataType.simpleString()


def _schema(df: DataFrame) -> str:
    return f"{ID} {_id_type(df)}, ty int, tx int, height int, width int, v binary"


def _box(ty: int, tx: int, height: int, width: int, size: int) -> tuple[int, int, int, int]:
    return ty * size, min(ty * size + size, height), tx * size, min(tx * size + size, width)


def to_tiles(pixels: DataFrame, size: int = SIZE, sizes: DataFrame | None = None) -> DataFrame:
    """Tiles of a pixel table (raster_id, row, col, v); a raster reaches to its last row and column, or as `sizes` (raster_id, height, width) say."""
    small_batches(pixels.sparkSession)
    if sizes is None:
        sizes = pixels.groupBy(ID).agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    place = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    cells = pixels.select(ID, F.floor(F.col("row") / size).cast("int").alias("ty"), F.floor(F.col("col") / size).cast("int").alias("tx"), place.alias("at"), F.col("v").cast("double").alias("v"))
    lists = cells.groupBy(*KEY).agg(F.collect_list(F.struct("at", F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("cells"))
    lists = lists.join(sizes.select(ID, F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")), ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ty, tx, height, width = (batch.column(n).to_numpy() for n in ("ty", "tx", "height", "width"))
            cells, out = batch.column("cells"), []
            ends, flat = cells.offsets.to_numpy(), cells.values
            at, v = flat.field("at").to_numpy(), flat.field("v").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                r0, r1, c0, c1 = _box(int(ty[i]), int(tx[i]), int(height[i]), int(width[i]), size)
                block = np.full((r1 - r0, c1 - c0), np.nan)
                own = at[ends[i] : ends[i + 1]]
                block[own // size, own % size] = v[ends[i] : ends[i + 1]]
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in (ID, "ty", "tx", "height", "width")] + [pa.array(out, pa.binary())], names=[ID, "ty", "tx", "height", "width", "v"])

    return lists.select(*KEY, "height", "width", "cells").mapInArrow(run, _schema(pixels))


def _pixel_batch(parts: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids = pa.array([p[0] for p in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3)]], names=[ID, "row", "col", "v"])


def from_tiles(tiles: DataFrame, kind: str = "double", size: int = SIZE) -> DataFrame:
    """The pixel table of tiles, without the pixels that are missing."""
    small_batches(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, parts, held = batch.column(0).type, [], 0
            for ident, ty, tx, height, width, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                r0, _, c0, c1 = _box(ty, tx, height, width, size)
                block = np.frombuffer(v, dtype=_DTYPE)
                at = np.flatnonzero(~np.isnan(block))
                parts.append((ident, r0 + at // (c1 - c0), c0 + at % (c1 - c0), block[at]))
                held += len(at)
                if held > _ROWS:
                    yield _pixel_batch(parts, kind)
                    parts, held = [], 0
            if parts:
                yield _pixel_batch(parts, kind)

    out = tiles.select(*KEY, "height", "width", "v").mapInArrow(run, f"{ID} {_id_type(tiles)}, row long, col long, v double")
    return out.select(ID, "row", "col", F.col("v").cast(kind).alias("v"))


def _borders(tiles: DataFrame, halo: int, size: int) -> DataFrame:
    """Strips that tiles hand to their neighbours: (raster_id, ty, tx of the receiver, strips)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            for ident, ty, tx, height, width, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                r0, r1, c0, c1 = _box(ty, tx, height, width, size)
                block = np.frombuffer(v, dtype=_DTYPE).reshape(r1 - r0, c1 - c0)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        y, x = ty + dy, tx + dx
                        if (not dy and not dx) or y < 0 or x < 0 or y * size >= height or x * size >= width:
                            continue
                        a0, a1, b0, b1 = _box(y, x, height, width, size)
                        a0, a1, b0, b1 = max(a0 - halo, r0), min(a1 + halo, r1), max(b0 - halo, c0), min(b1 + halo, c1)
                        for name, value in ((ID, ident), ("ty", y), ("tx", x), ("r", a0), ("c", b0), ("h", a1 - a0), ("w", b1 - b0), ("v", block[a0 - r0 : a1 - r0, b0 - c0 : b1 - c0].tobytes())):
                            rows[name].append(value)
            if rows:
                kinds = {ID: batch.column(0).type, "v": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.int32())) for n, x in rows.items()], names=list(rows))

    strips = tiles.select(*KEY, "height", "width", "v").mapInArrow(run, f"{ID} {_id_type(tiles)}, ty int, tx int, r int, c int, h int, w int, v binary")
    return strips.groupBy(*KEY).agg(F.collect_list(F.struct("r", "c", "h", "w", "v")).alias("strips"))


def _blocks(batch: pa.RecordBatch, halo: int, size: int) -> Iterator[tuple[Place, np.ndarray]]:
    """Each tile with its halo, cut off at the raster's borders."""
    strips = batch.column(6).to_pylist() if batch.num_columns > 6 else [None] * batch.num_rows
    for ty, tx, height, width, v, around in zip(*[batch.column(i).to_pylist() for i in range(1, 6)], strips, strict=True):
        r0, r1, c0, c1 = _box(ty, tx, height, width, size)
        own = np.frombuffer(v, dtype=_DTYPE).reshape(r1 - r0, c1 - c0)
        top, left = max(r0 - halo, 0), max(c0 - halo, 0)
        place = (r0, r1, c0, c1, height, width, top, left)
        if (top, left) == (r0, c0) and r1 == height and c1 == width:
            yield place, own
            continue
        block = np.full((min(r1 + halo, height) - top, min(c1 + halo, width) - left), np.nan)
        block[r0 - top : r1 - top, c0 - left : c1 - left] = own
        for s in around or ():
            block[s["r"] - top : s["r"] - top + s["h"], s["c"] - left : s["c"] - left + s["w"]] = np.frombuffer(s["v"], dtype=_DTYPE).reshape(s["h"], s["w"])
        yield place, block


def several_tiles(tiles: DataFrame, size: int = SIZE) -> bool:
    """Whether any raster has more than one tile."""
    return bool(tiles.where((F.col("height") > size) | (F.col("width") > size)).limit(1).count())


def _with_strips(tiles: DataFrame, halo: int, size: int) -> DataFrame:
    if halo > size:
        raise ValueError("a halo must not be wider than a tile")
    whole = [*KEY, "height", "width", "v"]
    if not halo or not several_tiles(tiles, size):
        return tiles.select(*whole)
    return tiles.select(*whole).join(_borders(tiles, halo, size), KEY, "left")


def map_tiles(tiles: DataFrame, halo: int, kernel: Kernel, size: int = SIZE) -> DataFrame:
    """Run `kernel` on each tile with `halo` pixels around it.

    It gets a stack (n, rows, cols) of blocks that lie alike in rasters of one
    size, and their place, and returns the stack of the tiles themselves.
    `tiles` is read more than once: hand over a staged table.
    """
    small_batches(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[Place, list[tuple[int, np.ndarray]]] = defaultdict(list)
            for i, (place, block) in enumerate(_blocks(batch, halo, size)):
                alike[place].append((i, block))
            out: list[bytes] = [b""] * batch.num_rows
            for place, blocks in alike.items():
                for (i, _), made in zip(blocks, kernel(np.stack([b for _, b in blocks]), place), strict=True):
                    out[i] = np.ascontiguousarray(made, dtype=_DTYPE).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(out, pa.binary())], names=[ID, "ty", "tx", "height", "width", "v"])

    return _with_strips(tiles, halo, size).mapInArrow(run, _schema(tiles))


def _reflected(a: int, b: int, n: int) -> np.ndarray:
    """Rows a to b - 1 of an axis of length n, those outside by reflection that doesn't repeat the border."""
    if n == 1:
        return np.zeros(b - a, dtype=np.int64)
    at = np.arange(a, b) % (2 * n - 2)
    return np.minimum(at, 2 * n - 2 - at)


def blur_kernel(weights: tuple[float, ...]) -> Kernel:
    """Separable weighted sums with reflect-101 borders; missing pixels add nothing, and a pixel that none reaches stays missing."""
    reach = len(weights) // 2

    def along(x: np.ndarray, axis: int) -> np.ndarray:
        n = x.shape[axis] - 2 * reach
        return sum(w * x.take(range(i, i + n), axis) for i, w in enumerate(weights))

    def kernel(stack: np.ndarray, place: Place) -> np.ndarray:
        r0, r1, c0, c1, height, width, top, left = place
        x = stack[:, _reflected(r0 - reach, r1 + reach, height) - top][:, :, _reflected(c0 - reach, c1 + reach, width) - left]
        gone = np.isnan(x)
        if not gone.any():
            return along(along(x, 2), 1)
        reached = along(along((~gone).astype(float), 2), 1) > 0
        return np.where(reached, along(along(np.where(gone, 0.0, x), 2), 1), np.nan)

    return kernel


def morphology_kernel(passes: list[tuple[bool, list[tuple[int, int]]]]) -> tuple[Kernel, int]:
    """Passes (largest or smallest, offsets) one after another, and the halo they need; pixels outside the raster and missing ones don't count."""

    def one(x: np.ndarray, largest: bool, offsets: list[tuple[int, int]]) -> np.ndarray:
        reach = max(max(abs(a), abs(b)) for a, b in offsets)
        none, pick = (-np.inf, np.maximum) if largest else (np.inf, np.minimum)
        n, m = x.shape[1:]
        wide = np.pad(np.where(np.isnan(x), none, x), ((0, 0), (reach, reach), (reach, reach)), constant_values=none)
        out = np.full(x.shape, none)
        for dy, dx in offsets:
            pick(out, wide[:, reach + dy : reach + dy + n, reach + dx : reach + dx + m], out=out)
        return np.where(np.isinf(out), np.nan, out)

    def kernel(stack: np.ndarray, place: Place) -> np.ndarray:
        r0, r1, c0, c1, _, _, top, left = place
        for largest, offsets in passes:
            stack = one(stack, largest, offsets)
        return stack[:, r0 - top : r1 - top, c0 - left : c1 - left]

    return kernel, sum(max(max(abs(a), abs(b)) for a, b in offsets) for _, offsets in passes)


def tile_histogram(tiles: DataFrame, bins: int = 256) -> DataFrame:
    """(raster_id, t, n): pixels of each whole value from 0 to `bins` - 1, counted inside the tiles and then summed up."""
    small_batches(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, n = [], [], []
            for ident, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(v, dtype=_DTYPE)
                counts = np.bincount(np.clip(block[~np.isnan(block)], 0, bins - 1).astype(np.int64), minlength=bins)
                found = np.flatnonzero(counts)
                ids += [ident] * len(found)
                at.append(found)
                n.append(counts[found])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(n), pa.int64())], names=[ID, "t", "n"])

    return tiles.select(ID, "v").mapInArrow(run, f"{ID} {_id_type(tiles)}, t int, n long").groupBy(ID, "t").agg(F.sum("n").alias("n"))


def threshold_tiles(tiles: DataFrame, thresholds: DataFrame) -> DataFrame:
    """255 where a value lies above its raster's threshold (raster_id, threshold), else 0."""
    small_batches(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, t in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                block = np.frombuffer(v, dtype=_DTYPE)
                out.append(np.where(np.isnan(block), np.nan, np.where(block > t, 255.0, 0.0)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(out, pa.binary())], names=[ID, "ty", "tx", "height", "width", "v"])

    return tiles.join(thresholds, ID).select(*KEY, "height", "width", "v", "threshold").mapInArrow(run, _schema(tiles))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each horizontal run of a mask, in order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edge == 1)
    return rows, first, np.nonzero(edge == -1)[1] - 1


def joined_runs(rows: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> np.ndarray:
    """For runs in order (row, then column, columns below `span` - 2) the earliest run of each one's 8-connected component."""
    start, end = rows * span + first + 1, rows * span + last + 1
    low = np.searchsorted(end, start + span - 1, side="left")
    high = np.searchsorted(start, end + span + 1, side="right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(rows)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    root = np.arange(len(rows))
    while True:
        ra, rb = root[a], root[b]
        unlike = ra != rb
        if not unlike.any():
            return root
        a, b, ra, rb = a[unlike], b[unlike], ra[unlike], rb[unlike]
        # hook larger roots to smaller ones, then let all point to their roots
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt


def tile_runs(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """Runs of pixels above 0, joined inside their tile, and what neighbouring tiles must compare.

    Columns: raster_id, kind, row, c1, c2, key. `key` is the smallest row * width
    + col of the part of a component that lies in the tile. Kind 0 is a run;
    kind 1 a pixel at the tile's border; kind 2 a place across the border where
    a pixel belongs to the same component.
    """
    small_batches(tiles.sparkSession)
    names = [ID, "kind", "row", "c1", "c2", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, runs, span = [], [], [], 0
            for ident, ty, tx, height, width, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                r0, r1, c0, c1 = _box(ty, tx, height, width, size)
                found = _runs(np.frombuffer(v, dtype=_DTYPE).reshape(r1 - r0, c1 - c0) > 0)
                runs.append(found)
                parts.append((ident, r0, r1, c0, c1, height, width))
                span = max(span, c1 - c0 + 3)
            # one pass over all tiles of the batch: a row between tiles keeps them apart
            counts = [len(r[0]) for r in runs]
            if not sum(counts):
                continue
            shift = np.cumsum([0] + [p[2] - p[1] + 1 for p in parts[:-1]])
            rows = np.concatenate([r[0] + s for r, s in zip(runs, shift, strict=True)])
            root = joined_runs(rows, np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs]), span)
            out = defaultdict(list)
            base = 0
            for (ident, r0, r1, c0, c1, height, width), (row, first, last), n in zip(parts, runs, counts, strict=True):
                if not n:
                    continue
                key = (row.astype(np.int64) + r0)[root[base : base + n] - base] * width + first[root[base : base + n] - base] + c0
                base += n
                pieces = [(0, row + r0, first + c0, last + c0, key)]
                if height > size or width > size:
                    pieces += _at_border(row, first, last, key, r0, r1, c0, c1, height, width)
                for kind, *columns in pieces:
                    ids += [ident] * len(columns[0])
                    out["kind"].append(np.full(len(columns[0]), kind))
                    for name, x in zip(names[2:], columns, strict=True):
                        out[name].append(x)
            columns = {n: np.concatenate(x) for n, x in out.items()}
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type)] + [pa.array(columns[n], pa.int32() if n == "kind" else pa.int64()) for n in names[1:]], names=names)

    return tiles.select(*KEY, "height", "width", "v").mapInArrow(run, f"{ID} {_id_type(tiles)}, kind int, row long, c1 long, c2 long, key long")


def _at_border(row, first, last, key, r0, r1, c0, c1, height, width) -> list[tuple]:
    """Border pixels of a tile (kind 1), and the places right of and below it that its last column and row touch (kind 2)."""
    label = np.full((r1 - r0, c1 - c0), -1, dtype=np.int64)
    many = last - first + 1
    cols = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    label[np.repeat(row, many), cols] = np.repeat(key, many)
    edge = np.zeros(label.shape, dtype=bool)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    y, x = np.nonzero(edge & (label >= 0))
    out = [(1, y + r0, x + c0, x + c0, label[y, x])]
    asks = []
    if c1 < width:
        y = np.flatnonzero(label[:, -1] >= 0)
        asks += [(y + r0 + d, np.full(len(y), c1), label[y, -1]) for d in (-1, 0, 1)]
    if r1 < height:
        x = np.flatnonzero(label[-1] >= 0)
        asks += [(np.full(len(x), r1), x + c0 + d, label[-1, x]) for d in (-1, 0, 1)]
    return out + [(2, a, b, b, k) for a, b, k in asks]


def labelled_runs(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(raster_id, row, c1, c2, label): runs of the 8-connected components, each labelled by its smallest row * width + col.

    Components that cross tiles are joined through their border pixels only,
    and a component's smallest part is its label, so nothing gathers one.
    """
    from .connect import components

    found = staged(tile_runs(tiles, size), "tile-runs")
    runs = found.where("kind = 0").select(ID, "row", "c1", "c2", "key")
    if not several_tiles(tiles, size):
        return runs.withColumnRenamed("key", "label")
    here = found.where("kind = 1").select(ID, "row", F.col("c1").alias("col"), F.struct(F.col(ID).alias("r"), "key").alias("a"))
    there = found.where("kind = 2").select(ID, "row", F.col("c1").alias("col"), F.struct(F.col(ID).alias("r"), "key").alias("b"))
    parts = components(here.join(there, [ID, "row", "col"]).select("a", "b").distinct())
    names = parts.select(F.col("v.r").alias(ID), F.col("v.key").alias("key"), F.col("component.key").alias("_first"))
    return runs.join(names, [ID, "key"], "left").select(ID, "row", "c1", "c2", F.coalesce("_first", "key").alias("label"))


def pyramid(tiles: DataFrame, levels: int, size: int = SIZE) -> DataFrame:
    """The tiles as level 0, and levels 1 to `levels`, each half as fine as the one before: (raster_id, level, ty, tx, height, width, v).

    A pixel of level n is the one from the middle of its 2^n x 2^n pixels, as in
    `downsample`. Every tile hands its share to each level at once; a tile of a
    level is put together from at most 4^n pieces, which are a tile in all.
    """
    if size % (1 << levels):
        raise ValueError("a tile must be a whole number of pixels on every level")
    small_batches(tiles.sparkSession)
    kind = _id_type(tiles)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            for ident, ty, tx, height, width, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                r0, r1, c0, c1 = _box(ty, tx, height, width, size)
                block = np.frombuffer(v, dtype=_DTYPE).reshape(r1 - r0, c1 - c0)
                for level in range(1, levels + 1):
                    step = 1 << level
                    part = block[step // 2 :: step, step // 2 :: step]
                    if part.size:
                        whole = [-(-(n - step // 2) // step) for n in (height, width)]
                        for name, value in ((ID, ident), ("level", level), ("ty", ty // step), ("tx", tx // step), ("height", whole[0]), ("width", whole[1]), ("r", r0 // step), ("c", c0 // step), ("h", part.shape[0]), ("w", part.shape[1]), ("v", np.ascontiguousarray(part).tobytes())):
                            rows[name].append(value)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, {ID: batch.column(0).type, "v": pa.binary()}.get(n, pa.int32())) for n, x in rows.items()], names=list(rows))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ty, tx, height, width, pieces in zip(*[batch.column(i).to_pylist() for i in range(2, 7)], strict=True):
                r0, r1, c0, c1 = _box(ty, tx, height, width, size)
                block = np.full((r1 - r0, c1 - c0), np.nan)
                for p in pieces:
                    block[p["r"] - r0 : p["r"] - r0 + p["h"], p["c"] - c0 : p["c"] - c0 + p["w"]] = np.frombuffer(p["v"], dtype=_DTYPE).reshape(p["h"], p["w"])
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(6)] + [pa.array(out, pa.binary())], names=[ID, "level", "ty", "tx", "height", "width", "v"])

    own = tiles.select(*KEY, "height", "width", "v")
    pieces = own.mapInArrow(thin, f"{ID} {kind}, level int, ty int, tx int, height int, width int, r int, c int, h int, w int, v binary")
    place = [ID, "level", "ty", "tx", "height", "width"]
    coarse = pieces.groupBy(*place).agg(F.collect_list(F.struct("r", "c", "h", "w", "v")).alias("pieces")).mapInArrow(join, f"{ID} {kind}, level int, ty int, tx int, height int, width int, v binary")
    return own.select(ID, F.lit(0).alias("level"), "ty", "tx", "height", "width", "v").unionByName(coarse)
