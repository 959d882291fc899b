"""Tiles with halos, labelling across tiles, equalisation and mesh traits against plain computations."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plotweave.functions import colour
from plotweave.functions.names import rover_parts
from plotweave.operators import aggregates, raster
from plotweave.operators import tiles as T
from plotweave.sources.tile_files import read_tiles, read_window, write_tiles


def grid(spark, *images, partitions=3):
    rows = [(i, r, c, int(v)) for i, image in enumerate(images) for r, line in enumerate(image) for c, v in enumerate(line) if not np.isnan(v)]
    return spark.createDataFrame(rows, "raster_id int, row long, col long, v int").repartition(partitions)


def dense(df, shape, raster_id=0, value="v"):
    out = np.full(shape, np.nan)
    for r in df.where(f"raster_id = {raster_id}").collect():
        out[r.row, r.col] = r[value]
    return out


def blurred(img, weights):
    k = len(weights) // 2
    reach = [(k, k) if n > 1 else (0, 0) for n in img.shape]
    pad = np.pad(np.pad(img.astype(float), reach, mode="reflect"), [(0, 0) if n > 1 else (k, k) for n in img.shape], mode="edge")
    h, w = img.shape
    return sum(weights[i] * weights[j] * pad[i : i + h, j : j + w] for i in range(2 * k + 1) for j in range(2 * k + 1))


@pytest.mark.parametrize("size", [4, 5, 64])
def test_blur_across_tiles(spark, size):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 255, s) for s in ((13, 17), (5, 4), (1, 9), (2, 1), (9, 5))]
    for k in (3, 5):
        got = raster.gaussian_blur(grid(spark, *images), k, size=size)
        for i, img in enumerate(images):
            assert np.allclose(dense(got, img.shape, i), blurred(img, raster.GAUSS[k])), (k, i)


def eroded(img, offsets, largest=False):
    h, w = img.shape
    out = np.full(img.shape, -np.inf if largest else np.inf)
    for y in range(h):
        for x in range(w):
            near = [img[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w and not np.isnan(img[y + dy, x + dx])]
            out[y, x] = (max if largest else min)(near) if near else np.nan
    return out


@pytest.mark.parametrize("size", [16, 64])
def test_morphology_across_tiles_and_holes(spark, size):
    rng = np.random.default_rng(2)
    img = (rng.random((37, 41)) > 0.3) * 255.0
    img[rng.random(img.shape) > 0.9] = np.nan
    want = img
    for largest in (False, False, True, True):
        want = eroded(want, raster.ellipse(5), largest)
    got = raster.morphology(grid(spark, img), "open", raster.ellipse(5), 2, size=size)
    assert np.array_equal(dense(got, img.shape), want, equal_nan=True)


def test_a_halo_wider_than_a_tile_is_refused(spark):
    with pytest.raises(ValueError, match="halo"):
        raster.morphology(grid(spark, np.ones((20, 20))), "open", raster.ellipse(9), 3, size=8)


def labelled(mask):
    """Labels by flood fill."""
    out, (h, w) = np.full(mask.shape, np.nan), mask.shape
    for y in range(h):
        for x in range(w):
            if mask[y, x] and np.isnan(out[y, x]):
                stack = [(y, x)]
                out[y, x] = y * w + x
                while stack:
                    a, b = stack.pop()
                    for c in range(max(a - 1, 0), min(a + 2, h)):
                        for d in range(max(b - 1, 0), min(b + 2, w)):
                            if mask[c, d] and np.isnan(out[c, d]):
                                out[c, d] = y * w + x
                                stack.append((c, d))
    return out


@pytest.mark.parametrize("size", [3, 7, 64])
def test_labels_across_tiles(spark, size):
    rng = np.random.default_rng(3)
    spiral = np.zeros((21, 21))
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(400):
        spiral[y, x] = 1
        a, b = y + 2 * dy, x + 2 * dx
        if not (0 <= y + dy < 21 and 0 <= x + dx < 21) or (0 <= a < 21 and 0 <= b < 21 and spiral[a, b]):
            dy, dx = dx, -dy
            if not (0 <= y + dy < 21 and 0 <= x + dx < 21) or spiral[min(max(y + 2 * dy, 0), 20), min(max(x + 2 * dx, 0), 20)]:
                break
        y, x = y + dy, x + dx
    images = [spiral, np.ones((10, 22)), rng.random((19, 14)) > 0.55, rng.random((8, 30)) > 0.3, np.eye(12)[::-1], np.zeros((3, 3))]
    got = raster.label_components(grid(spark, *[i * 255 for i in images]), size=size)
    for i, img in enumerate(images):
        assert np.array_equal(dense(got, img.shape, i, "label"), labelled(img > 0), equal_nan=True), i


def test_runs_join_in_one_pass():
    rng = np.random.default_rng(4)
    for _ in range(30):
        mask = rng.random((rng.integers(1, 30), rng.integers(1, 30))) > 0.5
        rows, first, last = T._runs(mask)
        root = T.joined_runs(rows, first, last, mask.shape[1] + 3)
        want = labelled(mask)
        assert [want[r, c] for r, c in zip(rows[root], first[root], strict=True)] == [want[r, c] for r, c in zip(rows, first, strict=True)]
        assert [rows[root] * mask.shape[1] + first[root] == [want[r, c] for r, c in zip(rows, first, strict=True)]]


def test_run_measures_equal_pixel_measures(spark):
    rng = np.random.default_rng(5)
    mask = grid(spark, (rng.random((23, 31)) > 0.4) * 255)
    labels = raster.label_components(mask, size=8).cache()
    runs = T.labelled_runs(T.to_tiles(mask, 8).cache(), 8)
    props = raster.region_props(labels)
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert key(raster.run_props(runs).select(props.columns)) == key(props)
    segments = raster.split_blobs(props)
    want = raster.segment_props(segments, labels)
    assert key(raster.segment_run_props(segments, runs).select(want.columns)) == key(want)


def test_detection_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(6)
    rows = [(0, r, c, *(int(x) for x in ((40, 200, 40) if (r // 12 + c // 15) % 3 == 0 else (120, 100, 110)) + rng.integers(-20, 20, 3))) for r in range(70) for c in range(90)]
    rgb = spark.createDataFrame(rows, "raster_id int, row long, col long, r int, g int, b int")
    found = [sorted(raster.detect_plants(rgb, 0.01, min_size=4, kernel_small=3, kernel_large=5, tile=t).collect()) for t in (256, 32)]
    assert found[0] and found[0] == found[1]


def equalized(img, tiles, clip=2.0):
    h, w = img.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    ny, nx = -(-h // th), -(-w // tw)
    luts = {}
    for y in range(ny):
        for x in range(nx):
            own = img[y * th : (y + 1) * th, x * tw : (x + 1) * tw].ravel()
            n = np.bincount(own, minlength=256).astype(float)
            limit = max(1.0, clip * len(own) / 256)
            extra = np.maximum(n - limit, 0).sum()
            luts[y, x] = (np.cumsum(np.minimum(n, limit)) + extra * np.arange(1, 257) / 256) / len(own) * 255
    out = np.zeros(img.shape)
    for r in range(h):
        for c in range(w):
            fy, fx = (r + 0.5) / th - 0.5, (c + 0.5) / tw - 0.5
            ay, ax = int(np.floor(fy)), int(np.floor(fx))
            for dy in (0, 1):
                for dx in (0, 1):
                    out[r, c] += (1 - abs(fy - ay - dy)) * (1 - abs(fx - ax - dx)) * luts[min(max(ay + dy, 0), ny - 1), min(max(ax + dx, 0), nx - 1)][img[r, c]]
    return np.floor(np.round(out, 6) + 0.5)


@pytest.mark.parametrize("tiles", [2, 3])
def test_clahe_equals_a_plain_computation(spark, tiles):
    rng = np.random.default_rng(7)
    images = [rng.integers(0, 256, (16, 16)), np.arange(256).reshape(16, 16), rng.choice([3, 250], (17, 23)), np.full((5, 6), 9), rng.integers(100, 104, (30, 8))]
    got = raster.clahe(grid(spark, *images), tiles=tiles)
    for i, img in enumerate(images):
        assert np.array_equal(dense(got, img.shape, i), equalized(img, tiles)), i


def test_colour_equalisation_keeps_hue_and_grey(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 256, (12, 12))
    grey = grid(spark, values).withColumns({c: F.col("v") for c in "rgb"}).drop("v")
    out = raster.equalize_colour(grey, tiles=2).collect()
    assert len(out) == 144 and all(max(r.r, r.g, r.b) - min(r.r, r.g, r.b) <= 1 for r in out)


def test_known_colours_and_round_trip(spark):
    rng = random.Random(9)
    colours = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0)] + [tuple(rng.randrange(256) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(colours, "r int, g int, b int")
    lab = df.select("r", "g", "b", *[x.alias(n) for x, n in zip(colour.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), ("l", "a", "k"), strict=True)])
    rows = lab.select("*", *[x.alias(f"{n}2") for x, n in zip(colour.lab_to_rgb(F.col("l"), F.col("a"), F.col("k")), "rgb", strict=True)]).collect()
    # published Lab values of the primaries on an 8-bit image's scale
    assert [[round(r[c]) for c in ("l", "a", "k")] for r in rows[:5]] == [[136, 208, 195], [224, 42, 211], [82, 207, 20], [255, 128, 128], [0, 128, 128]]
    assert all(abs(r[c] - r[f"{c}2"]) <= 1 for r in rows for c in "rgb")


def test_mesh_traits_of_known_triangles(spark):
    """A flat leaf, an upright one, one at 45 degrees, a stem, and a face without area."""
    points = [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 2), (1, 0, 1), (0, 0, 5), (0.5, 0, 0)]
    vertices = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(points)], "raster_id int, vertex_id int, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 1, 2, 2, 1), (1, 0, 1, 3, 2, 2), (1, 0, 2, 4, 2, 3), (1, 0, 1, 5, 0, 4), (1, 0, 1, 6, 2, 3), (1, 0, 1, 99, 2, 8), (2, 0, 1, 2, 2, 1)], "raster_id int, a int, b int, c int, organ int, part int")
    got = aggregates.mesh_traits(vertices, faces).collect()
    assert [r.raster_id for r in got] == [1]
    r = got[0]
    assert (r.height, r.stem_height, r.leaf_count) == (5.0, 5.0, 3)
    assert abs(r.leaf_area - (1 + 1 + 2**0.5)) < 1e-9
    assert np.allclose(r.inclination_area, [1, 0, 0, 0, 0, 2**0.5, 0, 0, 0, 1]) or np.allclose(r.inclination_area, [1, 0, 0, 0, 2**0.5, 0, 0, 0, 0, 1])


ROVER = {
    "AgRowStitch_plot-12-3.jpg": ("12", 3), "AgRowStitch-plot_12_3.JPEG": ("12", 3), "agrowstitch_PLOT-12.png": ("12", None), "AgRowStitch_plot12-3.tif": ("12", 3),
    "AgRowStitch_plot-A7-04.tiff": ("A7", 4), "AgRowStitch_plot-12-3x.jpg": ("12", 3), "AgRowStitch_plot-12-x3.jpg": ("12", None), "field2_AgRowStitch_plot-1-2.jpg": None,
    "x-AgRowStitch_plot-1-2.jpg": ("1", 2), "AgRowStitch_plot-12.3.jpg": ("12", None), "AgRowStitchplot-1.jpg": (None, None), "AgRowStitch_plots-1.jpg": ("s", 1),
    "AgRowStitch_plot-.jpg": (None, None), "AgRowStitch_plot--1.jpg": (None, None), "AgRowStitch_plot-12-3.txt": (None, None), "AgRowStitch_plot-12-3": (None, None),
    "Stitch_plot-1.jpg": (None, None), "": (None, None), None: (None, None),
}


def test_rover_names(spark):
    names = [n for n, want in ROVER.items() if want is not None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(*rover_parts(F.col("n")).values()).collect()
    assert {n: tuple(r) for n, r in zip(names, rows, strict=True)} == {n: ROVER[n] for n in names}


def _scanned(df):
    """Rows that the scan of `df` has read, filters aside, and its plan's text."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, todo, rows = plan.toString(), [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, text


def test_windows_of_a_pyramid_read_few_row_groups(spark, tmp_path):
    rng = np.random.default_rng(14)
    images = [rng.integers(0, 99, (200, 230)), rng.integers(0, 99, (64, 64)), rng.integers(0, 99, (9, 200))]
    path, size = str(tmp_path / "tiles"), 8
    levels = T.pyramid(T.to_tiles(grid(spark, *images), size), 3, size)
    write_tiles(levels, path, **{"parquet.block.size": "20000", "compression": "none"})
    for level in range(4):
        step = 1 << level
        for i, img in enumerate(images):
            want = img[step // 2 :: step, step // 2 :: step]
            assert np.array_equal(dense(read_window(spark, path, i, level, size=size), want.shape, i), want), (level, i)
    groups = [g for f in (tmp_path / "tiles").glob("*.parquet") for g in [pq.ParquetFile(f).metadata] for g in [g.row_group(k) for k in range(g.num_row_groups)]]
    total = sum(g.num_rows for g in groups)
    window = read_tiles(spark, path, 0, 1, (30, 50), (40, 60), size)
    rows, plan = _scanned(window)
    assert "EqualTo(level,1)" in plan.split("PushedFilters: [")[1]
    # the row groups whose ranges meet the window hold all that was read
    names = {"raster_id": (0, 0), "level": (1, 1), "ty": (3, 6), "tx": (5, 7)}
    stat = lambda g: {g.column(k).path_in_schema: g.column(k).statistics for k in range(g.num_columns)}
    met = [g for g in groups if all(stat(g)[n].min <= hi and stat(g)[n].max >= lo for n, (lo, hi) in names.items())]
    assert len(groups) > 20 and len(met) <= len(groups) // 4
    assert window.count() == 12 and rows <= sum(g.num_rows for g in met) < total // 4


def test_a_level_needs_whole_pixels(spark):
    with pytest.raises(ValueError, match="whole number"):
        T.pyramid(T.to_tiles(grid(spark, np.ones((9, 9))), 12), 3, 12)
