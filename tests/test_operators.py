"""Operators against plain computations and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.functions import projection as P
from plotweave.functions.names import artifact_parts, rover_parts
from plotweave.operators import aggregates, annotations, catalog, connect, geo, joins, numbering, raster, scenario
from plotweave.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_names(spark):
    names = ["dap_10_plot_3_4_0000_depth.jpeg", "dap_10_plot_3_4_0001_sam_masks.json", "dap_7_plot_1_2_0000_gt.png", "dap_7_plot_1_2.json", "other.txt"]
    got = [tuple(r) for r in frame(spark, [(n,) for n in names], "n string").select(*artifact_parts(F.col("n")).values()).collect()]
    assert got == [(10, 3, 4, 0, None, "depth", "jpeg"), (10, 3, 4, 1, "sam", "masks", "json"), (7, 1, 2, 0, "gt", None, "png"), (7, 1, 2, None, None, None, "json"), (None,) * 7]
    rover = frame(spark, [("AgRowStitch_plot-12-3.jpg",), ("agrowstitch-plot_7.PNG",), ("AgRowStitch_plot-1.txt",), (None,)], "n string")
    assert [tuple(r) for r in rover.select(*rover_parts(F.col("n")).values()).collect()] == [("12", 3), ("7", None), (None, None), (None, None)]


def test_overrides_draw_a_seed_once(spark):
    scenes = frame(spark, [(1, None), (2, 5)], "scene_id long, seed long")
    first = catalog.apply_overrides(scenes, {"seed": 0}).orderBy("scene_id").collect()
    assert first == catalog.apply_overrides(scenes, {"seed": 0}).orderBy("scene_id").collect()
    assert first[0].seed is not None and first[1].seed == 5
    assert {r.seed for r in catalog.apply_overrides(scenes, {"seed": 9}).collect()} == {9}


def test_projection_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-179, 179), rng.uniform(-79, 79)) for _ in range(200)]
    df = geo.to_utm(frame(spark, rows, "lon double, lat double")).withColumnsRenamed({"lon": "lon0", "lat": "lat0"})
    back = geo.from_utm(df, P.utm_zone(F.col("lon0")), F.col("lat0") < 0)
    worst = back.agg(F.max(F.abs(F.col("lon") - F.col("lon0"))), F.max(F.abs(F.col("lat") - F.col("lat0")))).first()
    assert max(worst) < 1e-9


def test_projection_of_a_known_point(spark):
    lon, lat = frame(spark, [(606130.43753, 4265698.379605)], "x double, y double").select(*P.from_utm(F.col("x"), F.col("y"), F.lit(10))).first()
    assert round(lat, 5) == 38.53337 and round(lon, 5) == -121.78234


def test_boxes_there_and_back(spark):
    rows = [(1, 10.0, 20.0, 30.0, 40.0)]
    boxes = frame(spark, rows, "image_id int, x double, y double, w double, h double")
    images = frame(spark, [(1, 200, 100)], "image_id int, width int, height int")
    yolo = annotations.coco_to_yolo(boxes, images).select("x_c", "y_c", F.col("w_n").alias("w"), F.col("h_n").alias("h"))
    r = annotations.yolo_to_pixels(yolo, F.lit(200), F.lit(100)).first()
    assert np.allclose([r.x1, r.y1, r.x2, r.y2], [10, 20, 40, 60])


def test_as_of_carries_over_days(spark):
    weather = frame(spark, [("2024-01-01 10:00:00", 1.0), ("2024-01-03 05:00:00", 2.0)], "h string, t double").select(F.to_timestamp("h").alias("hour_ts"), "t")
    events = frame(spark, [(1, "2024-01-01 09:00:00"), (2, "2024-01-01 10:00:00"), (3, "2024-01-02 23:00:00"), (4, "2024-01-03 04:59:00"), (5, "2024-01-09 00:00:00")], "id int, s string").select("id", F.to_timestamp("s").alias("ts"))
    got = {r.id: r.t for r in joins.weather_as_of(events, weather, "ts").collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}


def test_points_in_a_triangle(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    plots = frame(spark, [(1, ring, 0.0, 0.0, 10.0, 10.0)], "plot int, ring array<struct<x:double,y:double>>, min_x double, min_y double, max_x double, max_y double")
    points = frame(spark, [(float(x) + 0.5, float(y) + 0.5) for x in range(12) for y in range(12)], "x double, y double")
    got = {(r.x, r.y) for r in joins.points_in_plots(points, plots, 3.0).collect()}
    assert got == {(r.x, r.y) for r in points.collect() if r.x + r.y < 10}


def _in_ring(px, py, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def _polygons(rng, n, size):
    """Rings of 3 to 9 corners, some of them not convex."""
    out = []
    for _ in range(n):
        cx, cy = rng.uniform(0, size), rng.uniform(0, size)
        turns = sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 9)))
        out.append([(cx + rng.uniform(1, size / 4) * math.cos(t), cy + rng.uniform(1, size / 4) * math.sin(t)) for t in turns])
    return out


@pytest.mark.parametrize("most", [1, 40, 10**9])
def test_points_in_any_polygon_and_any_split(spark, most):
    rng = random.Random(11)
    rings = _polygons(rng, 25, 60.0) + [[(0.0, 0.0), (32.0, 0.0), (32.0, 32.0), (0.0, 32.0)]]
    spots = [(i, rng.uniform(-5, 65), rng.uniform(-5, 65)) for i in range(600)] + [(1000 + i, float(i % 9) * 4, float(i // 9) * 4) for i in range(81)] + [(2000 + i, 7.5, 7.5) for i in range(5)]
    plots = frame(spark, [(i, r, *(f(p[k] for p in r) for f in (min, max) for k in (0, 1))) for i, r in enumerate(rings)], "plot int, ring array<struct<x:double,y:double>>, min_x double, min_y double, max_x double, max_y double")
    points = frame(spark, spots, "id int, x double, y double")
    got = sorted((r.id, r.plot) for r in joins.points_in_plots(points, plots, 16.0, most=most).collect())
    assert got == sorted((i, k) for i, x, y in spots for k, ring in enumerate(rings) if _in_ring(x, y, ring))


def test_a_plot_with_most_points_is_many_keys(spark):
    """Nine tenths of the points lie in one plot: no task gets over twice the median."""
    points = spark.range(20_000).select("id", F.when(F.col("id") < 18_000, F.rand(1) * 4 + 8).otherwise(F.rand(2) * 100).alias("x"), F.when(F.col("id") < 18_000, F.rand(3) * 4 + 8).otherwise(F.rand(4) * 100).alias("y"))
    crowded = joins.crowded_cells(points, 16.0, "x", "y", 200).collect()
    assert {r.level for r in crowded} == {0, 1, 2}
    # the keys that points get: the cell below the last crowded one
    split = {(r.level, r.cx, r.cy) for r in crowded}

    def key(x, y):
        level = 0
        while level < joins.LEVELS and (level, int(x // (16 / 4**level)), int(y // (16 / 4**level))) in split:
            level += 1
        return level, int(x // (16 / 4**level)), int(y // (16 / 4**level))

    keys = frame(spark, [key(r.x, r.y) for r in points.collect()], "l int, cx int, cy int")
    assert keys.groupBy("l", "cx", "cy").count().agg(F.max("count")).first()[0] <= 200
    sizes = sorted(r["count"] for r in keys.repartition(8, "l", "cx", "cy").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_polygon_spans_equal_the_ring_test(spark):
    rng = random.Random(12)
    rings = _polygons(rng, 30, 40.0) + [[(2.0, 1.0), (5.0, 1.0), (5.0, 4.0), (2.0, 4.0)], [(2.5, 1.5), (6.5, 1.5), (6.5, 4.5), (2.5, 4.5)]]
    windows = frame(spark, [(i, 0, 45, 0, 41, r) for i, r in enumerate(rings)], "plot int, x1 int, x2 int, y1 int, y2 int, ring array<struct<x:double,y:double>>")
    pixels = frame(spark, [(r, c, 1) for r in range(45) for c in range(50)], "row long, col long, v int")
    want = {(i, r, c) for i, ring in enumerate(rings) for r in range(41) for c in range(45) if _in_ring(c + 0.5, r + 0.5, ring)}
    assert {(r.plot, r.row, r.col) for r in geo.crop_to_plots(pixels, windows, "polygon", None, 16).collect()} == want
    kept = geo.crop_to_plots(pixels, windows, "polygon", 0, 16)
    assert kept.count() == len(rings) * 41 * 45 and {(r.plot, r.row, r.col) for r in kept.where("v = 1").collect()} == want


@pytest.mark.parametrize("bins", [2, 5, 1024])
def test_exact_quantiles_by_refinement(spark, monkeypatch, bins):
    monkeypatch.setattr(aggregates, "QUANTILE_BINS", bins)
    rng = random.Random(13)
    groups = {1: [rng.gauss(0, 1e6) for _ in range(301)], 2: [5.0] * 40, 3: [1.0, 2.0], 4: [None, None], 5: [rng.choice([1.0, 1.0 + 1e-15, 1e300, -1e300]) for _ in range(99)], 6: [float(i % 7) for i in range(50)]}
    rows = frame(spark, [(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    shares = {"median": 0.5, "q1": 0.25, "top": 1.0, "p": 0.937}
    got = {r.g: r for r in aggregates.exact_quantiles(rows, ["g"], "v", shares).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    for g, r in got.items():
        for name, p in shares.items():
            assert np.isclose(r[name], np.quantile([v for v in groups[g] if v is not None], p), rtol=1e-12), (g, name)
    assert aggregates.exact_quantiles(rows.where("g = 3"), [], "v", {"m": 0.5}).collect() == [(1.5,)]
    assert aggregates.exact_quantiles(rows.where("g = 4"), ["g"], "v", {"m": 0.5}).count() == 0


def test_approximate_histogram_is_near_the_exact_one(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 1000).cast("double").alias("v"))
    exact = {(r.g, r.bin): r.n for r in aggregates.raster_histogram(rows, ["g"], 10).collect()}
    near = {(r.g, r.bin): r.n for r in aggregates.raster_histogram(rows, ["g"], 10, accuracy=500).collect()}
    assert set(exact) == set(near) and all(abs(near[k] - n) <= 0.1 * n for k, n in exact.items())


def test_numbers_after_others_and_with_a_name_that_is_there(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).alias("k"), F.lit(-1).alias("n"))
    got = sorted((r.n, r.g, r.k) for r in numbering.numbered(rows.repartition(5), ["g"], ["k"], "n", start=10).collect())
    assert [(g, k) for _, g, k in got] == sorted((i % 3, i * 7 % 1000) for i in range(1000)) and [n for n, _, _ in got] == list(range(10, 1010))


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.component for r in connect.components(frame(spark, links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in {x for a, b in links if a != b for x in (a, b)}}


@pytest.mark.parametrize("chunk", [7, 40, 1 << 20])
def test_thinned_links_keep_the_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(connect, "CHUNK", chunk)
    rng = random.Random(17)
    links = [(a, b) for g in range(5) for a in range(g * 50, g * 50 + 12) for b in range(g * 50, g * 50 + 12)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(90)]
    thin = connect.local_stars(frame(spark, links, "a long, b long")).collect()
    assert len(thin) < len([1 for a, b in links if a != b]) and all(r.a > r.b for r in thin)
    plain = lambda edges: {frozenset(c) for c in _classes(edges)}
    assert plain([(r.a, r.b) for r in thin]) == plain(links)
    got = {}
    for r in connect.components(frame(spark, links, "a long, b long")).collect():
        got.setdefault(r.component, set()).add(r.v)
    assert {frozenset(v) for v in got.values()} == plain(links) and all(min(v) == k for k, v in got.items())


def _classes(edges):
    out = {}
    for a, b in edges:
        if a != b:
            whole = out.get(a, {a}) | out.get(b, {b})
            for v in whole:
                out[v] = whole
    return out.values()


def test_components_without_links(spark):
    assert connect.components(frame(spark, [], "a long, b long")).count() == 0


def _grid(spark, values, partitions=3):
    rows = [(0, r, c, int(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return frame(spark, rows, "raster_id int, row long, col long, v int").repartition(partitions)


def _dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.row, r.col] = r.v
    return out


def test_blur_and_morphology_by_brute_force(spark):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 255, (9, 11))
    pad = np.pad(img.astype(float), 1, mode="reflect")
    k = np.array([0.25, 0.5, 0.25])
    want = sum(k[i] * k[j] * pad[i : i + 9, j : j + 11] for i in range(3) for j in range(3))
    assert np.allclose(_dense(raster.gaussian_blur(_grid(spark, img), 3), img.shape), want)
    mask = (img > 90) * 255
    wide = np.pad(mask, 2, constant_values=255)
    eroded = np.min([wide[2 + dy : 11 + dy, 2 + dx : 13 + dx] for dy, dx in raster.ellipse(5)], axis=0)
    assert (_dense(raster.morphology(_grid(spark, mask), "erode", raster.ellipse(5)), img.shape) == eroded).all()


@pytest.mark.parametrize("partitions", [1, 5])
def test_labels_do_not_depend_on_partitions(spark, partitions):
    art = ["##..#", "..#..", "#....", "#..##"]
    got = {(r.row, r.col): r.label for r in raster.label_components(_grid(spark, [[255 * (c == "#") for c in line] for line in art], partitions)).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 2): 0, (0, 4): 4, (2, 0): 10, (3, 0): 10, (3, 3): 18, (3, 4): 18}


def test_detection_finds_two_plants(spark):
    rows = []
    for r in range(30):
        for c in range(40):
            green = (5 <= r < 13 and 5 <= c < 13) or (15 <= r < 23 and 22 <= c < 38)
            rows.append((0, r, c, 40 if green else 120, 200 if green else 100, 40 if green else 110))
    rgb = frame(spark, rows, "raster_id int, row long, col long, r int, g int, b int")
    got = sorted((round(p.cx), round(p.cy)) for p in raster.detect_plants(rgb, 0.01, min_size=4, kernel_small=3, kernel_large=3).collect())
    assert got[0] == (8, 8)
    # the long blob is cut into pieces along its length
    assert len(got) in (3, 4) and all(y == 18 and 22 <= x < 38 for x, y in got[1:])


def test_cubic_resize_of_a_constant(spark):
    img = np.full((6, 6), 7)
    got = _dense(raster.resize_raster(_grid(spark, img), (6, 6), (9, 4), "cubic"), (4, 9))
    assert np.allclose(got, 7)


def test_clahe_keeps_the_range(spark):
    img = np.arange(256).reshape(16, 16)
    got = _dense(raster.clahe(_grid(spark, img), tiles=2), img.shape)
    assert got.min() >= 0 and got.max() <= 255 and got[0, 0] < got[15, 15]


def test_samples_are_bounded_and_repeatable(spark):
    leaves = frame(spark, [(1, ".a", "uniform", 1.0, 3.0, None, None, None, True, None), (1, ".b", "uniform", 0.0, 1.0, None, None, None, False, None), (1, ".c", "categorical", None, None, None, None, [], False, None), (1, ".d", "normal", None, None, 5.0, 2.0, None, False, None)], "k int, path string, dist string, low double, high double, mean double, std double, categories array<string>, whole boolean, value string")
    got = scenario.sample_params(leaves, "k", 4000, 7).select("path", "drawn").collect()
    by = {p: [r.drawn for r in got if r.path == p] for p in (".a", ".b", ".c", ".d")}
    assert set(by[".a"]) == {"1", "2", "3"} and set(by[".c"]) == {'""'}
    assert all(0 <= float(x) <= 1 for x in by[".b"])
    normal = np.array([float(x) for x in by[".d"]])
    assert abs(normal.mean() - 5) < 0.15 and abs(normal.std() - 2) < 0.15
    again = scenario.sample_params(leaves.repartition(3), "k", 4000, 7).select("path", "drawn").collect()
    assert sorted(got) == sorted(again)


def test_genotypes_of_any_scene_id(spark):
    from plotweave.plans import raster_queries

    ids = [0, 7, 199_999, 200_000, 5_000_000_000, -3]
    got = raster_queries._x4(spark.createDataFrame([(i,) for i in ids], "scene_id long")).collect()
    assert sorted(r.genotype_id for r in got) == sorted(ids) and all(r[f"{t}_min"] < r[f"{t}_max"] for r in got for t in scenario.GENOTYPE_RANGES)


def test_literal_documents_survive_assembly(spark):
    """Documents without draws come back as they were: nested arrays, empty containers, nulls, quotes and types."""
    import json

    texts = ['{"a": [1, [2, {"b": "x"}], []], "c": {"d": {}, "e": null, "f": true}, "g": 1.5, "h": "a \\"q\\" \\\\"}', '{"k\\"ey": {"z": [0, {"y": "v"}, {"y": "w", "x": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]}]}, "s": "t"}', "[1, {}]"]
    docs = frame(spark, list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("doc"))
    leaves = scenario.leaf_distributions(scenario.flatten_params(docs, "id", depth=8))
    out = scenario.assemble_params(scenario.sample_params(leaves, "id", 1), "id")
    assert {r.id: json.loads(r.document) for r in out.collect()} == {i: json.loads(t) for i, t in enumerate(texts)}


def test_old_dialect_of_distributions(spark):
    docs = frame(spark, [(1, '{"plant_age": {"sampling": "uniform", "min": 10, "max": 100}, "h": {"sampling": "normal", "mean": 1.5, "stddev": 0.5}}')], "id int, t string").select("id", F.parse_json("t").alias("doc"))
    got = {r.path: r for r in scenario.leaf_distributions(scenario.flatten_params(docs, "id")).collect()}
    assert (got[".plant_age"].low, got[".plant_age"].high, got[".plant_age"].whole) == (10.0, 100.0, True)
    assert (got[".h"].mean, got[".h"].std) == (1.5, 0.5)


def test_numbering_is_gapless_with_ties_and_nulls(spark):
    rows = frame(spark, [(1, 1, "a"), (1, 1, "a"), (None, 2, "b"), (1, None, "c"), (2, 1, "d")], "bed int, tier int, x string")
    got = sorted(r.annotation_id for r in numbering.global_annotation_ids(rows, ["x"]).collect())
    assert got == [0, 1, 2, 3, 4]


def test_operators_take_empty_tables(spark):
    none = frame(spark, [], "raster_id int, row long, col long, v int")
    assert raster.gaussian_blur(none).count() == 0
    assert raster.label_components(none).count() == 0
    assert raster.otsu(none).count() == 0
    assert aggregates.raster_stats(none, ["raster_id"]).count() == 0


def test_malformed_files_are_listed(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"images": [{"id": 1, "file_name": "a.jpeg"}], "annotations": [{"id": 1, "image_id": 1, "bbox": [1, 2, 3, 4]}]}')
    (tmp_path / "bad.json").write_text('{"images": [')
    out = readers.read_coco(spark, str(tmp_path))
    assert out["images"].count() == 1 and [r.source for r in out["corrupt"].collect()] == ["bad.json"]
    (tmp_path / "dap_1_plot_2_3_0000_params.json").write_text('{"seed": 3}')
    docs = {r.file_name: r.doc for r in readers.read_scene_params(spark, str(tmp_path)).select("file_name", F.to_json("doc").alias("doc")).collect()}
    assert docs["bad.json"] is None and docs["dap_1_plot_2_3_0000_params.json"] == '{"seed":3}'


def test_scene_matrix_shuffles_genotypes_only(spark):
    """The join that leaves out existing scenes comes before the matrix is opened, whatever existing rows hold."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        genotypes = frame(spark, [(1,), (2,), (2,), (None,)], "genotype_id long")
        existing = frame(spark, [(1, 10, 0), (1, 10, 0), (1, 20, 2), (2, 30, 0), (2, None, 1), (2, 10, 9), (3, 10, 0), (None, 10, 0)], "genotype_id long, dap int, scene int")
        out = scenario.scene_matrix(genotypes, [10, 20], 3, existing)
        whole = [(d, s) for d in (10, 20) for s in range(3)]
        want = [(1, d, s) for d, s in whole if (d, s) not in ((10, 0), (20, 2))] + 2 * [(2, d, s) for d, s in whole] + [(None, d, s) for d, s in whole]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        long = scenario.scene_matrix(genotypes.where("genotype_id = 1"), [10, 20], 100, existing.unionByName(frame(spark, [(1, 10, 62), (1, 10, 63), (1, 20, 99)], existing.schema)))
        assert {(d, s) for d in (10, 20) for s in range(100)} - {(r.dap, r.scene) for r in long.collect()} == {(10, 0), (20, 2), (10, 62), (10, 63), (20, 99)} and long.count() == 195
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Join")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_scene_extents_are_those_of_its_plants(spark):
    """A scene's size is the extent of its plants and a margin, and comes without a join or a shuffle."""
    ends = {f"{t}_{e}": v for t, e, v in (("plant_count", "min", 0.0), ("plant_count", "max", 6.0), ("plant_spacing_x", "min", 0.3), ("plant_spacing_x", "max", 0.9), ("plant_spacing_y", "min", 0.4), ("plant_spacing_y", "max", 1.2))}
    ids = frame(spark, [(i,) for i in range(40)] + [(None,)], "genotype_id long").withColumns({n: F.lit(v) for n, v in ends.items()})
    plants, plan = scenario.scene_plan(scenario.scene_matrix(ids, [10, 30], 3))
    assert not {"Join", "Aggregate"} & set(plan._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())
    key = lambda r: (r.genotype_id, r.dap, r.scene)
    spots = {}
    for r in plants.collect():
        spots.setdefault(key(r), []).append((r.x, r.y))
    margin = {key(r): r.m for r in scenario.scene_matrix(ids, [10, 30], 3).select("genotype_id", "dap", "scene", (0.5 + scenario.uniform(42, F.col("genotype_id"), F.col("dap"), F.col("scene"), "margin") * 1.5).alias("m")).collect()}
    rows = plan.collect()
    assert len(rows) == 246 and any(r.n_plants == 0 for r in rows) and any(r.n_plants > 3 for r in rows)
    for r in rows:
        at = spots.get(key(r), []) if r.genotype_id is not None else []
        assert not at or len(at) == r.n_plants
        size = [max(v) - min(v) + margin[key(r)] for v in zip(*at)] or [2.5, 5.0]
        assert np.allclose([r.plot_size_x, r.plot_size_y], size, rtol=0, atol=1e-12)


def test_field_document_in_packed_parts(spark, tmp_path):
    """The parts of a packed field document, joined in the order of their names, are one gzip file of the whole document."""
    import gzip
    import json

    from plotweave.sources import writers

    anns = spark.range(5000).select("id", F.lit(0).alias("image_id"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("bbox"), F.when(F.col("id") % 2 == 0, F.lit("even")).alias("kind"), F.lit(1).alias("bed"), F.lit(2).alias("tier"))
    field = {"images": frame(spark, [(0, "f.jpeg")], "id int, file_name string"), "annotations": anns.repartition(7), "categories": frame(spark, [(1, "c1")], "id int, name string")}
    whole = {}
    for codec in ("none", "gzip"):
        writers.write_field_coco(field, f"file://{tmp_path}/{codec}", codec)
        parts = b"".join(p.read_bytes() for p in sorted((tmp_path / codec).glob("part-*")))
        whole[codec] = parts if codec == "none" else gzip.decompress(parts)
    assert whole["gzip"] == whole["none"]
    doc = json.loads(whole["gzip"])
    assert doc["categories"] == [{"id": 1, "name": "c1"}] and doc["images"] == [{"id": 0, "file_name": "f.jpeg"}]
    assert doc["annotations"] == [{"id": i, "image_id": 0, "bbox": [float(i), 2.0]} | ({"kind": "even"} if i % 2 == 0 else {}) for i in range(5000)]
    used = sum(p.stat().st_size for p in (tmp_path / "gzip").glob("part-*"))
    assert used * 4 < len(whole["none"])


def test_assembly_compares_paths_once(spark):
    """A leaf's path is compared with the one before once, and scenes with a null value have no document."""
    import json

    texts = ['{"a": [1, [2, {"b": "x"}], []], "q\\"\\\\": {"d": {}, "e": null}}', "[[[[1]]], [[2, {}]]]", '{"u": {"distribution": {"type": "uniform", "params": {"min": null}}}, "v": 1}']
    docs = frame(spark, list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("doc"))
    out = scenario.assemble_params(scenario.sample_params(scenario.leaf_distributions(scenario.flatten_params(docs, "id", depth=8)), "id", 3), "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("aggregate(") == 1
    got = {(r.id, r.scene): r.document and json.loads(r.document) for r in out.collect()}
    assert got == {(i, s): None if i == 2 else json.loads(t) for i, t in enumerate(texts) for s in range(3)}


def test_draws_hashed_at_once(spark):
    """Draws in numpy are those of SQL, for texts of any length, in any slice."""
    import pyarrow as pa

    from plotweave.functions import draws

    heads = ["", "42", "42|7|10|0", "42|ü|-3"] + ["x" * n for n in (44, 45, 52, 55, 56, 63, 64, 118, 119, 120, 130)]
    tails = ["", "n", "12|x", "y" * 9, "z" * 70]
    of, which = (a.ravel() for a in np.meshgrid(np.arange(len(heads)), np.arange(len(tails)), indexing="ij"))
    rows = frame(spark, [(int(i), int(j), heads[i], tails[j]) for i, j in zip(of, which)], "i int, j int, head string, tail string")
    want = [r.u for r in rows.orderBy("i", "j").select(scenario.uniform(F.col("head"), F.col("tail")).alias("u")).collect()]
    held = pa.array(["gone", *heads]).slice(1)
    got = draws.Heads(held).uniform(of, [f"|{t}" for t in tails], which)
    assert got.tolist() == want
    many = np.tile(np.arange(len(of)), 700)
    assert (draws.Heads(held).uniform(of[many], [f"|{t}" for t in tails], which[many]) == got[many]).all()
    assert len(draws.Heads(pa.array([], pa.string())).uniform(of[:0], [], which[:0])) == 0


def test_scene_plan_draws_outer_plants_only(spark, monkeypatch):
    """Extents are bit for bit those of all plants, though inner ones aren't drawn, whatever the ranges; no draw is left to a function of array elements."""
    names = [f"{t}_{e}" for t in ("plant_count", "plant_spacing_x", "plant_spacing_y") for e in ("min", "max")]
    nan, inf = float("nan"), float("inf")
    ranges = [(3, 14, 0.3, 0.9, 0.4, 1.3), (0, 2, 0.3, 0.4, 0.4, 0.5), (200, 900, 0.3, 0.31, 0.4, 2.0), (70000, 70001, 0.3, 0.9, 0.4, 1.3), (5, 9, 0.9, 0.3, -0.4, -1.3), (5, 9, -0.5, 0.5, 0.0, 0.0), (5, 9, nan, 0.4, 0.1, nan), (5, 9, inf, 0.4, 0.1, inf), (5, 9, None, 0.4, 0.1, None), (None, 9, 0.3, 0.4, 0.1, 0.2), (-5, -2, 0.3, 0.4, 0.1, 0.2), (nan, 4, 0.3, 0.4, 0.1, 0.2)]
    rows = [(f"g{i}", *[None if v is None else float(v) for v in r]) for i, r in enumerate(ranges)] + [(None, *map(float, ranges[0]))]
    matrix = scenario.scene_matrix(frame(spark, rows, "genotype_id string, " + ", ".join(f"{n} double" for n in names)), [10, 30], 4).where("genotype_id is null or genotype_id != 'g3' or (dap = 10 and scene = 0)")
    plants, plan = scenario.scene_plan(matrix)
    assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString()
    key = ["genotype_id", "dap", "scene"]
    size = plants.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xy"])
    margin = 0.5 + scenario.uniform(42, *[F.col(k) for k in key], "margin") * 1.5
    want = matrix.join(size, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("x") + margin, F.lit(2.5)).alias("x"), F.coalesce(F.col("y") + margin, F.lit(5.0)).alias("y"))
    got = plan.select(*key, F.greatest(F.coalesce("n_plants", F.lit(0)), F.lit(0)).cast("long").alias("n"), F.col("plot_size_x").alias("x"), F.col("plot_size_y").alias("y"))
    rows = got.collect()
    assert sorted(str(r) for r in rows if r.genotype_id is not None) == sorted(map(str, want.where("genotype_id is not null").collect()))
    assert len(rows) == 97 and {(r.x, r.y) for r in rows if r.genotype_id is None} == {(2.5, 5.0)}
    # hashed: three draws of a scene, and fewer than two for each of its plants
    hashed, block = [], scenario.draws._block
    monkeypatch.setattr(scenario.draws, "_block", lambda state, words: hashed.append(words.shape[1]) or block(state, words))
    import pyarrow as pa

    n = 2000
    out = scenario._drawn_plan(pa.array([f"42|{i}|10|0" for i in range(n)]), *[pa.array(np.full(n, v)) for v in (3.0, 14.0, 0.35, 0.7, 0.45, 1.1)])
    assert 3 * n < sum(hashed) < 3 * n + 1.5 * sum(out.field("n_plants").to_pylist())


def test_matrix_is_dealt_once(spark):
    """Genotypes and existing scenes are dealt alike, once, also where more partitions are the session's rule: the wide rows aren't shuffled again."""
    from plotweave.plans import raster_queries

    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        out = raster_queries._x5(frame(spark, [(i,) for i in range(100)], "scene_id long"))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert out.count() == 12 * 100 - 15
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
