"""Documents written in parts are whole JSON documents; cameras of scenes without vertices."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from plotweave.operators import aggregates, geo
from plotweave.sources import writers
from plotweave.sources.parts import object_text, read_document_parts, write_document_parts


def whole(folder):
    """The document of a folder: its files in the order of their names."""
    return json.loads("".join(p.read_text() for p in sorted(Path(folder).glob("part-*"))))


def test_documents_of_any_size(spark, tmp_path):
    heads = spark.createDataFrame([("a",), ("b",), ("none",)], "k string").withColumn("value", F.concat(F.lit('{"name":"'), "k", F.lit('","list":[')))
    big = spark.range(3000).select(F.lit("a").alias("k"), (F.col("id") * 7 % 3000).alias("at"), F.to_json(F.struct("id")).alias("value"))
    items = big.unionByName(spark.createDataFrame([("b", 1, '"x, y"'), ("b", None, "null"), ("b", 1, '"x, y"'), ("lost", 1, "1")], "k string, at long, value string"))
    path = str(tmp_path / "docs")
    write_document_parts(heads, items.repartition(7), ["k"], ["at"], path)
    a = whole(f"{path}/k=a")
    assert a["name"] == "a" and [x["id"] * 7 % 3000 for x in a["list"]] == list(range(3000))
    assert whole(f"{path}/k=b") == {"name": "b", "list": [None, "x, y", "x, y"]} and whole(f"{path}/k=none") == {"name": "none", "list": []}
    assert sorted(p.name for p in Path(path).glob("k=*")) == ["k=a", "k=b", "k=none"]
    heads, items = read_document_parts(spark, path)
    assert heads.count() == 3 and items.count() == 3003


def test_a_document_with_most_items_is_many_files(spark, tmp_path):
    heads = spark.createDataFrame([(1, '{"l":[')], "k int, value string")
    items = spark.range(40_000).select(F.lit(1).alias("k"), "id", F.repeat(F.lit("1"), 40).alias("value"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_document_parts(heads, items, ["k"], ["id"], str(tmp_path / "d"), end="]}")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "d/k=1").glob("part-*"))) >= 4 and len(whole(tmp_path / "d/k=1")["l"]) == 40_000


def test_survey_documents(spark, tmp_path):
    rows = [(1, "p", 2, 1, 0.5, 0.25, "Cowpea", None), (1, "p", 1, 3, 0.5, 0.5, "Sorghum", 2.0), (1, "q", 1, 1, 0.0, 0.0, "Cowpea", 1.0)]
    plants = spark.createDataFrame(rows, "dap int, plot string, bed int, row int, x double, y double, crop_type string, crop_height double")
    writers.write_survey(plants, ["dap"], ["plot"], str(tmp_path / "s"))
    got = whole(tmp_path / "s/plot=p/dap=1")
    assert (got["crop_types"], got["n_beds"], got["n_rows"]) == (["Cowpea", "Sorghum"], 2, 2)
    assert [(c["bed"], c["row"], c["crop_type"]) for c in got["crops"]] == [(1, 3, "Sorghum"), (2, 1, "Cowpea")]


def test_merged_document_of_a_field(spark, tmp_path):
    plot = lambda bed, tier, n: {"seed": bed * 10 + tier, "environment": {"sun": {"elevation_degrees": 40.0 + bed, "x": 1}, "soil": {"k": [1, {"z": None}]}}, "plant_properties": {"leaf_optics": {}}, "field": {"plots": [{"bed": 9, "row": 9, "plants": [{"x": i} for i in range(n)]}, {"bed": 8}], "layout": {"plot_size_x": 1.0 + tier, "mode": "auto"}}, "camera": {"sensor": {"ISO": 100}}}
    docs = {(2, 1): plot(2, 1, 2), (1, 2): plot(1, 2, 1), (1, 1): plot(1, 1, 3), (3, 1): plot(3, 1, 1)}
    docs[2, 2] = {"field": {}}
    frame = spark.createDataFrame([(b, t, json.dumps(d)) for (b, t), d in docs.items()], "bed int, tier int, text string").select(F.lit("f").alias("field"), "bed", "tier", F.parse_json("text").alias("doc"))
    heads, items = aggregates.merged_documents(frame, (1, 2), (1, 2), bottom_to_top=False, by=["field"])
    write_document_parts(heads, items, ["field"], ["_bed", "_tier"], str(tmp_path / "m"), end="]}}")
    got = whole(tmp_path / "m/field=f")
    assert got["seed"] == 11 and got["environment"]["soil"] == {"k": [1, {"z": None}]}
    assert got["environment"]["sun"] == {"elevation_degrees": (42 + 41 + 41 + 45) / 4, "x": 1, "azimuth_degrees": 180.0}
    assert got["plant_properties"]["leaf_optics"] == {"chlorophyll_content": 30.0}
    assert [(p["bed"], p["row"], len(p["plants"])) for p in got["field"]["plots"]] == [(1, 2, 3), (1, 1, 1), (2, 2, 2)]
    mean = (2 + 3 + 2 + 1.35) / 4
    assert got["field"]["layout"] == {"plot_size_x": mean, "mode": "manual", "plot_size_y": 3.84, "plot_size_z": 0.2, "num_beds": 2, "num_rows": 2}
    assert "plot_shape" not in got["field"] and (got["field"]["num_beds"], got["field"]["num_rows"]) == (2, 2)
    assert got["camera"]["sensor"] == {"ISO": 100, "resolution_x": 2000, "resolution_y": int(2000 * (3.84 * 2) / (mean * 2))}
    assert got["camera"]["positioning"] == {"camera_height": 5.0, "focusing_plants": False, "lookat_offset_x": 0.0, "lookat_offset_y": 0.0, "lookat_offset_z": 0.0}


def test_names_and_values_that_need_quotes(spark):
    base = spark.createDataFrame([('{"a\\"b": "c\\\\d", "e": [], "f": 1}',), ("[1]",), (None,)], "t string").select(F.parse_json("t").alias("v"))
    texts = [r[0] for r in base.select(object_text(F.col("v"), {"f": F.lit("2"), 'g"h': F.lit("3"), "gone": F.lit(None).cast("string")})).collect()]
    assert [json.loads(t) for t in texts] == [{'a"b': "c\\d", "e": [], "f": 2, 'g"h': 3}, {"f": 2, 'g"h': 3}, {"f": 2, 'g"h': 3}]


def test_scenes_without_vertices_keep_their_camera(spark):
    vertices = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 2.0, 1.0)], "s int, x double, y double, z double")
    scenes = spark.createDataFrame([(i, 1.0, 1.0, 5.0, 1.0, 1.0, 0.0, 640, 480) for i in (1, 2)], "s int, camera_x double, camera_y double, camera_z double, lookat_x double, lookat_y double, lookat_z double, resolution_x int, resolution_y int")
    got = {r.s: r for r in geo.focus_camera(vertices, scenes, ["s"]).collect()}
    assert got[2].hfov is None and got[2].camera_z == 5.0 and got[1].hfov > 0


def test_copies_on_a_grid(spark):
    got = geo.copies_on_grid(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), 2, 2, 10.0, 100.0).collect()
    assert sorted((r.bed, r.tier, r.x, r.y, r.z) for r in got) == [(1, 1, 1.0, 2.0, 3.0), (1, 2, 1.0, 102.0, 3.0), (2, 1, 11.0, 2.0, 3.0), (2, 2, 11.0, 102.0, 3.0)]
