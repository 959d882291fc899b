"""Catalog operators: parsed names, range filters, parameter checks and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.names import artifact_parts, dap_from_name, natural_order, rover_parts


def parse_artifact_name(files: DataFrame, col: str = "file_name") -> DataFrame:
    return files.withColumns(artifact_parts(F.col(col)))


def parse_rover_name(files: DataFrame, col: str = "file_name") -> DataFrame:
    return files.withColumns(rover_parts(F.col(col)))


def with_dap(files: DataFrame, planted: str, fallback: str, col: str = "path") -> DataFrame:
    """Add `dap` from the date in a path; `fallback` is the date to use without one."""
    planting = F.to_date(F.lit(planted))
    return files.withColumn("dap", dap_from_name(F.col(col), planting, F.datediff(F.to_date(F.lit(fallback)), planting)))


def natural_places(files: DataFrame, stem: str = "stem", name: str = "place") -> DataFrame:
    """Files numbered from 1 in natural order, dealt by ranges of it."""
    from .numbering import numbered

    keys = {f"_key{i}": k for i, k in enumerate(natural_order(F.col(stem)))}
    return numbered(files.withColumns(keys), [], list(keys), name, start=1).drop(*keys)


def grid_filter(plots: DataFrame, bed_lo: int, bed_hi: int, row_lo: int, row_hi: int, bed: str = "bed", row: str = "tier") -> DataFrame:
    return plots.where(F.col(bed).between(bed_lo, bed_hi) & F.col(row).between(row_lo, row_hi))


# The keys of a scene document that must be there, and those that are looked for besides.
REQUIRED_KEYS = ["seed", "metadata", "environment", "field", "plant_properties", "camera", "metadata.plant_type", "metadata.dap", "field.layout", "field.plots"]
OPTIONAL_KEYS = [
    "metadata.year", "metadata.location", "field.layout.mode",
    "environment.sun", "environment.soil", "environment.sun.elevation_degrees", "environment.sun.azimuth_degrees", "environment.sun.shadow", "environment.soil.spectral_data",
    "camera.sensor", "camera.positioning", "camera.sensor.resolution_x", "camera.sensor.resolution_y", "camera.sensor.focal_plane_distance_difference", "camera.sensor.lens_diameter",
    "camera.positioning.camera_height", "camera.positioning.azimuth_angle", "camera.positioning.distance_from_center",
    "plant_properties.leaf_optics", "plant_properties.architecture",
    *[f"plant_properties.leaf_optics.{k}" for k in ("number_layers", "chlorophyll_content", "carotenoid_content", "anthocyan_content", "brown_pigments", "water_mass", "dry_mass")],
]
#: Keys that are looked for only where their section is there.
SECTION_KEYS = [f"field.layout.sampling.{k}" for k in ("plot_size_x", "plot_size_y", "plot_size_z")]


def validate_params(docs: DataFrame, required: list[str] | None = None, optional: list[str] | None = None, doc: str = "doc") -> DataFrame:
    """Per document: the missing required and optional keys, the verdict, the number of plots and what the first plot has.

    Without `required` and `optional` the rules of scene documents apply. A key
    counts as missing where its section is, but for SECTION_KEYS. A key with a
    JSON null is there. Rules become columns of one projection, so no join with
    a rule table is needed.
    """
    own = required is None and optional is None
    required, optional = REQUIRED_KEYS if required is None else required, OPTIONAL_KEYS if optional is None else optional
    d = F.col(doc)

    def there(path: str) -> Column:
        section, _, key = path.removeprefix("$.").rpartition(".")
        fields = F.try_variant_get(d, f"$.{section}" if section else "$", "map<string,variant>")
        return F.coalesce(F.array_contains(F.map_keys(fields), key), F.lit(False))

    absent = lambda tests: F.array_compact(F.array(*[F.when(~ok, F.lit(p)) for p, ok in tests]))
    plots = F.try_variant_get(d, "$.field.plots", "array<variant>")
    first = F.try_element_at(plots, F.lit(1))
    plants = F.try_variant_get(first, "$.plants", "array<variant>")
    more = [(p, there(p) | ~there(p.rpartition(".")[0])) for p in SECTION_KEYS] if own else []
    out = docs.withColumns({"missing_required": absent([(p, there(p)) for p in required]), "missing_optional": absent([(p, there(p)) for p in optional] + more), "n_plots": F.coalesce(F.size(plots), F.lit(0))})
    out = out.withColumns({"valid": F.size("missing_required") == 0, "first_plot_has_plants": F.coalesce(F.size(plants) > 0, F.lit(False))})
    look = lambda node, k: F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(node, "$", "map<string,variant>")), k), F.lit(False))
    spot = F.try_element_at(plants, F.lit(1))
    return out.withColumn("first_plot_placed", look(first, "bed") & look(first, "row") & (~F.col("first_plot_has_plants") | (look(spot, "x") & look(spot, "y"))))


def apply_overrides(scenes: DataFrame, overrides: dict[str, object], seed: int = 0) -> DataFrame:
    """Given values win over a scene's own where they are set: dap from 0, height and field of view above 0, seed not 0.

    A scene without any seed gets one from a hash of its id. An exposure that is
    given sets the mode to ISO.
    """
    valid = {"dap": lambda v: v >= 0, "camera_height": lambda v: v > 0, "fov": lambda v: v > 0, "seed": lambda v: v != 0}
    use = {k: v for k, v in overrides.items() if v is not None and valid.get(k, lambda v: True)(v)}
    out = scenes.withColumns({k: F.lit(v).cast(scenes.schema[k].dataType if k in scenes.columns else "string") for k, v in use.items()})
    if "seed" in scenes.columns and "seed" not in use:
        drawn = F.pmod(F.xxhash64(F.lit(seed), "scene_id"), F.lit(1 << 31))
        out = out.withColumn("seed", F.coalesce("seed", drawn.cast(scenes.schema["seed"].dataType)))
    return out.withColumn("exposure_mode", F.lit("ISO")) if "exposure" in use else out


#: What an archetype sets, by species group (sorghum or other) and genotype.
ARCHETYPES = [
    ("sorghum", "tall", {"internode_length_max": 0.28}),
    ("sorghum", "dwarf", {"internode_length_max": 0.16}),
    ("other", "bush", {"internode_length_max": 0.03, "max_nodes": 9.0, "leaf_pitch": 45.0, "bud_break": 0.35}),
    ("other", "erect", {"internode_length_max": 0.03, "max_nodes": 9.0, "leaf_pitch": 45.0, "bud_break": 0.35}),
    ("other", "spreading", {"internode_length_max": 0.045, "max_nodes": 10.0, "leaf_pitch": 25.0, "bud_break": 0.45}),
    ("other", "vine", {"internode_length_max": 0.06, "max_nodes": 12.0, "leaf_pitch": 20.0, "bud_break": 0.25, "tortuosity": 4.0}),
    ("other", "climbing", {"internode_length_max": 0.06, "max_nodes": 12.0, "leaf_pitch": 20.0, "bud_break": 0.25, "tortuosity": 4.0}),
]
#: Below these a trait counts as unset.
UNSET = {"internode_length_max": 0.0, "max_nodes": 0.0, "leaf_pitch": -900.0, "bud_break": 0.0, "tortuosity": 0.0}


def genotype_defaults(scenes: DataFrame, species: str = "plant_type", genotype: str = "genotype") -> DataFrame:
    """Fill the traits that a scene leaves unset (null or below UNSET) from its species' archetype."""
    spark = scenes.sparkSession
    rows = [(g, n, *[t.get(k) for k in UNSET]) for g, n, t in ARCHETYPES]
    table = spark.createDataFrame(rows, "_group string, _genotype string, " + ", ".join(f"_{k} double" for k in UNSET))
    group = F.when(F.col(species) == "sorghum", "sorghum").otherwise("other")
    # seven rows
    joined = scenes.join(F.broadcast(table), (group == F.col("_group")) & (F.col(genotype) == F.col("_genotype")), "left")
    own = {k: F.coalesce(F.when(F.col(k) >= least, F.col(k)), F.col(f"_{k}"), F.col(k)) for k, least in UNSET.items() if k in scenes.columns}
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in scenes.columns])


def box_filter(boxes: DataFrame, max_frac: float = 0.8, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Boxes (w, h) of at most `max_frac` of the image in both directions; normalised boxes need no image size."""
    one = F.lit(1.0)
    return boxes.where((F.col("w") <= max_frac * (one if width is None else width)) & (F.col("h") <= max_frac * (one if height is None else height)))


