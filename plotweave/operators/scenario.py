"""Scenario generation: flattened parameter documents, sampled leaves, scene matrices and plans."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import draws

from . import geo


def uniform(seed: Column | int, *salt: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and salt: the same in every run, on every partitioning and in other engines."""
    parts = [F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string"), *[F.lit(s) if isinstance(s, str) else s.cast("string") for s in salt]]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10)
    return bits.cast("long") / float(1 << 52)


def normal(seed: Column | int, *salt: Column | str) -> Column:
    """A standard normal number by Box and Muller on two hashes."""
    u, v = 1 - uniform(seed, *salt, "u"), uniform(seed, *salt, "v")
    return F.sqrt(-2 * F.ln(u)) * F.cos(v * 6.283185307179586)


_STEPS = "array<struct<name:string,at:int>>"


def _is_drawn(node: Column) -> Column:
    """Whether a variant is an object with a distribution, or in the older dialect with a sampling."""
    return F.coalesce(F.try_variant_get(node, "$.distribution", "variant").isNotNull() | F.try_variant_get(node, "$.sampling", "variant").isNotNull(), F.lit(False))


def flatten_params(docs: DataFrame, key: str, doc: str = "doc", depth: int = 6) -> DataFrame:
    """Leaves (key, path, steps, kind, node) of variant documents.

    Objects and arrays are opened down to `depth`; an object with a distribution
    (or a sampling) is a leaf, and so is an empty object or array. Kind is
    `distribution` or `literal`; `steps` are the names and positions of the path.
    Each level is a lateral generator over what the level before has opened: a
    node is looked into once, and a leaf only passes through.
    """
    rows = docs.select(F.col(key).alias("_id"), F.lit("").alias("_path"), F.array().cast(_STEPS).alias("_steps"), F.col(doc).alias("_node"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_new"), _is_drawn(F.col("_node"))).otherwise(F.col("_drawn"))
    for level in range(depth):
        rows = rows.withColumn("_drawn", kind if level else _is_drawn(F.col("_node")))
        rows = rows.withColumn("_open", F.when(F.col("_new") & ~F.col("_drawn"), F.col("_node")))
        rows = rows.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()))
        # an outer row without a place is a leaf, which stays itself
        inner, named = F.col("pos").isNotNull(), F.col("key").isNotNull()
        suffix = F.when(named, F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        step = F.struct(F.col("key").alias("name"), F.when(~named, F.col("pos")).alias("at"))
        rows = rows.select("_id", F.when(inner, F.concat("_path", suffix)).otherwise(F.col("_path")).alias("_path"), F.when(inner, F.array_append("_steps", step).cast(_STEPS)).otherwise(F.col("_steps")).alias("_steps"), F.when(inner, F.col("value")).otherwise(F.col("_node")).alias("_node"), inner.alias("_new"), "_drawn")
    return rows.where("_path != ''").select(F.col("_id").alias(key), F.col("_path").alias("path"), F.col("_steps").alias("steps"), F.when(kind, "distribution").otherwise("literal").alias("kind"), F.col("_node").alias("node"))


#: What a distribution leaf may hold, in both dialects.
_PARAMS = ",".join(f"{n}:variant" for n in ("min", "max", "mean", "std", "stddev", "value"))
_LEAF = f"struct<distribution:struct<type:variant,params:struct<{_PARAMS},categories:array<variant>>>,sampling:variant,{_PARAMS},values:array<variant>>"


def leaf_distributions(leaves: DataFrame) -> DataFrame:
    """Both dialects of distribution leaves as columns: dist, low, high, mean, std, categories, whole, value.

    `categories` and `value` are JSON texts, so types survive. A distribution is
    read in one pass into its fields, a literal isn't looked into.
    """
    node, new, old = F.col("node"), F.col("_leaf.distribution.params"), F.col("_leaf")
    as_json = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    number = lambda v: F.try_variant_get(v, "$", "double")
    opened = leaves.withColumn("_leaf", F.when(F.col("kind") == "distribution", F.try_variant_get(node, "$", _LEAF)))
    either = lambda *names: F.coalesce(*[new[n] for n in names], *[old[n] for n in reversed(names)])
    name = F.coalesce(*[F.try_variant_get(x, "$", "string") for x in (old["distribution"]["type"], old["sampling"])])
    dist = F.when(name == "discrete", "categorical").otherwise(F.coalesce(name, F.lit("literal")))
    ends = [F.schema_of_variant(either(n)) == "BIGINT" for n in ("min", "max")]
    whole = F.coalesce(ends[0] & ends[1], F.lit(False))
    options = F.transform(F.coalesce(new["categories"], old["values"]), as_json)
    fixed = F.when(old.isNull() | (dist == "literal"), as_json(node)).otherwise(as_json(either("value")))
    return opened.select(*[c for c in leaves.columns if c != "node"], dist.alias("dist"), number(either("min")).alias("low"), number(either("max")).alias("high"), number(either("mean")).alias("mean"), number(either("std", "stddev")).alias("std"), options.alias("categories"), whole.alias("whole"), fixed.alias("value"))


def sample_params(leaves: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` scenes per document with a drawn value (JSON text) for each leaf of `leaf_distributions`.

    Uniform draws are whole (ends included) when both ends are, else real;
    reals are rounded to 4 digits; without categories the value is an empty string.
    """
    scenes = leaves.withColumn("scene", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    salt = (F.col(key), F.col("scene"), F.col("path"))
    u = uniform(seed, *salt)
    span = F.col("high") - F.col("low")
    whole = (F.col("low") + F.floor(u * (span + 1))).cast("long").cast("string")
    real = F.round(F.col("low") + u * span, 4).cast("string")
    drawn = F.when(F.col("dist") == "uniform", F.when(F.col("whole"), whole).otherwise(real)).when(F.col("dist") == "normal", F.round(F.col("mean") + normal(seed, *salt) * F.col("std"), 4).cast("string"))
    picked = F.coalesce(F.get("categories", F.floor(u * F.size("categories")).cast("int")), F.lit('""'))
    drawn = drawn.when(F.col("dist") == "categorical", picked).otherwise(F.col("value"))
    return scenes.withColumn("drawn", drawn)


def nested_json(leaves: Column) -> Column:
    """The JSON document of an array of (steps, drawn): objects and arrays as deep as the paths, in the order of names and positions.

    Between a leaf and the one before, the containers that only the latter is in
    are closed and those that only the former is in are opened. A leaf's text
    comes from these two alone, each value in it is worked out once, and texts
    are joined at the end. A null value leaves no document.
    """
    none = F.array().cast(_STEPS)
    left = lambda s: F.when(s["name"].isNull(), F.lit("[")).otherwise(F.lit("{"))
    right = lambda s: F.when(s["name"].isNull(), F.lit("]")).otherwise(F.lit("}"))
    escaped = lambda s: F.replace(F.replace(s["name"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    label = lambda s: F.when(s["name"].isNull(), F.lit("")).otherwise(F.concat(F.lit('"'), escaped(s), F.lit('":')))

    def shared(old: Column, new: Column) -> Column:
        """How many first steps two paths have in common."""
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(old), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & F.get(old, i - 1).eqNullSafe(F.get(new, i - 1)), i).otherwise(n))

    def text(leaf: Column) -> Column:
        old, new, same = leaf["old"], leaf["new"], leaf["same"]
        shut = F.array_join(F.transform(F.reverse(F.slice(old, same + 2, F.greatest(F.size(old) - same - 1, F.lit(0)))), right), "")
        first = F.get(new, same)
        begin = F.when(F.size(old) > 0, F.concat(shut, F.lit(","))).otherwise(left(first))
        deeper = F.array_join(F.transform(F.slice(new, same + 2, F.greatest(F.size(new) - same - 1, F.lit(0))), lambda s: F.concat(left(s), label(s))), "")
        return F.concat(begin, label(first), deeper, leaf["drawn"])

    pairs = F.transform(leaves, lambda leaf, i: F.struct(F.coalesce(F.get(leaves, i - 1)["steps"], none).alias("old"), leaf["steps"].alias("new"), leaf["drawn"].alias("drawn")))
    pairs = F.transform(pairs, lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new"), p["drawn"].alias("drawn"), shared(p["old"], p["new"]).alias("same")))
    last = F.coalesce(F.get(leaves, F.size(leaves) - 1)["steps"], none)
    whole = F.concat(F.array_join(F.transform(pairs, text), ""), F.array_join(F.transform(F.reverse(last), right), ""))
    return F.when(~F.exists(leaves, lambda leaf: leaf["drawn"].isNull()), whole)


def assemble_params(samples: DataFrame, key: str) -> DataFrame:
    """One document (JSON text) per scene, nested and typed like the template, with the drawn values in it."""
    leaves = F.sort_array(F.collect_list(F.struct("steps", "drawn")))
    return samples.groupBy(key, "scene").agg(leaves.alias("leaves"), F.count(F.lit(1)).alias("n_leaves")).select(key, "scene", nested_json(F.col("leaves")).alias("document"), "n_leaves")


#: Ranges of a genotype's traits, lower end of the minimum, its upper end, least gap (or None for a fixed start), upper end of the maximum.
GENOTYPE_RANGES = {
    "plant_count": (3, 8, 1, 15),
    "plant_spacing_x": (0.3, 0.5, 0.1, 1.0),
    "plant_spacing_y": (0.3, 0.6, 0.2, 1.4),
    "leaf_pitch": (-120.0, -60.0, None, (60.0, 120.0)),
    "flower_bud_break": (0.0, 0.2, 0.4, 1.0),
    "chlorophyll": (1.0, 20.0, 10.0, 60.0),
    "carotenoid": (5.0, 10.0, 2.0, 20.0),
}


def virtual_genotypes(spark, n: int, seed: int = 42) -> DataFrame:
    """Genotypes 0 to `n` - 1 with their traits."""
    return with_traits(spark.range(n).withColumnRenamed("id", "genotype_id"), seed)


def with_traits(out: DataFrame, seed: int = 42) -> DataFrame:
    """The rows with a range (min, max) per trait of their genotype_id, the maximum drawn above the minimum."""
    for trait, (lo, hi, gap, top) in GENOTYPE_RANGES.items():
        least = lo + uniform(seed, F.col("genotype_id"), f"{trait}-min") * (hi - lo)
        least = F.floor(least).cast("double") if trait == "plant_count" else least
        start, end = (F.lit(top[0]), top[1]) if gap is None else (least + gap, top)
        most = start + uniform(seed, F.col("genotype_id"), f"{trait}-max") * (end - start)
        most = F.floor(most).cast("double") if trait == "plant_count" else most
        out = out.withColumns({f"{trait}_min": least, f"{trait}_max": most})
    return out


def scene_matrix(genotypes: DataFrame, daps: list[int], scenes: int, existing: DataFrame | None = None) -> DataFrame:
    """Genotype x dap x scene without those that exist (genotype_id, dap, scene).

    What exists becomes a bit per place of the matrix, in words of 63, and is
    joined by genotype before rows are multiplied: only genotypes are shuffled.
    """
    opened = lambda df: df.withColumn("dap", F.explode(F.array(*[F.lit(d) for d in daps]))).withColumn("scene", F.explode(F.sequence(F.lit(0), F.lit(scenes - 1))))
    if existing is None:
        return opened(genotypes)
    known = list(dict.fromkeys(daps))
    place = (F.array_position(F.array(*[F.lit(d) for d in known]), F.col("dap").cast("int")) - 1) * scenes + F.col("scene").cast("int")
    word, bit = F.floor(place / 63), (place % 63).cast("int")
    words = {f"_gone{w}": w for w in range(-(-len(known) * scenes // 63))}
    inside = existing.where(F.col("dap").isin(*known) & F.col("scene").between(0, scenes - 1) & (F.col("scene") == F.floor("scene")))
    gone = inside.groupBy("genotype_id").agg(*[F.bit_or(F.when(word == w, F.call_function("shiftleft", F.lit(1).cast("long"), bit))).alias(n) for n, w in words.items()])
    out = opened(genotypes.join(gone, "genotype_id", "left"))
    taken = F.coalesce(*[F.when(word == w, F.col(n)) for n, w in words.items()], F.lit(0).cast("long"))
    return out.where(F.getbit(taken, bit) == 0).select(*genotypes.columns, "dap", "scene")


def _extents(heads: draws.Heads, n: np.ndarray, n_rows: np.ndarray, ends: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """How far each scene's plants reach along x and y: `n` plants on a grid of `n_rows`, spaced by draws between both ends of an axis.

    What a plant draws is bounded, so one that can't be the outermost isn't drawn:
    it takes its spacing's first end, which lies inside too. Plants are worked on
    in slices, so a scene may have any number.
    """
    cols = np.maximum(1, -(-n // n_rows))
    until = np.cumsum(n)
    middle = {"x": (cols - 1) / 2, "y": (n_rows - 1) / 2}
    last = {"x": cols - 1, "y": (n - 1) // cols}
    sure, reach = {}, {}
    for axis, (a, b) in ends.items():
        # the outermost lines of the grid have a plant each, which is that far out at least
        outer = [[place * step for step in (a, a + (b - a))] for place in (0 - middle[axis], last[axis] - middle[axis])]
        sure[axis] = np.minimum(*[np.maximum(*pair) for pair in outer]), np.maximum(*[np.minimum(*pair) for pair in outer])
        reach[axis] = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    for i, j in draws.ranges(int(until[-1]) if len(n) else 0, 4 * draws.CHUNK):
        place = np.arange(i, j)
        of = np.searchsorted(until, place, "right")
        plant = place - (until - n)[of]
        numbers, number = np.unique(plant, return_inverse=True)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        line = dict(zip("yx", np.divmod(plant, cols[of]), strict=True))
        for axis, (a, b) in ends.items():
            at, a, b = line[axis] - middle[axis][of], a[of], b[of]
            near, far = at * a, at * (a + (b - a))
            inside = (np.minimum(near, far) > sure[axis][0][of]) & (np.maximum(near, far) < sure[axis][1][of])
            drawn = np.flatnonzero((at != 0) & ~inside)
            u = np.zeros(len(of))
            u[drawn] = heads.uniform(of[drawn], [f"|{k}|{axis}" for k in numbers], number[drawn])
            spot = (a + u * (b - a)) * at
            for best, pick in zip(reach[axis], (np.minimum, np.maximum), strict=True):
                best[of[first]] = pick(best[of[first]], pick.reduceat(spot, first))
    return [high - low for low, high in reach.values()]


def _drawn_plan(salt: pa.Array, count_min: pa.Array, count_max: pa.Array, x_min: pa.Array, x_max: pa.Array, y_min: pa.Array, y_max: pa.Array) -> pa.Array:
    """What a scene draws, and the extent of its plants, from the text that its draws begin with and its genotype's ranges."""
    number = lambda c: c.to_numpy(zero_copy_only=False)
    missing = lambda *of: np.logical_or.reduce([number(c.is_null()) for c in of])
    heads, rows = draws.Heads(salt), len(salt)
    u, v, w = heads.uniform(np.tile(np.arange(rows), 3), ["|n", "|rows", "|margin"], np.repeat(np.arange(3), rows)).reshape(3, rows)
    low, most = number(count_min), number(count_max) + 1
    # nothing is drawn for what Spark can't hold as a count
    n = np.nan_to_num(np.floor(low + u * (most - low)).clip(-(2.0**62), 2.0**62)).astype(np.int64)
    n_rows = np.floor(v * 4).astype(np.int32) + 1
    some = (n > 0) & (n < 1 << 31)
    with np.errstate(all="ignore"):
        width, depth = _extents(heads, np.where(some, n, 0), n_rows, {"x": (number(x_min), number(x_max)), "y": (number(y_min), number(y_max))})
    unknown = missing(count_min, count_max)
    columns = [pa.array(n, mask=unknown), pa.array(n_rows), pa.array(width, mask=~some | unknown | missing(x_min, x_max)), pa.array(depth, mask=~some | unknown | missing(y_min, y_max)), pa.array(w)]
    return pa.StructArray.from_arrays(columns, ["n_plants", "n_rows", "width", "depth", "margin"])


def scene_plan(matrix: DataFrame, seed: int = 42, area: int = 1280 * 720) -> tuple[DataFrame, DataFrame]:
    """(plants, scenes): jittered grid positions, and per scene its extent, resolution and fields of view.

    A scene without plants is 2.5 x 5 metres, and so is one with a null in its
    key. Its extent comes from its own few plants, in its row: nothing is grouped
    or joined. Draws of many scenes are hashed at once in numpy.
    """
    key = ["genotype_id", "dap", "scene"]
    salt = [F.col(k) for k in key]
    traits = [F.col(f"{t}_{e}").cast("double") for t in ("plant_count", "plant_spacing_x", "plant_spacing_y") for e in ("min", "max")]
    draw = F.arrow_udf(_drawn_plan, "n_plants long, n_rows int, width double, depth double, margin double")
    rows = matrix.withColumn("_drawn", draw(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in salt]), *traits))
    rows = rows.withColumns({"n_plants": F.col("_drawn.n_plants").cast("int"), "n_rows": F.col("_drawn.n_rows"), "camera_height": 1.0 + uniform(seed, F.col("genotype_id"), "camera") * 9.0})
    rows = rows.withColumn("n_cols", F.greatest(F.lit(1), F.ceil(F.col("n_plants") / F.col("n_rows"))).cast("int"))
    plants = rows.where("n_plants > 0").withColumn("plant", F.explode(F.sequence(F.lit(0), F.col("n_plants") - 1)))
    step = lambda axis: F.col(f"plant_spacing_{axis}_min") + uniform(seed, *salt, F.col("plant"), axis) * (F.col(f"plant_spacing_{axis}_max") - F.col(f"plant_spacing_{axis}_min"))
    x = step("x") * (F.col("plant") % F.col("n_cols") - (F.col("n_cols") - 1) / 2)
    y = step("y") * (F.floor(F.col("plant") / F.col("n_cols")) - (F.col("n_rows") - 1) / 2)
    plants = plants.select(*key, "plant", x.alias("x"), y.alias("y"))
    some = F.col("genotype_id").isNotNull() & F.col("dap").isNotNull() & F.col("scene").isNotNull()
    margin = 0.5 + F.col("_drawn.margin") * 1.5
    scenes = rows.withColumns({"plot_size_x": F.coalesce(F.when(some, F.col("_drawn.width")) + margin, F.lit(2.5)), "plot_size_y": F.coalesce(F.when(some, F.col("_drawn.depth")) + margin, F.lit(5.0))}).drop("_drawn")
    first = F.rint(F.sqrt(area * F.col("plot_size_x") / F.col("plot_size_y")))
    scenes = scenes.withColumn("resolution_y", F.rint(F.col("plot_size_y") / F.col("plot_size_x") * first).cast("int"))
    scenes = scenes.withColumn("resolution_x", F.rint(F.col("resolution_y") * F.col("plot_size_x") / F.col("plot_size_y")).cast("int"))
    return plants, geo.camera_plan(scenes)


#: Keys of a scene document that a template may leave out.
SCENE_DEFAULTS = {"plot_size_z": 0.2, "azimuth_angle": 0.0, "focusing_plants": False, "mode": "manual"}


def plots_to_scenes(plants: DataFrame, plots: DataFrame, template: str = "{}", plant_type: str | None = None, year: int = 2025, camera_height: float = 1.2, buffer: float = 1.0, ground: Column | None = None) -> DataFrame:
    """Scene document (JSON text) of each plot from its detected plants (raster_id, x_m, y_m, z) and layout (raster_id, width_m, height_m, dap).

    `template` is a scene document (JSON text): its other keys stay, and those
    that the plot decides are set, down to single keys of sections that the
    template has, on the driver: rows only fill in values. `ground` is the path of a plot's ground mesh, null where there
    is none. Plants of a plot are one array, which its document needs; plots are
    apart, so no array grows with their number.
    """
    spots = F.array_sort(F.collect_list(F.struct(F.bround("x_m", 4).alias("x"), F.bround("y_m", 4).alias("y"), F.coalesce("z", F.lit(0.0)).alias("z"))))
    own = plants.groupBy("raster_id").agg(spots.alias("plants"))
    dap = F.col("dap") if "dap" in plots.columns else F.lit(None).cast("int")
    out = geo.scene_size(plots.withColumn("_dap", dap).join(own, "raster_id", "left"), F.col("width_m"), F.col("height_m"), buffer)
    path = F.lit(None).cast("string") if ground is None else ground
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    plot = F.struct(F.lit(1).alias("bed"), F.lit(1).alias("row"), F.coalesce("plants", none).alias("plants"))
    given = json.loads(template)
    text = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    # what stands between {"v": and }
    value = lambda c: F.substring(text(c), F.lit(6), F.length(text(c)) - 6)

    def section(at: str) -> dict:
        found = given
        for name in at.split("."):
            found = found.get(name) if isinstance(found, dict) else None
        return found if isinstance(found, dict) else {}

    fixed = lambda v: F.lit(json.dumps(v))
    default = lambda at, name: fixed(section(at).get(name, SCENE_DEFAULTS[name]))
    values = {
        "metadata": {"plant_type": None if plant_type is None else fixed(plant_type), "year": fixed(year), "dap": value(F.col("_dap"))},
        "field.layout": {"mode": fixed(SCENE_DEFAULTS["mode"]), "plot_size_x": value(F.col("size_x")), "plot_size_y": value(F.col("size_y")), "plot_size_z": default("field.layout", "plot_size_z"), "num_rows": fixed(1), "num_beds": fixed(1)},
        "field": {"plots": value(F.array(plot))},
        "environment.soil": {"rotate_obj": value(F.col("heading")), "use_obj_ground": F.when(path.isNotNull(), fixed(True)), "obj_file_path": F.when(path.isNotNull(), value(path))},
        "camera.positioning": {"camera_height": value(F.bround(F.lit(camera_height), 4)), "azimuth_angle": fixed(SCENE_DEFAULTS["azimuth_angle"]), "focusing_plants": fixed(SCENE_DEFAULTS["focusing_plants"])},
        "camera.sensor": {"resolution_x": value(F.col("image_width")), "resolution_y": value(F.col("image_height"))},
    }

    def merged(base: dict, at: str, extra: dict[str, Column]) -> Column:
        """The template's object with the plot's keys, and with `extra` sections, as JSON text; its own value stays where the plot has none."""
        sets = {k: v for k, v in values.get(at, {}).items() if v is not None} | extra
        pair = lambda k, v: F.concat(F.lit(json.dumps(k) + ":"), v)
        kept = {k: pair(k, fixed(v)) for k, v in base.items()}
        pairs = [F.coalesce(pair(k, v), kept[k]) if k in kept else pair(k, v) for k, v in sets.items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *[v for k, v in kept.items() if k not in sets], *pairs), F.lit("}"))

    part = lambda at, **extra: merged(section(at), at, extra)
    sections = {"metadata": part("metadata"), "field": part("field", layout=part("field.layout")), "environment": part("environment", soil=part("environment.soil")), "camera": part("camera", positioning=part("camera.positioning"), sensor=part("camera.sensor"))}
    return out.select("raster_id", merged(given, "", sections).alias("document"))
