"""Column expressions over artefact names, dates and nested parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Artefact kinds that end a file name.
KINDS = ("depth", "temperature", "masks", "boxes", "params", "rad", "vis", "xml", "sem", "labels")
_NAME = r"^dap_(\d+)_plot_(\d+)_(\d+)(?:_(\d+))?(?:_(?!(?:{k})\.)(.*?))?(?:_({k}))?\.([A-Za-z0-9]+)$".format(k="|".join(KINDS))
# Fixed value: the word that starts the name of a rover image.
ROVER_WORD = "AgRowStitch"
_DATE = r"(\d{4}-\d{2}-\d{2})"


def artifact_parts(name: Column) -> dict[str, Column]:
    """dap, bed, row, idx, method, kind and ext of `dap_D_plot_BED_ROW_IDX[_method][_kind].ext`; null where absent."""
    part = lambda i: F.nullif(F.regexp_extract(name, _NAME, i), F.lit(""))
    numbers = {n: part(i).cast("int") for i, n in enumerate(("dap", "bed", "row", "idx"), 1)}
    return numbers | {n: part(i) for i, n in enumerate(("method", "kind", "ext"), 5)}


def rover_parts(name: Column, extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".tif", ".tiff")) -> dict[str, Column]:
    """plot and idx of a rover image's name.

    From the word on, and up to the next dot, a name is fields between hyphens
    or underscores: the word, `plot` (perhaps with the plot's name right after
    it, else that is the next field), and a field that may begin with a number.
    Null when these fields aren't there or the extension isn't listed.
    """
    extension = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    start = F.locate(ROVER_WORD.lower(), F.lower(name))
    fields = F.split(F.translate(F.substring_index(F.substring(name, start, F.length(name)), ".", 1), "_", "-"), "-")
    field = lambda i: F.coalesce(F.get(fields, F.lit(i)), F.lit(""))
    second = F.lower(field(1))
    named = (start > 0) & extension.isin(*extensions) & (F.lower(field(0)) == ROVER_WORD.lower()) & second.startswith("plot")
    joined = second != "plot"
    plot = F.when(joined, F.substring(field(1), 5, F.length(field(1)))).otherwise(field(2))
    number = F.regexp_extract(F.when(joined, field(2)).otherwise(field(3)), "^[0-9]*", 0)
    some = named & (plot != "")
    return {"plot": F.when(some, plot), "idx": F.when(some, F.nullif(number, F.lit(""))).cast("int")}


def dap_from_name(name: Column, planted: Column, fallback: Column) -> Column:
    """Days from planting to the date in a name, or `fallback` without a date."""
    found = F.try_to_date(F.nullif(F.regexp_extract(name, _DATE, 1), F.lit("")))
    return F.coalesce(F.datediff(found, planted), fallback)


def natural_order(stem: Column) -> list[Column]:
    """Sort keys that put numeric stems first, by value, and other stems after them."""
    number = stem.try_cast("long")
    return [number.isNull(), number, stem]


_CASTS = {"double": ("DOUBLE", "DECIMAL", "BIGINT", "FLOAT"), "bigint": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN", "BIGINT")}


def json_or(doc: Column, path: str, kind: str, default) -> Column:
    """The value at `path` of a variant, or `default` where it is missing, null or of another type.

    A boolean may be given as an integer, true when it isn't 0.
    """
    node = F.try_variant_get(doc, path, "variant")
    kinds = F.regexp_extract(F.schema_of_variant(node), r"^([A-Z]+)", 1)
    value = F.try_variant_get(doc, path, kind)
    if kind == "boolean":
        value = F.when(kinds == "BIGINT", F.try_variant_get(doc, path, "bigint") != 0).otherwise(value)
    return F.coalesce(F.when(kinds.isin(*_CASTS[kind]), value), F.lit(default).cast(kind))


def fallback_chain(doc: Column, paths: list[str], kind: str, default) -> Column:
    """The first of `paths` that holds a value of the type, or `default`."""
    return F.coalesce(*[json_or(doc, p, kind, None) for p in paths], F.lit(default).cast(kind))
