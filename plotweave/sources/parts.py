"""JSON documents in parts: text lines that a list's items fill one by one, so that no row, task or array holds a document.

The files of a document, in the order of their names, are its text. Its first
line opens it up to the list, each item is a line (after a comma, or a blank for
the first), and the last line closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.plans.staging import staged


def json_text(value: Column) -> Column:
    """JSON text of a value: what stands between {"v": and } of an object around it."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def object_pairs(base: Column, sets: dict[str, Column]) -> Column:
    """The pairs of a variant object as JSON text, with `sets` (names to JSON texts) in place of its own; a null text leaves its name out.

    What is no object counts as an empty one.
    """
    own = F.coalesce(F.map_entries(F.try_variant_get(base, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    pair = lambda name, text: F.concat(json_text(name), F.lit(":"), text)
    kept = F.transform(F.filter(own, lambda e: ~e["key"].isin(*sets)) if sets else own, lambda e: pair(e["key"], F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.array_join(F.concat(kept, F.array_compact(F.array(*[pair(F.lit(k), v) for k, v in sets.items()])) if sets else F.array().cast("array<string>")), ",")


def object_text(base: Column, sets: dict[str, Column]) -> Column:
    return F.concat(F.lit("{"), object_pairs(base, sets), F.lit("}"))


def write_document_parts(heads: DataFrame, items: DataFrame, keys: list[str], order: list[str], path: str, end: str = "]}") -> None:
    """Write the documents of `heads` (keys, value: the text up to the list) with their `items` (keys, order, value) in directories by `keys`.

    Rows are dealt and sorted by ranges of key and order, so a document with
    most of all items is spread over tasks and files. Items of unknown documents
    are left out.
    """
    rows = staged(items.select(*keys, *order, "value").withColumn("_line", F.monotonically_increasing_id()), "document-items")
    place = F.struct(*order, "_line")
    first = rows.groupBy(*keys).agg(F.min(place).alias("_first"))
    known = rows.join(heads.select(*keys), keys, "left_semi").join(first, keys)
    lines = known.select(*keys, F.lit(1).alias("_part"), *order, "_line", F.concat(F.when(place == F.col("_first"), " ").otherwise(","), "value").alias("value"))
    border = lambda part, text: heads.select(*keys, F.lit(part).alias("_part"), *[F.lit(None).cast(lines.schema[o].dataType).alias(o) for o in order], F.lit(0).cast("long").alias("_line"), text.alias("value"))
    whole = border(0, F.col("value")).unionByName(lines).unionByName(border(2, F.lit(end)))
    dealt = [*keys, "_part", *order, "_line"]
    whole.repartitionByRange(*dealt).sortWithinPartitions(*dealt).select(*keys, "value").write.partitionBy(*keys).text(path)


def read_document_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(heads, items) of such a folder, with the columns of the directories: opening lines, and each item's JSON text."""
    lines = spark.read.text(path)
    sign = F.substring("value", 1, 1)
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(sign == "{"), lines.where(sign.isin(" ", ",")).select(*rest, F.substring("value", F.lit(2), F.length("value")).alias("value"))
