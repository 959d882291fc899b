"""Numbering, ordering and top-k without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.plans.staging import staged


def numbered(rows: DataFrame, group: list[str], within: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of `group`, then `within`.

    Rows are dealt and sorted by ranges of that order, so a group with many rows
    is spread too; a row is written with its range and its place in it, and the
    counts of the ranges before are added. The only unpartitioned window is over
    one row per range.
    """
    order = [*group, *within]
    # range and place in one number: 33 bits are for the place
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return dealt.withColumn("_part", part).join(F.broadcast(bases), "_part").select(*[F.col(c) for c in rows.columns if c != name], (F.col("_base") + place + start).cast("long").alias(name))


def global_annotation_ids(annotations: DataFrame, in_file: list[str]) -> DataFrame:
    """Ids from 0 in bed-major, tier-minor, in-file order."""
    return numbered(annotations, ["bed", "tier"], in_file, "annotation_id")


def global_plant_ids(plants: DataFrame, in_plot: list[str]) -> DataFrame:
    """Ids from 1 across plots."""
    return numbered(plants, ["bed", "tier"], in_plot, "plant_id", start=1)


def organ_instance_ids(objects: DataFrame, plant: list[str], within: list[str], organ: str = "organ") -> DataFrame:
    """Instance numbers from 0 per organ class over plants in order: numbers over all classes less the first of the class."""
    whole = staged(numbered(objects, [organ, *plant], within, "_whole"), "instances")
    # one row per class
    first = whole.groupBy(F.col(organ).alias("_organ")).agg(F.min("_whole").alias("_first"))
    return whole.join(first, F.col(organ).eqNullSafe(F.col("_organ"))).withColumn("instance_id", F.col("_whole") - F.col("_first")).drop("_whole", "_first", "_organ")


def grid_index(bed: Column, tier: Column, ncols: int = 40) -> Column:
    """Row-major index of a plot."""
    return (tier - 1) * ncols + bed - 1


def grid_place(index: Column, ncols: int = 40) -> tuple[Column, Column]:
    """(bed, tier) of a row-major index."""
    return F.pmod(index, F.lit(ncols)) + 1, F.floor(index / ncols).cast("long") + 1


def sorted_merge(plots: DataFrame, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """The plots of each field (`by`; none: of one field) as an array ordered by (bed, tier); no array is larger than a field."""
    return plots.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct("bed", "tier", *payload))).alias("plots"))


def sample_plots(plots: DataFrame, keys: list[str], n: int = 6, seed: int = 42) -> DataFrame:
    """`n` rows by the md5 of seed and keys: a top-k, the same in every run and in other engines."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return plots.orderBy(order, *keys).limit(n)


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def unique_plots(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.select(*cols).distinct().orderBy(*cols)


def growth_series(observations: DataFrame, by: list[str], value: str, order: str = "dap") -> DataFrame:
    """Values per plot by day, with the change and the days since the observation before."""
    w = Window.partitionBy(*by).orderBy(order)
    return observations.withColumns({"change": F.col(value) - F.lag(value).over(w), "days": F.col(order) - F.lag(order).over(w)})
