"""Weighted rendezvous hashing of record keys over shards, and gapless slots within a shard.

A record goes to the shard with the highest -weight / ln(u), u in (0, 1) being a
hash of the key and the shard's name. A new shard can only win records; no
record moves between old shards.

Defined results: a null key is a key like others; rows of one key go to one
shard; a null text has no bytes; an empty table gives an empty result; other
columns are ignored unless asked for with `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of hash space, over all shards, within which rows are numbered; a shard's slots are never counted in one task.
SLICES = 1 << 16


def winner(key: Column, weights: list[float], among: int | None = None) -> Column:
    """Index of the shard that wins `key` among the first `among` of `weights`."""
    named = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights[:among])])

    def bid(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-s["weight"] / F.ln(u)).alias("bid"), s["shard"].alias("shard"))

    return F.array_max(F.transform(named, bid))["shard"]


def assign_shards(docs: DataFrame, weights: list[float], key_col: str = "doc_id", grown: list[float] | None = None, slices: int | None = None, keep: tuple[str, ...] = (), **measures: Column) -> DataFrame:
    """Per row: key, the columns of `keep`, `measures`, shard, slot and (with `grown`, weights of the enlarged set) grown_shard.

    Slots run from 0 in each shard, by slices of a hash of key and measures, so
    rows of one key are spread by what is measured of them: rows are numbered
    within a slice, and the counts of the slices before are added.
    """
    key, slices = F.col(key_col), slices or max(16, SLICES // len(weights))
    rows = docs.select(key.alias("key"), F.xxhash64(key, F.lit("slot"), *measures.values()).alias("spot"), *[F.col(c) for c in keep], *[m.alias(n) for n, m in measures.items()], winner(key, weights).alias("shard"), (winner(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    rows = rows.withColumn("slice", F.pmod("spot", F.lit(slices)).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "slice", before.alias("base"))
    order = ["spot", "key", *measures]
    at = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(*order)) - 1
    # at most shards x slices rows of 16 bytes: a fixed bound
    out = rows.withColumn("at", at).join(F.broadcast(starts), ["shard", "slice"])
    return out.select(F.col("key").alias(key_col), *keep, *measures, "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), "grown_shard")
