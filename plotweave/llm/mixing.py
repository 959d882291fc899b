"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash. Taking the rows whose hash lies under a threshold gives a
subset whose word count is near any wanted budget, and a larger budget's subset
holds a smaller one's (but for the last few short rows, see `thresholds`). The threshold is found from histograms: words by source
and hash bucket are summed, the bucket in which the budget ends is found by a
running sum over buckets, and only that bucket is split again. Nothing is sorted.

Defined results: null texts have size 0; null sources are one source, last in
order; rows with equal id and text share a hash and are taken together; a table
without words has targets of 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, staged, text_of, word_count

#: Bits of the hash that one histogram level resolves, and the levels. Two levels tell 2**32 rows apart.
LEVEL_BITS = 16
LEVELS = 2


def slot_of(id_col: str, text_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)), F.lit(1 << (LEVEL_BITS * LEVELS)))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source, size, slot: what mixing needs of a row, without its text; staged."""
    own = columns(docs, id_col, text_col, source_col)
    return staged(own.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), slot_of(id_col, text_col, seed).alias("slot")), "mix-sizes")


def cyclic_weights(totals: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """source → weight: the sources by code point, null last, weigh `weights` in turn. One row per source name passes one task."""
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    return totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int")))


def fill(totals: DataFrame, cap: float) -> DataFrame:
    """Add `target`: all words shared by weight, none above `cap` times its source's, the excess reshared.

    Each round is one aggregate over one row per source; only two sums reach the driver.
    """
    level, low = None, -1.0
    room = F.col("source_size") * cap
    while level is None or level > low:
        low = -1.0 if level is None else level
        full = (room <= F.col("weight") * low) | (F.col("weight") <= 0)
        all_words, used, weight = totals.agg(F.sum("source_size"), F.sum(F.when(full, F.when(F.col("weight") > 0, room).otherwise(0.0)).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            level = low if low > 0 else 0.0
            break
        level = max(low, (all_words - used) / weight)
    return totals.withColumn("target", F.when(F.col("weight") > 0, F.least(room.cast("double"), F.col("weight") * F.lit(float(level)))).otherwise(0.0))


def _end(rows: DataFrame, need: DataFrame, nearest: bool) -> DataFrame:
    """Replace `need` by what is left of it and add `under`, the slot under which rows fill it.

    `need` has one row per source. The running sums are over at most
    2**LEVEL_BITS buckets of a source. Rows that share the last boundary's slot
    are taken only with `nearest`, when that comes nearer.
    """
    need = need.withColumn("under", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = _of_source(rows, need.select("source", "under")).where(F.shiftright("slot", shift + LEVEL_BITS) == F.col("under"))
        hist = inside.groupBy("source", F.shiftright("slot", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        cut = _of_source(hist, need.select("source", "need")).where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("cut"))
        before = F.col("cut.upto") - F.col("cut.words")
        more = F.lit(nearest and level == LEVELS - 1) & ((F.col("cut.upto") - F.col("need")) < (F.col("need") - before))
        spent = F.when(more, F.col("cut.upto")).otherwise(before)
        # without a cut the rows' words end below the need: all of them are taken
        everything = F.lit(1 << LEVEL_BITS) if level == 0 else (F.col("under") + 1) * (1 << LEVEL_BITS)
        under = F.coalesce(F.col("cut.bucket") + more.cast("long"), everything)
        joined = _of_source(need, cut, "left")
        need = staged(joined.select(*[c for c in need.columns if c not in ("need", "under")], (F.col("need") - F.coalesce(spent, F.lit(0))).alias("need"), under.cast("long").alias("under")), "mix-need")
    return need


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repeats; `under`, the slot under which rows are taken once more; `left` and `small_under`.

    A long row at the boundary can leave a gap. A second search, of the same
    kind, fills it from the rows above `under` that have at most `left` words:
    those below `small_under` are taken too.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    need = targets.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    first = _end(rows, staged(need, "mix-need"), nearest=False).withColumnRenamed("need", "left")
    over = _of_source(rows, first.select("source", "left", "under")).where((F.col("slot") >= F.col("under")) & (F.col("size") <= F.col("left"))).select("source", "size", "slot")
    second = _end(staged(over, "mix-over"), first.withColumnRenamed("under", "first_under").withColumn("need", F.col("left")), nearest=True)
    return second.withColumnRenamed("under", "small_under").withColumnRenamed("first_under", "under")


def _of_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source with null equal to null. Both sides shuffle by it, so AQE can split a hot source; Spark broadcasts one row per source below its own threshold."""
    right = per_source.withColumnRenamed("source", "_pw_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("_pw_source")), how).drop("_pw_source")


def _repeats(cap: float) -> Column:
    small = (F.col("size") <= F.col("left")) & (F.col("slot") < F.col("small_under"))
    once_more = F.when((F.col("slot") < F.col("under")) | small, 1).otherwise(0)
    return (F.col("whole") + F.when(F.col("whole") < int(cap), once_more).otherwise(0)).cast("int")


def _plan(rows: DataFrame, weights, cap: float) -> DataFrame:
    totals = staged(weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-totals")
    return thresholds(rows, fill(totals, cap)).select("source", "source_size", "target", "whole", "under", "left", "small_under")


def mix(docs: DataFrame, weights=cyclic_weights, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, repeats, taken.

    `weights` maps the frame (source, source_size) to one with a column weight.
    A row is repeated floor(target / source_size) times, and once more when its
    hash lies under its source's threshold; never more than int(cap) times.
    """
    rows = measured(docs, id_col, text_col, source_col, seed)
    out = _of_source(rows, _plan(rows, weights, cap)).withColumn("repeats", _repeats(cap))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def take(docs: DataFrame, weights=cyclic_weights, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of `docs`, all columns, that the mix takes, each as often as it takes it.

    Whether a row is taken depends on its hash, size and source's thresholds
    alone, so texts are filtered where they are read.
    """
    plan = _plan(measured(docs, id_col, text_col, source_col, seed), weights, cap)
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_pw_row"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), slot_of(id_col, text_col, seed).alias("slot"))
    rows = _of_source(own, plan).withColumn("_pw_copy", F.explode(F.array_repeat(F.lit(0), _repeats(cap))))
    return rows.select(*[F.col("_pw_row")[c].alias(c) for c in docs.columns])
