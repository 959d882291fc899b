"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Each level reads more of a text, and only of texts whose group at the level
before had more than one member. What a level hands on is a bitmap of fixed
size (see `with_member_flag`), so no level shuffles texts.

Defined results: a null text counts as empty and equals every text of white
space only; a null id sorts last; of rows equal in id and text one stays,
whatever else they hold; other rows of the same id, null included, are decided
by their own text; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, keep_rows, squeezed, staged, text_key, text_of, with_member_flag

#: Characters of the normalised text that the second level hashes.
PREFIX = 64


def _keys(docs: DataFrame, id_col: str, text_col: str, digest: bool, prefix: int) -> DataFrame:
    """id, points, ta, tb, part and sha of each row, sha null where no other text can be equal; staged."""
    text = text_of(text_col)
    ta, tb = text_key(text)
    own = columns(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.length(text).alias("points"), squeezed(text).alias("norm"), ta.alias("ta"), tb.alias("tb"))
    own = own.withColumn("size", F.length("norm"))

    sizes = own.groupBy("size").count().where("count > 1")
    by_size = with_member_flag(own, F.xxhash64("size"), sizes, F.xxhash64("size"), "same_size")

    def head(df: DataFrame) -> DataFrame:
        return df.withColumn("head", F.when(F.col("same_size"), F.xxhash64("size", F.substring("norm", 1, prefix))))

    heads = head(by_size).where("same_size").groupBy("head").count().where("count > 1")
    by_head = with_member_flag(head(by_size), F.coalesce("head", F.lit(0)), heads, F.col("head"), "same_head")
    full = F.sha2("norm", 256)
    alive = F.col("same_size") & F.col("same_head")
    keys = by_head.select("id", "points", "ta", "tb", F.spark_partition_id().alias("part"), F.when(alive, full).alias("sha"), *([full.alias("text_sha256")] if digest else []))
    return staged(keys, "exact-keys")


def _graded(keys: DataFrame) -> DataFrame:
    """Rows of equal (sha, id, text) read by one task, counted as n, with group_size, best and wins (they hold the row that stays)."""
    cell = ["sha", "points", "id", "ta", "tb", "part"]
    cells = keys.where("sha is not null").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), *cell[2:])
    groups = cells.groupBy("sha").agg(F.sum("n").alias("group_size"), F.min(order).alias("best"))
    return cells.join(groups, "sha").withColumn("wins", order.eqNullSafe(F.col("best")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, prefix: int = PREFIX) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept (and text_sha256 with `digest`).

    Texts are equal when they are identical without white space. Of equal texts
    the row with most code points in its original text stays, then the smallest
    id. `digest` also hashes the texts that need no comparison.
    """
    keys = _keys(docs, id_col, text_col, digest, prefix)
    more = ["text_sha256"] if digest else []
    # equal rows are counted by the task that read them, so that none of their copies meet in one
    rows = _graded(keys).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    paired = rows.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), *[F.col("sha").alias(c) for c in more])
    alone = keys.where("sha is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    return alone.unionByName(paired).withColumnRenamed("id", id_col)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with one row of each group of equal texts."""
    graded = _graded(_keys(docs, id_col, text_col, False, PREFIX))
    row = ["id", "ta", "tb"]
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("ta") == F.col("best.ta")) & (F.col("tb") == F.col("best.tb"))
    marks = graded.groupBy(*row).agg(F.max(stays).alias("stays"), F.sum("n").alias("n"))
    marks = staged(marks.where("not stays or n > 1"), "exact-drop")
    return keep_rows(docs, marks.where("not stays").select(*row), marks.where("stays").select(*row), id_col, text_col)
