"""Helpers that several corpus operators share: text measures, batch limits and a bounded membership filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.plans.staging import remove, scratch, shared_dir, staged  # noqa: F401  for the operators

#: White space in all contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the membership bitmap: 4 MB in 1024 rows of 4 KB, whatever the number of keys.
BITMAP_BITS = 1 << 25
_CHUNK = 32768


def text_of(col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def squeezed(col: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(col, SPACE + "+", "")


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Limit the bytes of an Arrow batch that goes to a Python worker, unless the session has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, size)


def _slot(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(bits))
    return F.floor(at / _CHUNK).cast("int"), F.pmod(at, F.lit(_CHUNK))


def with_member_flag(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Add boolean `flag`: false only for rows whose key surely isn't among `keys`.

    The keys become a bitmap of `bits` bits, built by partial aggregation and
    broadcast; its size is fixed, so the broadcast never grows. With many keys
    more rows are flagged without need, and the caller's exact step sees more
    rows; no result depends on it.
    """
    chunk, bit = _slot(keys_key, bits)
    maps = keys.select(chunk.alias("_pw_chunk"), bit.alias("_pw_bit")).groupBy("_pw_chunk").agg(F.bitmap_construct_agg("_pw_bit").alias("_pw_map"))
    chunk, bit = _slot(key, bits)
    own = df.withColumns({"_pw_chunk": chunk, "_pw_bit": bit})
    byte = F.expr("cast(conv(hex(substring(_pw_map, cast(_pw_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    test = F.expr("pmod(_pw_bit, 8)").cast("int")
    hit = F.col("_pw_map").isNotNull() & (F.call_function("shiftright", byte, test).bitwiseAND(1) == 1)
    return own.join(F.broadcast(maps), "_pw_chunk", "left").select(*[own[c] for c in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that with the id name a row's text."""
    return F.xxhash64(text), F.xxhash64(F.lit(77), text)


def _hashable(kind) -> bool:
    """Spark hashes every type but maps and variants, wherever they are nested."""
    return not any(x in kind.simpleString() for x in ("map<", "variant"))


def keep_rows(docs: DataFrame, gone: DataFrame, once: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those named in `gone`, and with one row of each named in `once`.

    Both are (id, ta, tb): an id, null included, and the `text_key` of a text, so
    one row's fate doesn't depend on other texts under its id. Rows that surely
    stay pass straight through; only rows that the bitmap flags move, so kept
    texts are not shuffled. Of rows equal in id and text the least by a hash of
    all columns stays; they are aggregated before the shuffle.
    """
    text = text_of(text_col)
    ta, tb = text_key(text)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_pw_row")
    own = docs.select(row, F.col(id_col).alias("_pw_id"), ta.alias("_pw_ta"), tb.alias("_pw_tb"))
    marks = gone.select("id", "ta", "tb", F.lit(False).alias("stays")).unionByName(once.select("id", "ta", "tb", F.lit(True).alias("stays"))).distinct()
    marks = staged(marks, "row-marks")
    flagged = with_member_flag(own, F.xxhash64("_pw_id", "_pw_ta", "_pw_tb"), marks, F.xxhash64("id", "ta", "tb"), "_pw_doubt")
    same = F.col("_pw_id").eqNullSafe(F.col("id")) & (F.col("_pw_ta") == F.col("ta")) & (F.col("_pw_tb") == F.col("tb"))
    spread = lambda rows: rows.select(*[F.col("_pw_row")[c].alias(c) for c in docs.columns])
    clear = spread(flagged.where(~F.col("_pw_doubt")))
    if not marks.where("stays").limit(1).count():
        return clear.unionByName(spread(flagged.where("_pw_doubt").join(marks, same, "left_anti")))
    doubt = flagged.where("_pw_doubt").join(marks, same, "left").where("stays is null or stays")
    order = F.xxhash64(*[F.col("_pw_row")[f.name] for f in docs.schema if _hashable(f.dataType)])
    single = doubt.where("stays").groupBy("_pw_id", "_pw_ta", "_pw_tb").agg(F.min_by("_pw_row", order).alias("_pw_row"))
    return clear.unionByName(spread(doubt.where("stays is null"))).unionByName(spread(single))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with any names can't clash with the operator's own."""
    return df.select(*[F.col(n) for n in names])
