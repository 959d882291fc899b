"""Importance resampling towards a target distribution over hashed word n-grams.

1. Features are counted by bucket in both tables: each task adds up an array of
   `BUCKETS` counters over its Arrow batches and sends out one row per bucket.
2. A bucket's gain is the scaled log ratio of its smoothed shares; the array of
   gains (fixed size) goes to the tasks, which sum it over each text's features.
3. A fixed uniform number per id makes the weights scores (Gumbel noise), so
   that the highest scores are a sample without replacement.
4. A quantile sketch of the scores gives a bracket around the cutoff. Exact
   counts above and inside validate it, or the next wider one is tried; the
   widest holds all rows. Only the bracket is sorted to find the last row drawn.

Words are hashed straight from the bytes of a batch: crc32 is linear, so the
checksum of an n-gram follows from the checksums of its words by one table
look-up per byte of the register, whatever the words' length.

Defined results: a null or empty text has no words, no features and weight 0;
null ids draw noise as the empty string and come first among equal scores;
repeated rows are rows of their own, with equal scores, and ranks follow one
another among them; an empty table gives an empty table, an empty target leaves
its counts at zero. Other columns are ignored but for those asked for by `keep`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.numbering import numbered

from .common import bounded_batches, columns, staged, text_of

BUCKETS = 10_000
#: Bytes of text that are hashed at a time; a longer text is a slice of its own.
SLICE = 2 << 20
#: Half widths of the brackets that are tried in turn, as shares of the rows.
BRACKETS = (0.002, 0.01, 0.05)
_SKETCH = 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters and all of characters beyond ASCII.
_IN_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def _byte_table() -> np.ndarray:
    """crc32 of one byte after an empty register (the reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()
#: Words up to this length have tables of their own; longer ones are shifted by powers of two.
_SHORT = 64


def _shifted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables (register byte, value) that move a register on by n zero bytes: for n up to `_SHORT`, and for powers of two."""
    own = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = [own]
    for _ in range(_SHORT):
        short.append(_BYTE[short[-1] & 255] ^ (short[-1] >> 8))
    powers = [short[1]]
    for _ in range(31):
        powers.append(_shifted(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


_SHIFT, _POWER = _shift_tables()


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What each checksum adds to the checksum of its bytes followed by `by` others."""
    n = np.minimum(by, _SHORT)
    out = _SHIFT[n, 0, crc & 255] ^ _SHIFT[n, 1, (crc >> 8) & 255] ^ _SHIFT[n, 2, (crc >> 16) & 255] ^ _SHIFT[n, 3, crc >> 24]
    rest = by - n
    for k in range(int(rest.max(initial=0)).bit_length()):
        at = np.flatnonzero((rest >> k) & 1)
        out[at] = _shifted(out[at], _POWER[k])
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums after one more blank."""
    x = ~crc
    return ~(_BYTE[(x ^ np.uint32(32)) & 255] ^ (x >> 8))


def _word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each word: all words byte by byte together, long ones by themselves."""
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    long = int((sizes > _SHORT).sum())
    out = np.zeros(len(starts), dtype=np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    order = order[long:]
    register, at, left = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32), starts[order], sizes[order]
    # sizes fall, so words that go on are the first ones
    going = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for j, n in enumerate(going):
        register[:n] = _BYTE[(register[:n] ^ data[at[:n] + j]) & 255] ^ (register[:n] >> 8)
    out[order] = ~register
    return out


def _grams(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; and for runs of 1, 2 and 3 words the buckets of all texts' runs with the offset of each text's first."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    inner = _IN_WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    starts = np.flatnonzero(inner & (np.append(True, ~inner[:-1])[: len(data)] | cut[:-1]))
    ends = np.flatnonzero(inner & (np.append(~inner[1:], True)[: len(data)] | cut[1:])) + 1
    sizes = ends - starts
    offsets = np.searchsorted(starts, bounds)
    words = np.diff(offsets)
    first = _word_crcs(data, starts, sizes)
    # words of their text that stand before each word
    place = np.arange(len(starts)) - np.repeat(offsets[:-1], words)
    out, crc, at = [(first % BUCKETS, offsets)], first, np.arange(len(starts))
    for n in (2, 3):
        # `crc` is of the run of n - 1 words that ends at each word of `at`
        ends = at[place[at] >= n - 1]
        before = crc[np.searchsorted(at, ends - 1)] if n > 2 else first[ends - 1]
        crc = _moved(_spaced(before), sizes[ends]) ^ first[ends]
        at = ends
        out.append((crc % BUCKETS, np.searchsorted(at, offsets)))
    return words, out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some SLICE bytes of text each; one longer text makes a range of its own."""
    upto, start = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while start < len(texts):
        end = min(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE)) + 1, len(texts))
        yield start, end
        start = end


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: an array of `BUCKETS` whole numbers, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            own = batch.column(0).cast(pa.string())
            for a, b in _slices(own):
                for buckets, _ in _grams(own.slice(a, b - a))[1]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    bounded_batches(texts.sparkSession, "8m")
    sums = texts.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in sums.collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) of each bucket."""
    many_s, many_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * many_s / ((s + 1.0) * many_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`keep`, n_words, n_features and weight, the sum of gains over the text's features."""
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.string())
            for a, b in _slices(texts):
                words, grams = _grams(texts.slice(a, b - a))
                features = sum(np.diff(at) for _, at in grams)
                weight = sum(np.diff(np.append(0, np.cumsum(gain[buckets]))[at]) for buckets, at in grams)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in (words, features, weight)], names=[*keep, "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession, "8m")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long", "n_features long", "weight long"])
    return columns(docs, *keep, text_col).select(*keep, text_of(text_col).alias("_pw_text")).mapInArrow(run, schema)


def noise(key: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def _bracket(rows: DataFrame, score: str, count: int, draw: int) -> tuple[int, int, int]:
    """Scores lo <= hi with fewer than `draw` rows above hi and at least as many from lo on; and the rows above."""
    middle = 1 - draw / count
    steps = [p for d in BRACKETS for p in (max(0.0, middle - d), min(1.0, middle + d))]
    found = rows.agg(F.percentile_approx(score, F.array(*[F.lit(p) for p in steps]), F.lit(_SKETCH)).alias("q"), F.min(score).alias("a"), F.max(score).alias("b")).first()
    for lo, hi in [*zip(found["q"][::2], found["q"][1::2], strict=True), (found["a"], found["b"])]:
        above, upto = rows.agg(F.count_if(F.col(score) > hi), F.count_if(F.col(score) >= lo)).first()
        if above < draw <= upto:
            return lo, hi, above
    raise AssertionError("the whole range holds every row")


def draw_top(scored: DataFrame, eligible: Column, percent: int = 5, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """`scored` with rank: 1, 2, 3... for floor(percent % of the eligible rows) with the highest scores (ties: smaller id), null for others."""
    rows = staged(scored.withColumns({"_eligible": F.coalesce(eligible, F.lit(False)), "_row": F.monotonically_increasing_id(), "_fall": -F.col(score)}), "scored")
    pool = rows.where("_eligible")
    count = pool.count()
    draw = percent * count // 100
    names = scored.columns
    if not draw:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    lo, hi, above = _bracket(pool, score, count, draw)
    order = ["_fall", id_col, "_row"]
    # the bracket alone is sorted to find who is drawn; those above it are drawn anyway and get their order
    inside = numbered(pool.where(F.col(score).between(lo, hi)), [], order, "_place", start=above + 1)
    inside = inside.select(*names, F.when(F.col("_place") <= draw, F.col("_place")).alias("rank"))
    first = numbered(pool.where(F.col(score) > hi), [], order, "rank", start=1).select(*names, "rank")
    rest = rows.where(~F.col("_eligible") | (F.col(score) < lo)).select(*names, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(first).unionByName(inside)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's id, n_words, n_features, weight, score and rank in the sample."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    scored = weigh(docs, gain, (id_col,), text_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    return draw_top(scored, F.col("n_words") >= least_words, percent, id_col=id_col)
