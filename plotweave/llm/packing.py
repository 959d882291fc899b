"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are cut into pieces of at most `capacity` words; every word is in
exactly one piece. Pieces are packed in windows of WINDOW rows, longest first.
Open bins are kept ordered by residual room, each with a bitmap of duplicate
clusters and counted bitmaps of sources (one per allowed repeat). A piece
searches from the first bin with enough room upwards until the bitmaps allow
it, which is the tightest compatible bin; without one it opens a bin.

A bit may stand for several values (clusters have 1,024 hashed bits, sources a
bit each up to 64 of a window): where one is set, the bin's exact set of
clusters and counts of sources decide, so a bin takes any number of clusters.

Windows bound a task's memory and time: a hot source or cluster fills bins in
many windows, and each window leaves only its own last bins part full.

Defined results: null texts and texts without words give one piece of 0 words
in no bin; null sources are a source; a document's pieces are in one cluster,
so no two share a bin; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, squeezed, staged, text_of, word_count

WINDOW = 8192
SCHEMA = "doc_id long, source string, piece int, start_word long, n_words int, bin_id string, position int, bin_words int"


#: 64-bit words of a bin's bitmap of clusters.
BITMAP_WORDS = 16


class OpenBins:
    """Bins of one window, ordered by residual room.

    A clear bit proves a bin free of a cluster or source; where a bit is set,
    the bin's own set of clusters and counts of sources decide.
    """

    def __init__(self, capacity: int, source_limit: int, most: int):
        self.capacity, self.limit, self.n, self.opened = capacity, source_limit, 0, 0
        self.room = np.zeros(most + 1, dtype=np.int64)
        self.clusters = np.zeros((BITMAP_WORDS, most + 1), dtype=np.uint64)
        self.sources = np.zeros((source_limit, most + 1), dtype=np.uint64)
        self.name = np.zeros(most + 1, dtype=np.int64)
        self.members: dict[int, set[int]] = {}
        self.counts: dict[int, Counter] = {}

    def place(self, words: int, cluster: int, source: int, source_bit: np.uint64, exact: bool) -> int:
        """Put a piece into the tightest compatible bin and return the bin's number; `exact`: no two sources share a bit."""
        n, at, step = self.n, int(np.searchsorted(self.room[: self.n], words)), 16
        word, cluster_bit = (cluster >> 6) % BITMAP_WORDS, np.uint64(1) << np.uint64(cluster & 63)
        full = self.sources[-1]
        while at < n:
            end = min(n, at + step)
            free = (full[at:end] & source_bit) == 0
            clear = free & ((self.clusters[word, at:end] & cluster_bit) == 0)
            first = int(clear.argmax()) if clear.any() else end - at
            # before the first clear one a set bit may stand for another value
            for i in np.flatnonzero(free[:first]) if exact else range(first):
                number = int(self.name[at + i])
                if cluster not in self.members[number] and self.counts[number][source] < self.limit:
                    return self._shrink(at + int(i), words, cluster, word, cluster_bit, source, source_bit)
            if at + first < end:
                return self._shrink(at + first, words, cluster, word, cluster_bit, source, source_bit)
            at, step = end, step * 4
        number = self.opened
        self.opened += 1
        self.name[n], self.clusters[:, n], self.sources[:, n] = number, 0, 0
        self.members[number], self.counts[number] = set(), Counter()
        self.n += 1
        self.room[n] = self.capacity
        self._shrink(n, words, cluster, word, cluster_bit, source, source_bit)
        return number

    def _shrink(self, at: int, words: int, cluster: int, word: int, cluster_bit: np.uint64, source: int, source_bit: np.uint64) -> int:
        """Take room from bin `at` and move it to its new place in the order."""
        room, number = int(self.room[at]) - words, int(self.name[at])
        self.members[number].add(cluster)
        self.counts[number][source] += 1
        clusters, planes = self.clusters[:, at].copy(), self.sources[:, at].copy()
        clusters[word] |= cluster_bit
        for k in range(len(planes)):
            if not planes[k] & source_bit:
                planes[k] |= source_bit
                break
        if room == 0:  # closed
            for x in (self.room, self.name):
                x[at : self.n - 1] = x[at + 1 : self.n]
            for x in (self.clusters, self.sources):
                x[:, at : self.n - 1] = x[:, at + 1 : self.n]
            del self.members[number], self.counts[number]
            self.n -= 1
            return number
        to = int(np.searchsorted(self.room[:at], room))
        for x, value in ((self.room, room), (self.name, number)):
            x[to + 1 : at + 1] = x[to:at].copy()
            x[to] = value
        for x, value in ((self.clusters, clusters), (self.sources, planes)):
            x[:, to + 1 : at + 1] = x[:, to:at].copy()
            x[:, to] = value
        return number


def pack_window(words: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int, source_limit: int) -> np.ndarray:
    """Bin numbers of the pieces of one window; pieces come longest first. `clusters` and `sources` are 64-bit hashes."""
    bins = OpenBins(capacity, source_limit, len(words))
    # up to 64 sources of a window have a bit each
    ids, place = np.unique(sources, return_inverse=True)
    bits = np.uint64(1) << (place.astype(np.uint64) & np.uint64(63))
    clusters = clusters.view(np.uint64)
    return np.array([bins.place(int(w), int(c), int(s), b, len(ids) <= 64) for w, c, s, b in zip(words, clusters, place, bits, strict=True)], dtype=np.int64)


def _packing_task(capacity: int, source_limit: int, window: int):
    def flush(rows: pd.DataFrame, prefix: str) -> pd.DataFrame:
        rows = rows.sort_values("n_words", ascending=False, kind="stable")
        number = pack_window(rows.n_words.to_numpy(), rows.cluster.to_numpy(), rows.source_hash.to_numpy(), capacity, source_limit)
        rows = rows.assign(bin_id=[f"{prefix}-{x}" for x in number], number=number)
        by = rows.groupby("number").n_words
        return rows.assign(position=rows.groupby("number").cumcount().astype("int32"), bin_words=by.transform("sum").astype("int32"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        held, part, turn = [], TaskContext.get().partitionId(), 0
        count = 0
        for frame in frames:
            while len(frame):
                take = frame.iloc[: window - count]
                held.append(take)
                count += len(take)
                frame = frame.iloc[len(take) :]
                if count == window:
                    yield flush(pd.concat(held), f"{part}-{turn}")[names]
                    held, count, turn = [], 0, turn + 1
        if count:
            yield flush(pd.concat(held), f"{part}-{turn}")[names]

    return run


def pack(docs: DataFrame, capacity: int = 2048, source_limit: int = 4, cluster_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, source, piece, start_word, n_words, bin_id, position in the bin, bin_words (what the bin holds).

    No bin holds two pieces of one duplicate cluster (`cluster_col`; by default
    equal texts without white space) or more than `source_limit` of one source.
    """
    own = columns(docs, id_col, text_col, source_col, *([cluster_col] if cluster_col else []))
    text = text_of(text_col)
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(squeezed(text))
    rows = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), cluster.alias("cluster"))
    rows = staged(rows, "pack-sizes")
    pieces = rows.where("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / capacity) - 1).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "source", "piece", start.alias("start_word"), F.least(F.lit(capacity), F.col("size") - start).cast("int").alias("n_words"), "cluster", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("source_hash"))
    total = rows.where("size > 0").agg(F.sum(F.ceil(F.col("size") / capacity))).first()[0] or 0
    spot = F.xxhash64("doc_id", "piece", "cluster")
    dealt = pieces.withColumn("spot", spot).repartition(max(1, -(-total // (2 * window))), "spot").sortWithinPartitions("spot", "doc_id", "piece").drop("spot")
    packed = dealt.mapInPandas(_packing_task(capacity, source_limit, window), SCHEMA)
    none = rows.where("size = 0").select("doc_id", "source", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"), F.lit(0).alias("n_words"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("bin_words"))
    return packed.unionByName(none).withColumnRenamed("doc_id", id_col)
