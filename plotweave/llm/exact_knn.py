"""Exact top-k inner products by a Voronoi join.

Every vector belongs to its nearest pivot; there are about sqrt(n) pivots. A
group's summary holds its size, its radius and the ids and distances of its
members nearest to the pivot. From summaries alone a query gets a score that its
k-th answer surely reaches (the members of other ids known to lie near a pivot
score at least q.p - |q| d) and, for each group, a score that no member exceeds
(q.p + |q| r). Only groups that may exceed the first are searched. Groups are
dealt to blocks of some BLOCK rows, larger groups to several; a query is sent
once to each block that holds a group it must search. There the groups are
solved one after another, the most promising first, by matrix products, and
what has been found raises the score that the next group must be able to reach.

Memory of a task: one block of data and one of queries, whatever a group's
size. The driver holds pivots and summaries, at most MAX_PIVOTS x (dimension +
k) numbers twice over.

Defined results: rows with a null id or vector, or with a null component, take
no part; shorter vectors count as padded with zeros; rows of a query's own id
are not its candidates; rows with equal id and vector count once; fewer candidates than k are all
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, columns, staged

MAX_PIVOTS = 1024
BLOCK = 16384


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _nearest(pivots: np.ndarray):
    """Add group and distance to (id, vec)."""
    norms = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vec").to_pylist(), pivots.shape[1])
            group = np.argmin(norms - 2 * rows @ pivots.T, axis=1)
            far = np.sqrt(((rows - pivots[group]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(group.astype(np.int32)), pa.array(far)], names=["id", "vec", "grp", "far"])

    return run


def _near_members(k: int):
    """Partial summaries: the k + 1 nearest ids of each group, with their distances, in what one task has read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[int, float]] = {}
        for frame in frames:
            for (g, i), far in frame.groupby(["grp", "id"]).far.min().items():
                own = held.setdefault(g, {})
                own[i] = min(far, own.get(i, far))
            held = {g: dict(heapq.nsmallest(k + 1, own.items(), key=lambda x: x[1])) for g, own in held.items()}
        rows = [(g, i, far) for g, own in held.items() for i, far in own.items()]
        yield pd.DataFrame(rows, columns=["grp", "id", "far"]).astype({"grp": "int32", "id": "int64", "far": "float64"})

    return run


class Bounds:
    """Pivots with their groups' radius, known members and blocks; what queries need to know of the data."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, near: list[list[tuple[float, int]]], sizes: np.ndarray, k: int, block: int):
        self.pivots, self.radius, self.k = pivots, radius, k
        self.owner = np.repeat(np.arange(len(near)), [len(x) for x in near])
        self.known = np.array([far for x in near for far, _ in x], dtype=float)
        self.known_ids = np.array([i for x in near for _, i in x], dtype=np.int64)
        # groups fill blocks in turn; one of more than a block has blocks of its own
        self.first, self.parts = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // block))
        held, last = 0, -1
        for g, n in enumerate(sizes):
            if last < 0 or held + n > block:
                last, held = last + 1, 0
            self.first[g] = last
            held += n
            if self.parts[g] > 1:
                last, held = last + int(self.parts[g]) - 1, block
        self.some = sizes > 0
        self.blocks = last + 1

    def reach(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score that no member of a group exceeds, for each row and group, and the rows' rounding allowance."""
        at_pivot, norm = rows @ self.pivots.T, np.sqrt((rows**2).sum(1))
        slack = 1e-9 * (np.abs(at_pivot).max(initial=0) + norm.max(initial=0) * self.radius.max(initial=0)) + 1e-6
        return at_pivot + norm[:, None] * self.radius + slack, np.full(len(rows), slack)

    def floor(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The score that a row's k-th answer surely reaches; rows of its own id don't count."""
        out = np.full(len(rows), -np.inf)
        if len(self.known) >= self.k:
            norm = np.sqrt((rows**2).sum(1))
            sure = (rows @ self.pivots.T)[:, self.owner] - norm[:, None] * self.known
            sure = np.where(self.known_ids[None, :] == ids[:, None], -np.inf, sure)
            out = np.partition(sure, len(self.known) - self.k, axis=1)[:, len(self.known) - self.k] - self.reach(rows)[1]
        return out

    def wanted(self, rows: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which groups each row must search."""
        return (self.reach(rows)[0] >= floor[:, None]) & self.some


def _targets(bounds: Bounds):
    """For each query the blocks that it must search, and the score that its answers reach."""
    cover = np.zeros((len(bounds.first), bounds.blocks), dtype=bool)
    for g in np.flatnonzero(bounds.some):
        cover[g, bounds.first[g] : bounds.first[g] + bounds.parts[g]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, ids = batch.column("vec"), batch.column("id")
            rows = _matrix(vec.to_pylist(), bounds.pivots.shape[1])
            for a in range(0, len(rows), 512):
                part = rows[a : a + 512]
                floor = bounds.floor(part, ids.slice(a, len(part)).to_numpy())
                q, block = np.nonzero(bounds.wanted(part, floor) @ cover)
                pick = pa.array(q + a)
                yield pa.RecordBatch.from_arrays([ids.take(pick), vec.take(pick), pa.array(floor[q]), pa.array(block.astype(np.int32))], names=["id", "vec", "floor", "block"])

    return run


def _best(bounds: Bounds):
    """Top k of a block of data for each query of a block, ties to the smaller id."""
    k, width = bounds.k, bounds.pivots.shape[1]

    def run(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values(["grp", "id"], kind="stable")
        ids, have, grp = data.id.to_numpy(), _matrix(list(data.vec), width), data.grp.to_numpy()
        groups = {int(g): slice(a, b) for g, a, b in zip(*_runs(grp), strict=True)}
        # larger for smaller ids; equal only for rows of one id
        turn = len(ids) - np.searchsorted(np.unique(ids), ids)
        parts = []
        for a in range(0, len(asked), 256):
            some = asked.iloc[a : a + 256]
            own, want, floor = some.id.to_numpy(), _matrix(list(some.vec), width), some.floor.to_numpy().copy()
            reach = bounds.reach(want)[0]
            bound = np.sqrt((want**2).sum(1).max(initial=0) * (have**2).sum(1).max(initial=0))
            exact = bound * (len(have) + 2) < 2.0**53  # else beyond doubles: Python's integers
            best = np.full((len(want), k), -np.inf, dtype=float if exact else object)
            at = np.zeros((len(want), k), dtype=np.int64)
            for g in sorted(groups, key=lambda g: -reach[:, g].mean()):
                rows, cut = np.flatnonzero(reach[:, g] >= floor), groups[g]
                if not len(rows):
                    continue
                score = want[rows] @ have[cut].T if exact else want[rows].astype(np.int64).astype(object) @ have[cut].T.astype(np.int64).astype(object)
                # one number orders by score, then by smaller id
                rank = np.where(ids[cut][None, :] == own[rows][:, None], -np.inf, score * (len(ids) + 1) + turn[cut])
                pool = np.concatenate([best[rows], rank], axis=1)
                place = np.concatenate([at[rows], np.broadcast_to(np.arange(cut.start, cut.stop), rank.shape)], axis=1)
                top = np.argpartition(pool, pool.shape[1] - k, axis=1)[:, -k:] if exact else np.argsort(pool, axis=1)[:, -k:]
                best[rows], at[rows] = np.take_along_axis(pool, top, 1), np.take_along_axis(place, top, 1)
                # a group must be able to reach the k-th score so far; an equal score may win by its id
                last = best[rows].min(axis=1)
                least = np.array([-np.inf if x == -np.inf else x // (len(ids) + 1) for x in last], dtype=float)
                floor[rows] = np.maximum(floor[rows], least)
            row, col = np.nonzero(best != -np.inf)
            spot = at[row, col]
            score = np.array([int(want[r].astype(np.int64).astype(object) @ have[p].astype(np.int64).astype(object)) for r, p in zip(row, spot, strict=True)], dtype=np.int64) if not exact else np.einsum("ij,ij->i", want[row], have[spot]).astype(np.int64)
            parts.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[spot], "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of equal numbers in sorted `values`: value, start, end."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[starts], starts, np.append(starts[1:], len(values)).astype(np.int64)[: len(starts)]


def _searched(rows: Iterator[pd.DataFrame], bounds: Bounds) -> Iterator[pd.DataFrame]:
    for frame in rows:
        want = _matrix(list(frame.vec), bounds.pivots.shape[1])
        hit = bounds.wanted(want, bounds.floor(want, frame.id.to_numpy()))
        yield pd.DataFrame({"pairs": [len(want) * int(bounds.some.sum())], "searched": [int(hit.sum())]})


def _prepared(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, block: int) -> tuple[DataFrame, DataFrame, Bounds]:
    """The distinct rows with their group, the queries, and the bounds from the groups' summaries."""
    bounded_batches(vectors.sparkSession)
    whole = columns(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("vec"), is_query.alias("asks"))
    whole = whole.where("id is not null and vec is not null").where(F.forall("vec", lambda x: x.isNotNull()))
    # equal rows are one before any top k is cut, and so are vectors that trailing zeros alone part: padded, they are equal
    longest = F.coalesce(F.array_max(F.transform("vec", lambda x, i: F.when(x != 0, i + 1))), F.lit(0))
    whole = staged(whole.withColumn("vec", F.slice("vec", F.lit(1), longest)).groupBy("id", "vec").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks")), "knn-rows")
    n, width = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    pivots = int(min(MAX_PIVOTS, max(1, round(n**0.5))))
    sample = whole.select(F.xxhash64("vec").alias("h"), "vec").distinct().orderBy("h").limit(pivots).toPandas()
    centres = _matrix(list(sample.vec), max(width, 1)) if len(sample) else np.zeros((1, max(width, 1)))
    placed = staged(whole.select("id", "vec").mapInArrow(_nearest(centres), "id long, vec array<long>, grp int, far double"), "knn-placed")

    parts = placed.select("grp", "id", "far").mapInPandas(_near_members(k), "grp int, id long, far double").groupBy("grp", "id").agg(F.min("far").alias("far"))
    near = parts.groupBy("grp").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
    summary = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(near, "grp").toPandas().set_index("grp")
    groups = range(len(centres))
    radius = np.array([summary.radius.get(g, 0.0) for g in groups])
    sizes = np.array([int(summary.n.get(g, 0)) for g in groups])
    members = [[(x["far"], x["id"]) for x in summary.near.get(g, [])] for g in groups]
    return placed, whole.where("asks").select("id", "vec"), Bounds(centres, radius, members, sizes, k, block)


def pruned_pairs(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec") -> tuple[int, int]:
    """How many pairs of a query and a group there are, and how many of them the summaries leave to search."""
    _, asks, bounds = _prepared(vectors, is_query, k, id_col, vec_col, BLOCK)
    found = asks.mapInPandas(lambda rows: _searched(rows, bounds), "pairs long, searched long").agg(F.sum("pairs"), F.sum("searched")).first()
    return found[0] or 0, found[1] or 0


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product with each row that `is_query` selects.

    `vec_col` holds arrays of integers; scores are exact.
    """
    placed, asks, bounds = _prepared(vectors, is_query, k, id_col, vec_col, block)
    # a group's block, or one of its blocks by a hash of the row
    first, parts = (F.element_at(F.from_json(F.lit(str(x.tolist())), "array<int>"), F.col("grp") + 1) for x in (bounds.first, bounds.parts))
    data = placed.select("id", "vec", "grp", (first + F.pmod(F.xxhash64("id", "vec"), parts)).cast("int").alias("block"))
    batches = max(1, -(-asks.count() // block))
    asks = asks.mapInArrow(_targets(bounds), "id long, vec array<long>, floor double, block int").withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    asks = staged(asks, "knn-asks")
    needed = asks.select("block", "batch").distinct()
    key = ["block", "batch"]
    # fresh aliases: both sides of the cogroup come from the same queries
    data = data.join(needed, ["block"]).select("id", "vec", "grp", *[F.col(c).alias(c) for c in key])
    found = asks.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(_best(bounds), "query_id long, vec_id long, score long")
    # rows of one id and score in several vectors count as often as they differ
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
