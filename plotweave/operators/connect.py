"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.plans.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w")))
    least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.where("w > v").join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("w").alias("m"))
    moved = edges.join(least, "v").where("w != m").select(F.col("w").alias("v"), F.col("m").alias("w"))
    return moved.unionByName(least.select("v", F.col("m").alias("w")))


#: Links that one task joins by itself.
CHUNK = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each vertex's component, vertices being 0 to n - 1."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        unlike = ra != rb
        if not unlike.any():
            return root
        a, b, ra, rb = a[unlike], b[unlike], ra[unlike], rb[unlike]
        # hook larger roots to smaller ones, then let all point to their roots
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further


def local_stars(links: DataFrame) -> DataFrame:
    """Links (a, b) between whole numbers with the same components, at most one per vertex and chunk of `CHUNK` links.

    Chunks are dealt without regard to keys, so no group of links is one task
    and a task holds a bounded number; dense groups become stars.
    """
    name = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sides = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)]
        ids, at = np.unique(np.concatenate(sides), return_inverse=True)
        root = _roots(at[: len(sides[0])], at[len(sides[0]) :], len(ids))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    rows = staged(links.where("a != b").select("a", F.col("b").cast(name).alias("b")), "links")
    chunks = max(1, -(-rows.count() // CHUNK))
    return rows.repartition(chunks).mapInArrow(run, f"a {name}, b {name}")


def components(links: DataFrame) -> DataFrame:
    """(v, component): every vertex that the links (a, b) join to another, with the smallest vertex it reaches.

    Vertices keep one edge to a smaller one, so the table shrinks towards one
    row per vertex; the number of rounds grows with the logarithm of the longest
    chain. Minima are aggregated before the shuffle, and a vertex with many
    links is a skewed join key that AQE splits. Links between whole numbers are
    thinned to stars in chunks first.
    """
    if all(isinstance(links.schema[c].dataType, (T.IntegerType, T.LongType)) for c in "ab"):
        links = local_stars(links)
    edges = links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct()
    seen = None
    while True:
        edges = staged(_small_star(_large_star(edges).where("v != w").distinct()).distinct(), "components")
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "w"))).first())
        if state == seen or not state[0]:
            return edges.select("v", F.col("w").alias("component")).unionByName(edges.select(F.col("w").alias("v"), F.col("w").alias("component")).distinct())
        seen = state
