"""Near duplicates of word shingles by a chosen-path set similarity join.

Every distinct shingle set is a vertex and gets 64 minwise tokens. Trees branch
the sets: a node picks positions of the tokens, and a set goes to one child per
picked position, named by the token that it has there. Similar sets share most
tokens, so they stay together along some path; others part after a level or
two. Nodes with few sets are compared exhaustively; larger ones branch on. Eight
roots pick separate positions. The first two levels below a root have two
children for each set; from there on the mean number of children is 1 / threshold,
so a pair at the threshold keeps one common child on average, and sets below it
lose each other level by level. A pair meets in a root with its similarity s, so
pairs whose nodes are small at once are missed with (1 - s)**8 at most: 3e-7 for
0.85, 3e-6 for 0.8. In nodes that need 6, 10 or 16 more levels a pair exactly at
the threshold is missed with about 4e-5, 3e-4 and 2e-3 (0.85), or 7e-4, 4e-3 and
2e-2 (0.8); a pair 0.05 above it is missed less than 1 in 4,000 times.

A large group of near copies would keep its node large on every path. So each
large node first compares its sets with some of them, among these the one that shares
tokens with most others; confirmed links join them, and sets that are connected
already need no comparison. What is still large after the last level is
compared exhaustively too, in blocks; nothing is capped.

Candidate pairs pass two sketches in the join condition, and survivors are
confirmed on the full sets of the whole texts. One has two bits of each token.
The other has a bit's parity for each element, so that the bits in which two
sketches differ are never more than the elements in which the sets differ: for
sets of up to some hundred shingles it lets through few pairs that are not
links, and every pair that is, so there it decides alone; larger sets pass both.

Defined results: texts without words link with nothing and always stay; equal
sets are one vertex; null ids are last in order; rows are decided by their own
text, whatever other rows hold their id; of rows equal in id and text one
stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators.connect import components

from .common import bounded_batches, columns, keep_rows, staged, text_key, text_of, with_member_flag
from .wordhash import mixed, shingle_sets, slices

TOKENS = 64
#: Positions that the roots pick.
ROOTS = [8 * k for k in range(8)]
#: Levels below a root at which each set has two children, and levels that are grown between two counts.
RICH = 2
STRIDE = 4
#: Most rounds of growth; what is large then is compared exhaustively.
ROUNDS = 6
#: A root of so many sets is compared exhaustively: growing it would cost more pairs than it saves.
ROOT = 4096
#: A grown node of so many sets is compared exhaustively; after the last round larger ones are too, in blocks of so many.
SMALL = 512
FEW = 64
#: Sets in a node from which some are compared with all others first, and how many.
STAR = 256
CENTRES = 32
#: Pairs of sets that one task is given to compare.
TASK_PAIRS = 4_000_000
#: Bits of the parity sketch.
ODD_BITS = 512
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)


def minwise(values: np.ndarray) -> np.ndarray:
    """The tokens of one set; long sets are worked on in parts."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 8192):
        part = (values[None, at : at + 8192] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return mixed(best)


def parities(values: np.ndarray) -> np.ndarray:
    """The parity sketch of one set as 64-bit words."""
    at = ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (ODD_BITS - 1)
    return np.packbits((np.bincount(at, minlength=ODD_BITS) & 1).astype(np.uint8)).view(np.int64)


def _features(width: int):
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                tokens = np.stack([minwise(s) for s in sets])
                low, high = (((tokens >> np.uint64(k)) & np.uint64(1)) @ weights for k in (0, 1))
                key1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                key2 = np.array([mixed(s ^ _XOR[0]).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                flat = pa.array((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel())
                token_lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * TOKENS), flat)
                odd = pa.array(np.concatenate([parities(s) for s in sets]))
                odd = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * (ODD_BITS // 64)), odd)
                longs = [pa.array(x.view(np.int64)) for x in (key1, key2, low, high)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("id", "ta", "tb")], pa.array([len(s) for s in sets], pa.int64()), *longs, token_lists, odd], names=["id", "ta", "tb", "n", "key1", "key2", "low", "high", "tokens", "odd"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        size = 0
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            linked = np.zeros(len(left), dtype=bool)
            for i, (s, t) in enumerate(zip(left, right, strict=True)):
                if size > 4_000_000:
                    held, size = {}, 0
                for x in (s, t):
                    if x not in held:
                        held[x] = shingle_sets([x], width)[0]
                        size += len(held[x]) + len(x) // 8
                a, b = held[s], held[t]
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked[i] = 100 * both >= percent * (len(a) + len(b) - both)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough as a whole; staged. Only one text of each set is shuffled."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    named = sets.select("v", F.col("rep.id").alias("rid"), F.col("rep.ta").alias("rta"), F.col("rep.tb").alias("rtb")).join(ends, "v")
    named = staged(named, "near-ends")
    some = with_member_flag(docs, F.xxhash64("id", "ta", "tb"), named, F.xxhash64("rid", "rta", "rtb"), "wanted").where("wanted")
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("ta") == F.col("rta")) & (F.col("tb") == F.col("rtb"))
    texts = some.join(named, same).select("v", "text").dropDuplicates(["v"])
    rows = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    return staged(rows.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a long, b long").distinct(), "near-links")


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow the pair; where parities decide alone no link fails, else one at the threshold does by chance some twice in ten million."""
    p = (1 - percent / 100) * 0.75
    most = ceil(TOKENS * p + 5.5 * sqrt(TOKENS * p * (1 - p)))
    differ = F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")).bitwiseOR(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high"))))
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    odd = F.bit_count(F.col(f"{a}.odd")[0].bitwiseXOR(F.col(f"{b}.odd")[0]))
    for i in range(1, ODD_BITS // 64):
        odd = odd + F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i]))
    # so many elements may differ; beyond some hundred, parities meet, and five deviations above their mean is the limit
    apart = F.floor((small + large) * (100 - percent) / (100 + percent) + 1e-9)
    mean = ODD_BITS / 2 * (1 - F.exp(-2 * apart / ODD_BITS))
    chance = mean + 5 * F.sqrt(mean * (1 - mean / ODD_BITS))
    return (small * 100 >= large * percent) & (odd <= F.least(apart.cast("double"), chance)) & ((apart <= chance) | (differ <= most))


def _star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of large nodes: b is the set with most company in all its nodes, or one of some CENTRES sets that a hash picks."""
    fame = nodes.groupBy("v").agg(F.sum("size").alias("fame"))
    large = nodes.where(F.col("size") > STAR).join(fame, "v")
    own = ["v", "n", "low", "high", "odd"]
    centre = large.groupBy("key").agg(F.min_by(F.struct(*own), F.struct(-F.col("fame"), "v")).alias("c")).select("key", "c.*")
    some = large.where(F.pmod(F.xxhash64("v", F.lit("centre")), F.col("size")) < CENTRES).select("key", *own)
    centre = centre.unionByName(some).distinct()
    return large.alias("a").join(centre.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.v") != F.col("b.v")) & _alike("a", "b", percent)).select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).distinct()


def _opened(nodes: DataFrame, crowded: bool) -> DataFrame:
    """Rows of nodes in which several parts meet, with the node's size, its most frequent part and that part's size; staged."""
    if crowded:
        counts = nodes.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        counts = counts.agg(F.sum("n").alias("size"), F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"))
    else:
        counts = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("main"), F.lit(1).cast("long").alias("most"))
    return staged(nodes.drop("size").join(counts.where(F.col("size") > F.col("most")), "key"), "near-level")


def _is_small(most: int) -> Column:
    """A node is small by the pairs that must be compared in it, those of `most` sets: all but those inside its most frequent part.

    One with FEW sets outside that part is small too: no set has more partners than those.
    """
    rest = F.col("size") - F.col("most")
    return (rest <= FEW) | (rest * F.col("most") + rest * rest / 2 <= most * most / 2)


def _node_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of sets of different parts that meet in a node; of several nodes in which a pair meets one makes it.

    On the left stand the sets outside the most frequent part, on the right all;
    both sides are cut into blocks of SMALL sets, and each pair of blocks is a
    group of its own. Groups are dealt to enough tasks for the pairs in them.
    """
    outer = F.col("part") != F.col("main")
    work = nodes.where(outer).agg(F.sum("size")).first()[0] or 0
    tasks = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, -(-work // TASK_PAIRS))
    lefts, rights = (F.ceil(n / SMALL).cast("int") for n in (F.col("size") - F.col("most"), F.col("size")))
    keys = F.collect_list("key").over(Window.partitionBy("v"))  # a set is in few nodes
    nodes = nodes.withColumn("before", F.filter(keys, lambda k: k < F.col("key")))
    left = nodes.where(outer).select("*", F.explode(F.sequence(F.lit(0), rights - 1)).alias("block"))
    left = left.withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("v"), lefts), F.col("block").cast("long")))
    right = nodes.select("*", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("block"))
    right = right.withColumn("cell", F.xxhash64("key", F.col("block").cast("long"), F.pmod(F.xxhash64("v"), rights)))
    left, right = left.repartition(tasks, "cell").alias("a"), right.repartition(tasks, "cell").alias("b")
    once = (F.col("b.part") == F.col("b.main")) | (F.col("a.v") < F.col("b.v"))
    # the condition must stay small enough for compiled code
    pair = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & once
    return left.join(right, pair & _alike("a", "b", percent) & ~F.arrays_overlap("a.before", "b.before")).select(F.least("a.v", "b.v").alias("a"), F.greatest("a.v", "b.v").alias("b")).distinct()


def _children(tokens: str, rich: bool, percent: int):
    """The keys of a node's children for a set with these tokens; which positions a node picks depends on its key alone."""

    def of(key: Column) -> Column:
        pick = lambda j: F.xxhash64(key, F.lit(j), F.get(F.col(tokens), F.pmod(F.xxhash64(key, F.lit(f"at{j}")), F.lit(TOKENS)).cast("int")))
        if rich:
            return F.array(pick(0), pick(1))
        more = F.pmod(F.xxhash64(key, F.lit("more")), F.lit(10_000)) < int(10_000 * (100 / percent - 1))
        return F.when(more, F.array(pick(0), pick(1))).otherwise(F.array(pick(0)))

    return of


def similar_links(sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all similar sets; `sets` has one row per distinct set, with its vertex v."""
    brief = ["v", "n", "low", "high", "odd"]
    nodes = sets.select(*brief, F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("tokens")[at]) for k, at in enumerate(ROOTS)])).alias("key"))
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    nodes = staged(nodes.join(sizes, "key"), "near-nodes")

    links = None
    crowded = bool(nodes.where(F.col("size") > STAR).limit(1).count())
    if crowded:
        links = confirmed(staged(_star_pairs(nodes, percent), "near-stars"), sets, docs, width, percent)
        # a set's component as far as known
        parts = components(links).select("v", F.col("component").alias("part"))
        nodes = nodes.join(parts, "v", "left").withColumn("part", F.coalesce("part", "v"))
    else:
        nodes = nodes.withColumn("part", F.col("v"))

    carried = [*brief, "part"]
    ready = None
    for turn in range(ROUNDS + 1):
        nodes = _opened(nodes, crowded)
        last, small = turn == ROUNDS or not crowded, _is_small(SMALL if turn else ROOT)
        some = nodes if last else nodes.where(small)
        ready = some if ready is None else ready.unionByName(some)
        if last or not nodes.where(~small).limit(1).count():
            break
        grown = nodes.where(~small).select(*carried, "key").join(sets.select("v", "tokens"), "v")
        for level in range(STRIDE):
            children = _children("tokens", turn * STRIDE + level < RICH, percent)
            grown = grown.withColumn("key", F.explode(children(F.col("key"))))
        nodes = grown.select(*carried, "key")

    pairs = confirmed(staged(_node_pairs(ready, percent), "near-pairs"), sets, docs, width, percent)
    return pairs if links is None else links.unionByName(pairs)


def _graded(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, ta, tb, n and best, the (none, id, ta, tb) of the row that stays for its component; null without words."""
    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    ta, tb = text_key(text)
    own = columns(docs, id_col, text_col).select(F.col(id_col).alias("id"), ta.alias("ta"), tb.alias("tb"), text.alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(_features(width), f"id {kind}, ta long, tb long, n long, key1 long, key2 long, low long, high long, tokens array<int>, odd array<long>")
    rows = staged(rows, "near-features")
    same = ["n", "key1", "key2"]
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "ta", "tb")).alias("rep")
    sets = rows.where("n > 0").groupBy(*same).agg(rep, F.min_by(F.struct("low", "high", "tokens", "odd"), "ta").alias("s"))
    # the numbers are written with the sets, so they are the same wherever they are read
    sets = staged(sets.select(F.monotonically_increasing_id().alias("v"), *same, "rep", "s.*"), "near-sets")
    parts = staged(components(similar_links(sets, own, width, percent)), "near-parts")
    best = sets.join(parts, "v").groupBy("component").agg(F.min("rep").alias("best"))
    linked = parts.join(best, "component").select("v", "best")
    named = sets.join(linked, "v", "left").select(*same, F.coalesce("best", "rep").alias("best"))
    row = ["id", "ta", "tb", "n"]
    placed = rows.where("n > 0").select(*row, "key1", "key2").join(named, same).select(*row, "best")
    return placed.unionByName(rows.where("n = 0").select(*row, F.lit(None).cast(placed.schema["best"].dataType).alias("best")))


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (the id is its component's).

    Documents are linked when 100 x intersection >= percent x union of their
    sets of distinct `width`-word shingles (A-Z lower-cased); component_id is
    the smallest id reachable over links.
    """
    component = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    out = _graded(docs, percent, width, id_col, text_col).withColumn("component_id", component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with one row of each component."""
    graded = staged(_graded(docs, percent, width, id_col, text_col).where("n > 0"), "near-graded")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("ta") == F.col("best.ta")) & (F.col("tb") == F.col("best.tb"))
    row = ["id", "ta", "tb"]
    gone = staged(graded.where(~stays).select(*row).distinct(), "near-drop")
    once = graded.where(stays).groupBy(*row).count().where("count > 1").select(*row)
    return keep_rows(docs, gone, once, id_col, text_col)
