"""The trie of conversation prefixes: how many conversations share each sequence of first turns.

Turns are numbered, and their digests summed up along a conversation, in ranges
of (conversation, turn): a conversation with a third of all turns is spread
like any other, and no text is shuffled. The key of a prefix is its depth and a
128-bit sum of hashes of its turns with their places.

A count-min sketch of all prefix keys, with counters that stop at two, screens
the prefixes: an estimate of one proves that no other conversation has the
prefix, nor anything longer of it, so these tails are given out as they are.
Only prefixes above the first such one are shuffled, counted exactly by key and
joined back. The sketch has a fixed size; where it is crowded more prefixes
take the exact way, and no result changes.

Subtrees need no walk over the levels. Each node is owned by its smallest
member c, which then owns everything longer on its own path too, from depth
o(c) on. What a member adds to the subtree sums of a prefix of depth d follows
from o(c) and running sums along c alone.

Defined results: a null role or text is empty; rows without a conversation id
belong to none; equal turn numbers follow by role, then by the digest of role
and text; repeated rows are turns of their own; an empty table has no node, a
table without shared prefixes has the root and tails. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, with_member_flag

#: Counters of each row of the sketch: 4 rows of 4 million, as bits 2 MB in all.
WIDTH, ROWS = 1 << 22, 4
#: The deepest turn that a rebuilt conversation takes over.
MOST_SHARED = 5
_KEY = ["depth", "ka", "kb"]
_PARTS = ["p0", "p1", "p2", "p3"]


def running(rows: DataFrame, group: list[str], order: list[str], sums: list[str], label: str) -> DataFrame:
    """`rows` with _at, the number from 1 in its group, and the running sum of each of `sums` under its name.

    Rows are dealt by ranges of group and order, summed up inside a range, and
    a group that began in earlier ranges gets their totals: at most one per
    range, so the table that is broadcast has one row per range at most.
    """
    salted = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = staged(salted.repartitionByRange(*group, *order, "_row").withColumn("_part", F.spark_partition_id()), label)
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *group, F.sum("_n").over(before).alias("_n0"), *[F.sum(s).over(before).alias(f"{s}_0") for s in sums]).where("_n0 is not null")
    own = dealt.withColumns({"_at": F.row_number().over(inside), **{s: F.sum(s).over(inside) for s in sums}})
    out = own.join(F.broadcast(carried), ["_part", *group], "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    rest = [c for c in rows.columns if c not in sums]
    return out.select(*rest, plus("_at", "_n0"), *[plus(s, f"{s}_0") for s in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """c, at (1, 2, 3... by turn, null first), points of the text, and a digest of role and text."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("points"))
    return running(rows, ["c"], ["turn", "role", "digest"], [], "turns").select("c", F.col("_at").cast("long").alias("at"), "points", "digest")


def rebuilt(turn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, at, points, digest) after each conversation's first h turns are those of conversation c - c % 100; and (c, length) of all."""
    shared = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(MOST_SHARED + 1))
    sizes = turn.groupBy("c").agg(F.max("at").alias("own")).withColumns({"h": shared, "base": F.col("c") - F.col("c") % 100})
    of_base = sizes.select(F.col("c").alias("base"), F.col("own").alias("of_base"))
    sizes = staged(sizes.join(of_base, "base", "left").select("c", "base", "h", "own", F.least("h", F.coalesce("of_base", F.lit(0))).alias("taken")), "conversations")
    heads = turn.where((F.col("at") <= MOST_SHARED) & (F.col("c") % 100 == 0)).withColumnRenamed("c", "base")
    first = heads.join(sizes.select("c", "base", "taken"), "base").where("at <= taken").select("c", "at", "points", "digest")
    rest = turn.join(sizes.select("c", "h", "taken"), "c").where("at > h").select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "points", "digest")
    return first.unionByName(rest), sizes.select("c", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _key(parts: list[Column], names: tuple[str, str]) -> list[Column]:
    """Two 64-bit numbers of four sums, 32 bits of each."""
    low = [p.bitwiseAND(0xFFFFFFFF) for p in parts]
    return [F.shiftleft(a, 32).bitwiseOR(b).alias(n) for a, b, n in zip(low[::2], low[1::2], names, strict=True)]


def prefixes(turn: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per conversation and depth from 1: key, key of the prefix before, points up to this turn (upto) and before it (before), and the length."""
    halves = lambda w: (F.col(w).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(w, 32))
    own = [x for w in ("w0", "w1") for x in halves(w)]
    rows = turn.select("c", "at", "points", F.col("points").alias("upto"), *[F.xxhash64(F.lit(i + 1), "at", "digest").alias(w) for i, w in enumerate(("w0", "w1"))])
    # sums of 32-bit parts can't overflow
    summed = running(rows.select("*", *[x.alias(p) for x, p in zip(own, _PARTS, strict=True)]), ["c"], ["at"], ["upto", *_PARTS], "prefixes")
    last = [F.col(p) - x for p, x in zip(_PARTS, own, strict=True)]
    keyed = summed.select("c", F.col("at").alias("depth"), *_key([F.col(p) for p in _PARTS], ("ka", "kb")), *_key(last, ("la", "lb")), "upto", (F.col("upto") - F.col("points")).alias("before"))
    return staged(keyed.join(sizes, "c"), "prefix-keys")


def screened(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """`rows` with `maybe` and `maybe_before`: false where the count-min sketch proves that the row's key, or the key before it, occurs once."""
    slot = lambda i, *key: F.pmod(F.xxhash64(F.lit(i), *key), F.lit(width))
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("row"), slot(i, *_KEY).alias("slot")) for i in range(ROWS)])).alias("cell")).select("cell.*")
    twice = staged(cells.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row", "slot"), "sketch")
    found: dict[str, Column] = {}
    for name, key in (("maybe", _KEY), ("maybe_before", [F.col("depth") - 1, "la", "lb"])):
        for i in range(ROWS):
            rows = with_member_flag(rows, slot(i, *key), twice.where(F.col("row") == i), F.col("slot"), f"_{name}{i}", bits=max(width, 1 << 15))
        found[name] = reduce(lambda a, b: a & b, [F.col(f"_{name}{i}") for i in range(ROWS)])
    # before the first turn stands the root
    found["maybe_before"] = found["maybe_before"] | (F.col("depth") == 1)
    return rows.withColumns(found).drop(*[f"_{name}{i}" for name in found for i in range(ROWS)])


def _digest_in_order(members: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, and the SHA-256 of its values in ascending order, joined by commas.

    Values are dealt by ranges of key and value; a range makes one text of its
    part of a key. Parts are then hashed one after another in a stream, so
    nothing holds all values of a key.
    """
    salted = members.withColumn("_row", F.monotonically_increasing_id())
    dealt = staged(salted.repartitionByRange(*key, value, "_row").withColumn("_part", F.spark_partition_id()), "ends")
    parts = dealt.groupBy("_part", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ",").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        out = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in last], pa.array([state.hexdigest()])], names=[*key, "ends_sha256"])
        for batch in batches:
            for *own, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own == last:
                    state.update(b",")
                else:
                    if last is not None:
                        yield out()
                    last, state = own, hashlib.sha256()
                state.update(text.encode())
        if last is not None:
            yield out()

    ordered = parts.select(*key, "_part", "_text").repartition(*key).sortWithinPartitions(*key, "_part")
    return ordered.mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turn, sizes = rebuilt(turns(conversations))
    sizes = staged(sizes, "lengths")
    rows = staged(screened(prefixes(turn, sizes), width), "screened")
    # from the first proven singleton on a conversation is alone
    alone = staged(rows.where("not maybe and maybe_before").groupBy("c").agg(F.min("depth").alias("alone")), "alone")
    doubtful = rows.where("maybe or maybe_before").join(alone, "c", "left")
    shared = staged(doubtful.where("alone is null or depth < alone").drop("alone"), "shared")
    counts = shared.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("m"), F.count_if(F.col("depth") == F.col("length")).alias("ends"))
    counted = staged(shared.join(counts, _KEY), "counted")
    mine, total = F.col("m") == F.col("c"), sizes.agg(F.min("c").alias("root"), F.max("length").alias("deepest")).first()
    if total["root"] is None:
        return _nodes(rows.limit(0).select("c"), c="c")
    root = F.lit(total["root"])
    paths = counted.groupBy("c").agg(
        F.min(F.when(mine, F.col("depth"))).alias("owned"),
        F.max_by("m", F.when(~mine, F.col("depth"))).alias("above"),
        F.max(F.when(~mine, F.col("upto"))).alias("lead"),
        F.coalesce(F.max(mine & (F.col("depth") == F.col("length")) & (F.col("ends") == F.col("n"))), F.lit(False)).alias("tops_out"),
    )
    first = F.col("c") == root
    # from which depth on the conversation owns its path; whose the node before is; points up to there; whether its last node has no children
    paths = sizes.join(paths, "c", "left").join(alone, "c", "left")
    paths = staged(
        paths.select(
            "c", "length", "alone",
            F.when(first, 0).otherwise(F.coalesce("owned", "alone", F.col("length") + 1)).cast("long").alias("owns"),
            F.when(~first, F.coalesce("above", root)).alias("above"),
            F.when(first, 0).otherwise(F.coalesce("lead", F.lit(0))).cast("long").alias("lead"),
            (F.col("alone").isNotNull() | F.coalesce("tops_out", F.lit(False)) | (first & F.lit(total["deepest"] == 0))).alias("leaf"),
        ),
        "paths",
    )
    parent = F.when(F.col("depth") > F.col("owns"), F.col("c")).otherwise(F.col("above"))
    sums = [
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("depth") + 1 >= F.col("owns")) & (F.col("depth") < F.col("length"))).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(F.col("owns") > F.col("depth"), F.col("lead") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    ]
    inner = counted.join(paths.select("c", "owns", "above", "lead", "leaf"), "c").groupBy(*_KEY).agg(F.min("c").alias("conv_id"), F.min(F.when(mine, parent)).alias("parent_conv_id"), *sums)
    everyone = paths.select("c", "owns", "lead", "leaf", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"))
    top = everyone.agg(F.min("c").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *sums).select(*[F.lit(0).cast("long").alias(k) for k in _KEY], "*")
    ends = shared.where("depth = length").select(*_KEY, "c").unionByName(sizes.where("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in _KEY], "c"))
    inner = inner.unionByName(top).join(_digest_in_order(ends, _KEY, "c"), _KEY, "left")
    inner = _nodes(inner.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    # tails: nodes behind a proven one stay where they are, the others ask whose the node before is
    at_end = F.col("depth") == F.col("length")
    own = {"n_convs": F.lit(1), "n_children": (~at_end).cast("long"), "n_leaves": F.lit(1), "saved_tokens": F.lit(0), "ends_sha256": F.when(at_end, F.sha2(F.col("c").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256))}
    behind = _nodes(rows.where("not maybe and not maybe_before"), c="c", parent_conv_id=F.col("c"), **own)
    begins = doubtful.where("depth >= alone").join(paths.select("c", "owns", "above"), "c")
    return inner.unionByName(_nodes(begins, c="c", parent_conv_id=parent, **own)).unionByName(behind)


def _nodes(rows: DataFrame, c: str | None = None, **columns: Column) -> DataFrame:
    """The columns of a node with their types; what is neither given nor there is null."""
    if c:
        columns["conv_id"] = F.col(c)
    kinds = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
    return rows.select(*[(columns.get(n, F.col(n) if n in rows.columns else F.lit(None))).cast(k).alias(n) for n, k in kinds.items()])
