"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models give the probability of each next character: one is
trained on the values that the patterns found (random strings), the other on
tokens of texts without a match (ordinary identifiers) that are too short to be
judged, so that what is judged was not learned as ordinary. A pair of characters
that is rare in training falls back on how often its second one occurs. A token
whose mean log-likelihood ratio per character reaches a threshold is reported,
unless a pattern covers part of it or it is a UUID. The threshold is fitted on
labelled tokens that the models have not seen. Without a labelled secret the
random model is uniform.

Everything is built from SQL functions; a model is one array of numbers by
character pair. Training reads a bounded sample (`SAMPLE_TOKENS` values,
tokens of some `SAMPLE_TEXTS` texts); scanning reads every whole text.

Defined results: a null text is empty and has no spans; rows repeated under one
id are scanned each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, staged, text_of

# The kinds' patterns, the group that is measured and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A cheap test that every text with a match passes.
GATES = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
MARKOV = "markov"
TOKEN = r"[A-Za-z0-9+/_=-]+"
#: Least length of a token that the models judge, and the mean log-likelihood ratio of a secret where there are no labelled ones.
MIN_TOKEN = 20
MIN_RATIO = 0.6
#: Steps of a ratio's unit in fitting the threshold, and how much an ordinary token weighs that is taken for a secret.
STEPS, FALSE_COST = 50, 20
#: Universally unique identifiers name things and open nothing: they are ordinary, however random.
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Weight of a character's own frequency in the frequency of a pair.
BACKOFF = 5.0
SAMPLE_TOKENS = 20_000
SAMPLE_TEXTS = 4_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Matches that are put into one array at a time: lists of any length cost little more than their length.
BLOCK = 256


def matches(text: Column, kind: int, pattern: str, gate: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose `group` has `least` characters: start, kind, end, value.

    Splitting by the pattern gives the stretches between matches, so a running
    sum of lengths gives code-point positions: over blocks of matches first,
    then inside each block.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("hit"), value.alias("value"))
    none = F.array().cast(_SPAN)
    step = lambda row: F.length(row["gap"]) + F.length(row["hit"])

    def upto(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    def add(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(row["value"]) >= least, F.concat(acc["spans"], F.array(span).cast(_SPAN))).otherwise(acc["spans"]).alias("spans"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
    starts = lambda blk: F.aggregate(F.transform(blk, lambda rows: F.aggregate(rows, F.lit(0), lambda n, row: n + step(row))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), upto)["starts"]
    inner = lambda rows, at: F.aggregate(rows, F.struct(at.alias("at"), none.alias("spans")), add)["spans"]
    # the blocks are named once, so that they are cut once
    found = F.flatten(F.flatten(F.transform(F.array(blocks), lambda blk: F.zip_with(blk, starts(blk), inner))))
    return F.when(text.rlike(gate), found).otherwise(none)


def overlaps(span: Column, others: Column) -> Column:
    """Whether a span meets one of `others`, which are in order and apart: by binary search for the last that starts before its end."""
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(others) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = (acc["lo"] < acc["hi"]) & (F.get(others, middle)["start"] < span["end"])
        return F.struct(F.when(before, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(before | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(middle).alias("hi"))

    n = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(others).alias("hi")), halve)["lo"]
    return F.when(F.size(others) == 0, False).otherwise(F.coalesce(F.get(others, n - 1)["end"] > span["start"], F.lit(False)))


def pattern_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, a column of spans for each kind, and base: all of them by start, then kind."""
    out = columns(docs, id_col, text_col).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    spans = [matches(F.col("text"), i, pattern, GATES[kind], group, least) for i, (kind, (pattern, group, least)) in enumerate(KINDS.items())]
    out = out.select("*", *[x.alias(kind) for x, kind in zip(spans, KINDS, strict=True)])
    return out.withColumn("base", F.array_sort(F.concat(*KINDS)))


def _pairs(tokens: DataFrame) -> DataFrame:
    """(label, a, b): the character pairs of (label, token)."""
    at = F.sequence(F.lit(1), F.length("token") - 1)
    pair = F.explode(F.transform(at, lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair")
    rows = tokens.where("length(token) > 1").select("label", pair)
    return rows.select("label", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"))


def train(spans: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratios by pair of characters, in the order of ALPHABET x ALPHABET, and the ratio from which a token is a secret.

    `spans` is (text, base). Three quarters of the labelled tokens train the
    models, the others fit the threshold. The driver receives at most 2 x 67 x
    67 counts, and a histogram of ratios.
    """
    values = spans.where(F.size("base") > 0).select(F.explode("base.value").alias("token")).where(F.length("token") >= 12).distinct()
    secret = values.orderBy(F.xxhash64("token"), "token").limit(SAMPLE_TOKENS).withColumn("label", F.lit(1))
    plain = spans.where(F.size("base") == 0).select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).where(F.length("token").between(6, MIN_TOKEN - 1))
    plain = plain.distinct().orderBy(F.xxhash64("token"), "token").limit(5 * SAMPLE_TOKENS).withColumn("label", F.lit(0))
    tokens = staged(secret.unionByName(plain), "secret-tokens")
    held = F.pmod(F.xxhash64("token", F.lit("held")), F.lit(4)) == 0
    counts = {}
    for label, a, b, n in _pairs(tokens.where(~held)).groupBy("label", "a", "b").count().collect():
        counts[label, a, b] = n
    total = {(t, a): sum(counts.get((t, a, b), 0) for b in ALPHABET) for t in (0, 1) for a in ALPHABET}
    arrive = {(t, b): sum(counts.get((t, a, b), 0) for a in ALPHABET) for t in (0, 1) for b in ALPHABET}
    size = {t: sum(total[t, a] for a in ALPHABET) for t in (0, 1)}

    def log(t: int, a: str, b: str) -> float:
        alone = (arrive[t, b] + 0.5) / (size[t] + 0.5 * len(ALPHABET))
        return math.log((counts.get((t, a, b), 0) + BACKOFF * alone) / (total[t, a] + BACKOFF))

    model = [log(1, a, b) - log(0, a, b) for a in ALPHABET for b in ALPHABET]
    # values may hold characters that tokens can't
    judged = tokens.where(held & F.col("token").rlike(f"^{TOKEN}$"))
    step = F.least(F.greatest(F.floor(ratio(F.col("token"), model) * STEPS), F.lit(-5 * STEPS)), F.lit(5 * STEPS)).cast("int")
    return model, threshold({(r["label"], r["step"]): r["count"] for r in judged.groupBy("label", step.alias("step")).count().collect()})


def threshold(counts: dict[tuple[int, int], int]) -> float:
    """The ratio that least share of held-out secrets misses, with `FALSE_COST` times the share of ordinary tokens that reach it; of several the middle.

    `counts` are tokens by label and ratio in steps; without tokens of both
    labels it is `MIN_RATIO`.
    """
    size = [sum(n for (t, _), n in counts.items() if t == label) for label in (0, 1)]
    if not all(size):
        return MIN_RATIO
    steps = range(-5 * STEPS, 5 * STEPS + 2)
    cost = {c: sum(n for (t, s), n in counts.items() if t == 1 and s < c) / size[1] + FALSE_COST * sum(n for (t, s), n in counts.items() if t == 0 and s >= c) / size[0] for c in steps}
    best = [c for c in steps if cost[c] <= min(cost.values()) + 1e-12]
    # the first run of equally good ones
    run = [c for i, c in enumerate(best) if c - best[0] == i]
    return (run[0] + run[-1]) / 2 / STEPS


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of a token."""
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")
    place = [0] * 128
    for i, c in enumerate(ALPHABET):
        place[ord(c)] = i
    index = F.from_json(F.lit(json.dumps(place)), "array<int>")

    def code(i: Column) -> Column:
        return F.element_at(index, F.ascii(F.substring(token, i, F.lit(1))) + 1)

    def pair(i: Column) -> Column:
        return F.element_at(table, code(i) * len(ALPHABET) + code(i + 1) + 1)

    steps = F.sequence(F.lit(1), F.length(token) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + pair(i)) / (F.length(token) - 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and spans, arrays of (start, kind, end, value) by start, then kind; kind counts KINDS, then markov.

    Positions are code points, ends exclusive. `base` holds the patterns' spans,
    `spans` those and the models'.
    """
    base = pattern_spans(docs, id_col, text_col)
    # ordinary texts are sampled by a hash of id and text, at a share that leaves some SAMPLE_TEXTS of them
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    sampled = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 48)) < int(share * (1 << 48))
    sample = base.select(F.when(F.size("base") > 0, F.lit("")).when(sampled, F.col("text")).alias("text"), "base").where("text is not null")
    model, least = train(staged(sample, "secret-sample"))
    long_token = TOKEN[:-1] + "{%d,}" % MIN_TOKEN
    number = len(KINDS)
    tokens = matches(F.col("text"), number, long_token, long_token, 0, MIN_TOKEN)
    covered = lambda t: overlaps(t, F.col("assign")) | overlaps(t, F.col("access")) | overlaps(t, F.col("hex"))
    fresh = F.filter("tokens", lambda t: ~t["value"].rlike(UUID) & ~covered(t) & (ratio(t["value"], model) >= least))
    rows = base.withColumn("tokens", tokens).select("id", "base", F.when(F.size("tokens") > 0, fresh).otherwise(F.col("tokens")).alias("more"))
    return rows.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, MARKOV]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    at = [*KINDS, MARKOV].index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == at)).cast("long")
