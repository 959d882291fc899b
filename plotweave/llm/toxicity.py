"""Convolutional text classifier for toxicity, trained here in numpy.

Words are hashed into an embedding table, of which row 0 stands for all words
that too few training rows have, or whose place a more frequent word holds; filters of several widths slide over
the whole text, and each filter's largest response feeds a logistic output. One
embedding dimension starts as the word's class evidence in the training rows.
Training reads a bounded sample of labelled rows (`SAMPLE`, `SAMPLE_WORDS`) in
one task, which sends the model's few megabytes to the driver; scoring runs in
tasks with the model broadcast (its size is fixed by VOCAB and the filters).

Labels are split by crc32 of the id: remainder 2 of 4 is never read, 0 and 3
train, and 1 calibrates the score and the thresholds by language. All rows of
remainder 1, of any length, are scored in tasks; histograms of their scores by
language and class, of fixed size, decide.

Defined results: null texts are empty; a text without words gets the score that
the output's bias gives; without labels of both classes all scores are 0; rows
of one id are scored each by its own text, and training takes the one with the
least hash; labels that contradict each other count as toxic; other columns
are carried along unread, with any names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, staged, text_of, with_member_flag
from .wordhash import hashed_words, slices

VOCAB = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Most rows of each class that training reads, and the most words a row among them may have.
SAMPLE = {1: 2700, 0: 5300}
SAMPLE_WORDS = 20_000
#: Steps of a logit in the histograms, and the logits at their ends.
LOGIT_STEPS, LOGIT_ENDS = 32, 30
#: Toxic rows from which a language has a threshold of its own.
LANGUAGE_ROWS = 10
#: Score from which a text counts as toxic where a language has too few labels for a threshold of its own.
DEFAULT_THRESHOLD = 0.3
#: No language rejects below the first or spares above the second score.
CUTS = (0.2, 0.9)


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words([t.lower() for t in texts], bare=True)


def vocabulary(rows: list[np.ndarray]) -> np.ndarray:
    """The word that holds each row of the embedding table: the most frequent of those hashed to it."""
    words, count = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
    often = count >= (2 if len(rows) < 2000 else 3)
    words, count = words[often], count[often]
    words = words[np.argsort(count, kind="stable")]
    holder = np.zeros(VOCAB, dtype=np.uint64)
    holder[words & np.uint64(VOCAB - 1)] = words  # the last, most frequent, stays
    holder[0] = 0
    return holder


def word_ids(words: np.ndarray, holder: np.ndarray) -> np.ndarray:
    at = (words & np.uint64(VOCAB - 1)).astype(np.int64)
    return np.where(holder[at] == words, at, 0).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Embedding table, filters and output; `scale` and `shift` calibrate the output."""

    holder: np.ndarray | None = None
    table: np.ndarray | None = None
    kernel: list[list[np.ndarray]] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @property
    def tables(self) -> list[list[np.ndarray]]:
        """What each word adds to each filter at each place; made once in a process that scores."""
        if "_tables" not in self.__dict__:
            self.__dict__["_tables"] = [[self.table @ k for k in places] for places in self.kernel]
        return self.__dict__["_tables"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def pooled(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest response of every filter in every text; 0 where a text is shorter than the filter."""
        n = len(offsets) - 1
        res = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            m = len(ids) - w + 1
            if m <= 0:
                continue
            conv = self.tables[k][0][ids[:m]] + self.bias[k]
            for j in range(1, w):
                conv += self.tables[k][j][ids[j : m + j]]
            for j in range(1, w):  # a window must not reach into the next text
                ends = offsets[1:] - j
                conv[ends[(ends >= 0) & (ends < m)]] = 0
            some = np.flatnonzero((np.diff(offsets) > 0) & (offsets[:-1] < m))
            if len(some):
                res[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(conv, offsets[:-1][some], axis=0)
        return np.maximum(res, 0)

    def logits(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.pooled(word_ids(words, self.holder), offsets) @ self.out + self.base

    def text_logits(self, texts: list[str]) -> np.ndarray:
        parts = [self.logits(*word_keys(texts[a:b])) for a, b in slices(texts)]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.out is None:
            return np.zeros(len(texts))
        return _sigmoid(self.text_logits(texts) * self.scale + self.shift)


def _evidence(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Per hashed word: log odds of its document counts between the classes in units of their deviation."""
    pos, neg = np.zeros(VOCAB), np.zeros(VOCAB)
    for ids, t in zip(rows, toxic, strict=True):
        (pos if t else neg)[np.unique(ids)] += 1
    p, n = max(1, toxic.sum()), max(1, len(toxic) - toxic.sum())
    prior = 0.5 + 2 * (pos + neg) / (p + n)  # shrinks words that both classes share
    a, b = pos + prior * p / (p + n), neg + prior * n / (p + n)
    odds = np.log(a / (p + 1)) - np.log(b / (n + 1))
    return odds / np.sqrt(1 / a + 1 / b)


def train(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 16, seed: int = 3) -> Model:
    """Fit filters and output by stochastic gradients; only the positions that win the pooling pass gradients on."""
    rng = np.random.default_rng(seed)
    holder = vocabulary(rows)
    rows = [word_ids(r, holder) for r in rows]
    table = rng.normal(0, 0.1, (VOCAB, DIM)).astype(np.float32)
    table[:, 0] = np.clip(_evidence(rows, toxic) / 3, -2, 4)
    table[0] = 0
    kernel = [[rng.normal(0, 0.1, (DIM, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
    kernel[0][0][0, 0] = 1.0
    bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    out[0] = 2.0
    base = -2.0
    seen_table = np.full(VOCAB, 1e-3)
    seen = {}

    def step(name, value, grad, rate=0.05):
        seen[name] = seen.get(name, 1e-3) + grad**2
        value -= rate * grad / np.sqrt(seen[name])

    for _ in range(epochs):
        for block in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            n = len(block)
            size = len(WIDTHS) * FILTERS
            best, where = np.zeros((n, size), dtype=np.float32), np.full((n, size), -1)
            for i, r in enumerate(block):
                vec = table[rows[r]]
                for k, w in enumerate(WIDTHS):
                    m = len(vec) - w + 1
                    if m <= 0:
                        continue
                    conv = vec[:m] @ kernel[k][0]
                    for j in range(1, w):
                        conv += vec[j : m + j] @ kernel[k][j]
                    top = conv.argmax(0)
                    best[i, k * FILTERS : (k + 1) * FILTERS] = conv[top, np.arange(FILTERS)] + bias[k]
                    where[i, k * FILTERS : (k + 1) * FILTERS] = top
            live = (best > 0) & (where >= 0)
            act = np.where(live, best, 0)
            err = (_sigmoid(act @ out + base) - toxic[block]) / n
            back = np.where(live, err[:, None] * out, 0)
            step("out", out, act.T @ err + 1e-4 * out)
            base -= 0.5 * err.sum()
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                step(("bias", k), bias[k], part.sum(0).astype(np.float32))
                at = where[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    ids = np.array([rows[r][at[i] + j] if at[i][0] >= 0 else np.zeros(FILTERS, dtype=np.int64) for i, r in enumerate(block)])
                    touched.append(ids.ravel())
                    grads.append((part[:, :, None] * kernel[k][j].T[None]).reshape(-1, DIM))
                    step(("kernel", k, j), kernel[k][j], np.einsum("nfd,nf->df", table[ids], part).astype(np.float32))
            ids, slot = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(ids), DIM))
            np.add.at(grad, slot, np.concatenate(grads))
            grad[ids == 0] = 0
            seen_table[ids] += (grad**2).sum(1)
            table[ids] -= (0.02 * grad / np.sqrt(seen_table[ids])[:, None]).astype(np.float32)
    return Model(holder=holder, table=table, kernel=kernel, bias=bias, out=out.astype(np.float32), base=float(base))


def calibrate(model: Model, logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Fit scale and shift of the output on rows that training did not see; `weight` counts rows of equal logit and class."""
    a, b = 1.0, 0.0
    pos, neg = weight[toxic == 1].sum(), weight[toxic == 0].sum()
    if min(pos, neg) >= 3:
        x = np.stack([logits, np.ones(len(logits))], 1)
        # soft targets keep separable rows from driving the scale without bound
        goal = np.where(toxic == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        for _ in range(30):
            p = _sigmoid(a * logits + b)
            grad = x.T @ (weight * (p - goal)) + np.array([1e-2 * (a - 1), 0])
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
            move = np.linalg.solve(hess, grad)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    model.scale, model.shift = max(float(a), 0.05), float(b)


def _best_threshold(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the highest F1, in the middle of the gap in which it lies, but within CUTS."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(weight[order] * toxic[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * toxic).sum())
    best = int(f1.argmax())
    low = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float(np.clip((scores[order[best]] + low) / 2, *CUTS))


def _remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(_remainder(id_col) == 2, F.lit(False))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows of one task: at most SAMPLE rows of SAMPLE_WORDS words."""
    ids, rows, toxic = [], [], []
    for batch in batches:
        words, offsets = word_keys(batch.column("text").to_pylist())
        some = [(i, words[a:b].copy(), t) for i, a, b, t in zip(batch.column("key").to_pylist(), offsets[:-1], offsets[1:], batch.column("toxic").to_pylist(), strict=True) if b - a <= SAMPLE_WORDS]
        for out, column in zip((ids, rows, toxic), zip(*some, strict=True), strict=False):
            out.extend(column)
    order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
    toxic = np.array(toxic, dtype=np.int64)[order]
    model = train([rows[i] for i in order], toxic) if 0 < toxic.sum() < len(toxic) else Model()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _thresholds(scale: float, shift: float):
    """Per language its threshold and how many toxic rows decided it, from its histogram."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        scores = _sigmoid(scale * rows.logit.to_numpy() + shift)
        toxic, weight = rows.toxic.to_numpy().astype(float), rows.n.to_numpy().astype(float)
        return pd.DataFrame({"lang": [rows.lang.iloc[0]], "n": [int((weight * toxic).sum())], "cut": [_best_threshold(scores, toxic, weight)]})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out quarter, and calibrate on all rows of another."""
    bounded_batches(docs.sparkSession)
    known = columns(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (_remainder(id_col) != 2))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = staged(known.withColumn("fold", _remainder("id").cast("int")), "toxic-labels")
    if known.where("fold != 1").select("toxic").distinct().count() < 2:
        return Model()
    own = columns(docs, id_col, text_col, lang_col).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    key = F.xxhash64("id")
    picks = [known.where((F.col("toxic") == t) & (F.col("fold") != 1)).orderBy(key, "id").limit(n) for t, n in SAMPLE.items()]
    # at most the sample's ids: a fixed bound
    pick = F.broadcast(picks[0].unionByName(picks[1]))
    rows = own.join(pick, "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # a bounded sample: one task
    trained = rows.select(key.alias("key"), "toxic", "text").repartition(1).mapInArrow(_train_task, "model binary")
    model = pickle.loads(trained.first()[0])
    if model.out is None:
        return model
    judges = known.where("fold = 1").select("id", "toxic")
    some = with_member_flag(own.where(_remainder("id") == 1), key, judges, key, "labelled").where("labelled")
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.text_logits(texts.tolist()))

    step = F.round(F.greatest(F.lit(-LOGIT_ENDS), F.least(F.lit(LOGIT_ENDS), logit("text"))) * LOGIT_STEPS) / LOGIT_STEPS
    hist = some.select("id", "lang", step.alias("logit")).join(judges, "id").groupBy("lang", "toxic", "logit").agg(F.count(F.lit(1)).alias("n"))
    hist = staged(hist, "toxic-scores")
    held.destroy()
    # one row per step and class, whatever the input
    whole = hist.groupBy("toxic", "logit").agg(F.sum("n").alias("n")).toPandas().sort_values(["logit", "toxic"])
    calibrate(model, whole.logit.to_numpy(), whole.toxic.to_numpy(), whole.n.to_numpy().astype(float))
    cut = _thresholds(model.scale, model.shift)
    model.thresholds = {None: float(x.cut) for x in [cut(whole.assign(lang="")).iloc[0]] if x.n >= LANGUAGE_ROWS}
    # one row per language that has a threshold of its own
    for lang, _, own_cut in hist.groupBy("lang").applyInPandas(cut, "lang string, n long, cut double").where(F.col("n") >= LANGUAGE_ROWS).collect():
        model.thresholds[lang] = own_cut
    return model


def _judged(docs: DataFrame, model: Model, text_col: str, lang_col: str) -> tuple[Column, Column]:
    """The score of a row and whether it reaches its language's threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(texts.tolist()))

    least = F.lit(model.thresholds.get(None, DEFAULT_THRESHOLD))
    for lang, cut in model.thresholds.items():
        if lang is not None:
            least = F.when(F.coalesce(F.col(lang_col).cast("string"), F.lit("")) == lang, cut).otherwise(least)
    return scored(text_of(text_col)), least


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of `docs`, with _score (0 to 1, from the text alone) and _toxic (score at or above the language's threshold).

    Columns that already have these two names are replaced.
    """
    scored, least = _judged(docs, model, text_col, lang_col)
    return docs.withColumn("_score", scored).withColumn("_toxic", F.col("_score") >= least)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs`, all columns as they are, that the classifier does not reject."""
    scored, least = _judged(docs, fit(docs, labels, id_col, text_col, lang_col, label_col), text_col, lang_col)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_pw_row")
    kept = docs.select(row, scored.alias("_pw_score"), least.alias("_pw_least")).where("_pw_score < _pw_least")
    return kept.select(*[F.col("_pw_row")[c].alias(c) for c in docs.columns])
