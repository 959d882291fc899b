"""Resampling, BPE and the prefix trie against plain computations."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import DATA, duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.llm import bpe, prefix_trie, queries, resampling

tokenizers = pytest.importorskip("tokenizers")
WORDS, BYTES = (__import__("public_tokenizers").path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- op11


def _features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def _resampled(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in _features(text)[1]:
                counts[_bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        words, features = _features(text)
        weight = sum(gain[_bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    pool = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(pool[: 5 * len(pool) // 100], 1):
        r.append(rank)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=str)


def test_resample_equals_plain_computation_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_resample(spark, f"{DATA}/sf0.001").collect()), key=str)
    assert got == _resampled(docs, target)


def test_resample_odd_rows(spark):
    """Nulls, empty, very long texts, words longer than any table, ties and repeated rows, clashing columns."""
    rng = random.Random(5)
    vocabulary = ["the", "Ünïcode", "x1", "漢字", "a" * 70, "b" * 1000, "Mixed", "of"]
    docs = [(i, " ".join(rng.choices(vocabulary[:6] + ["-", "\x7f", "\0"], k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, None), (None, "one two " * 15), (7, ""), (8, "same words here " * 10), (8, "same words here " * 10), (9, "c" * 200_000 + " d " * 50_000)]
    target = ["the unïcode x1 x1", None, "one two one two"]
    frame = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in docs], DOCS).withColumns({"rank": F.lit("r"), "score": F.lit(1), "_row": F.lit(0), "weight": F.lit(2)})
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == _resampled(docs, target)


def test_resample_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b c", None, None, 0)], DOCS)
    assert resampling.resample(some, none).select("n_features", "rank").collect() == [(6, None)]


def test_bracket_is_widened_and_ties_fill_the_draw(spark, monkeypatch):
    """One score holds nine tenths of the rows; the sketch's first brackets may be anything."""
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, 5).otherwise(F.col("id")).cast("long").alias("score"))
    want = [r.doc_id for r in rows.orderBy(F.desc("score"), "doc_id").limit(150).collect()]
    for brackets in ((1e-9,), (0.002, 0.01), (0.5,)):
        monkeypatch.setattr(resampling, "BRACKETS", brackets)
        got = resampling.draw_top(rows, F.lit(True), percent=15).where("rank is not null").orderBy("rank").collect()
        assert [r.doc_id for r in got] == want and [r["rank"] for r in got] == list(range(1, 151))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 -é漢\n_", max_size=90), min_size=1, max_size=8))
def test_gram_buckets(texts):
    words, grams = resampling._grams(pa.array(texts))
    for i, text in enumerate(texts):
        own, features = _features(text)
        assert words[i] == len(own)
        assert [int(b) for buckets, at in grams for b in buckets[at[i] : at[i + 1]]] == [_bucket(f) for f in features]


# ---- op12


def _library(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return ids, t.decode_batch(ids, skip_special_tokens=False)


ODD = ["", " ", "don't we'll I'M 'S", "ΑΣ ΑΣ. Σ", "İstanbul ſK ﬁ", "é é Å 각 각", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "12 ½ ²３ Ⅷ", "\x00\x1c\x85\xa0 x", "😀👍🏽 ‍﻿", "aaaa" * 20, "x" * 3000, "ab" * 900, "漢字" * 1500, "".join(random.Random(3).choices("abcdefgh", k=5000))]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_bpe_equals_the_library(spark, path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 10_000)) + [(1, None), (None, "null id"), (1, "again"), (1, "again")], "doc_id long, text string"))
    rows = docs.withColumns({"ids": F.lit("clash"), "_pw_text": F.lit("clash"), "n_tokens": F.lit("clash"), "decoded": F.lit(0)})
    got = bpe.decode(bpe.encode(rows, path), path).collect()
    want = _library(path, [r.text or "" for r in got])
    assert [r.ids for r in got] == want[0]
    assert [r.decoded for r in got] == want[1]
    assert [r.n_tokens for r in got] == [len(x) for x in want[0]]
    packed = bpe.decode(bpe.encode(docs, path, packed=True), path).collect()
    assert sorted((r.decoded, bytes(r.ids)) for r in packed) == sorted((t, np.array(i, "<u4").tobytes()) for i, t in zip(*want, strict=True))


def test_bpe_query_digests(spark):
    got = {r.doc_id: r for r in queries.op12_bpe(spark, f"{DATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    assert len(docs) == len(got)
    for d, ids, text in zip(docs, *_library(WORDS, [d.text or "" for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_nulls_unknown_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [400, 99_999_999, -1, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    token = tokenizers.Tokenizer.from_file(WORDS).id_to_token(400)
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, WORDS).collect()} == {1: f"{token} <|endoftext|>", 2: "", 3: ""}
    assert bpe.encode(spark.createDataFrame([], DOCS), WORDS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_bpe_any_text(texts):
    for path in (WORDS, BYTES):
        coder = bpe._coder(bpe.Encoder, path)
        ids, sizes = coder.encode(pa.array(texts, pa.string()))
        want, text = _library(path, texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == want
        assert bpe._coder(bpe.Decoder, path).decode(ids, sizes).to_pylist() == text


def test_merges_out_of_order():
    """A vocabulary in which a merge makes a symbol that an earlier merge already takes on."""
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "abca", "aa", "cabc"])}
    merges = [["abc", "a"], ["b", "c"], ["a", "bc"], ["a", "b"], ["ab", "c"], ["c", "abc"], ["a", "a"]]
    spec = {"type": "BPE", "vocab": vocab, "merges": merges}
    model = tokenizers.Tokenizer(tokenizers.models.BPE(vocab, [tuple(m) for m in merges]))
    merger, rng = bpe.Merger(json.loads(json.dumps(spec))), random.Random(1)
    pieces = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(500)]
    ids, sizes = merger.merge(pieces)
    want = [model.encode(p).ids for p in pieces]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert [merger._by_heap([vocab[c] for c in p]) for p in pieces] == want


# ---- op13


def _trie(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    nodes = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = sorted(c for c in members if len(whole[c]) == len(key))
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def _made(seed, n, texts, most):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in rng.sample(range(3 * n), n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("width", [prefix_trie.WIDTH, 64, 1])
def test_trie_equals_plain_computation(spark, width):
    """With a sketch of any size: all screened, some, none."""
    rows = _made(3, 160, ["hi", "yes", "no", "", None], 7)
    rows += [(5, None, None, "first"), (5, None, "a", "first"), (40, 2, "user", "tie"), (40, 2, "user", "other"), (40, 2, "user", "tie"), (None, 0, "user", "lost")]
    frame = spark.createDataFrame(rows, TURNS).withColumns({"c": F.lit(1), "depth": F.lit("x"), "_at": F.lit(2), "digest": F.lit(3)})
    assert sorted((tuple(r) for r in prefix_trie.trie(frame, width).collect()), key=str) == _trie(rows)


def test_trie_with_turnless_and_long_conversations(spark):
    rows = [(c, 0, "user", "x") for c in range(100, 140)]  # most lose their only turn: conversation 0 is absent at 1..., base 100 has one
    rows += [(c, 0, "user", "x") for c in range(701, 740)]  # base 700 is absent: many are turnless
    rows += [(300, t, "user", "long") for t in range(120)] + [(399, t, "user", "long") for t in range(150)]
    assert sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == _trie(rows)


def test_trie_of_turnless_conversations_only(spark):
    rows = [(c, 0, "u", "x") for c in range(701, 800) if zlib.crc32(str(c).encode()) % 6]
    assert sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == _trie(rows)


def test_trie_empty(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0


def test_trie_same_as_sql(spark):
    assert spark_rows(queries.op13_prefix_trie(spark, f"{DATA}/sf0.01")) == duck_rows(queries.ORACLE_SQL["op13_prefix_trie"], "sf0.01")
