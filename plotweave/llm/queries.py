"""Registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, exact_knn, mixing, near_dedup, packing, prefix_trie, resampling, secrets, sharding, surrogates, token_io, toxicity
from .common import shared_dir, text_of


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _equals(value: str):
    return lambda x: x == value


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace_entities(_documents(spark, sf_dir), key="plotweave")
    kinds = F.transform("_entities", lambda e: e["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).alias(f"n_{k}") for k in surrogates.TYPES]
    return out.select("doc_id", "text", F.size("_entities").alias("n_entities"), *counts)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    counts = [secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of()
    out = sharding.assign_shards(_documents(spark, sf_dir), [1.0] * 24, grown=[1.0] * 25, size=(F.octet_length(text) + 8).cast("long"), text_crc32=F.crc32(text))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"), F.col("_toxic").alias("rejected"))


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_dir(spark)}/plotweave/token-files-{uuid.uuid4().hex}"
    token_io.write_tokens(_documents(spark, sf_dir), folder, tokenizer, end_id=2)
    return token_io.checksums(token_io.read_tokens(spark, folder))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir), percent=85)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("raw"))
    odd = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = vectors.where(F.col("raw").isNotNull() & ~odd).select("vec_id", F.transform("raw", lambda x: F.floor(x * 64)).alias("vec"))
    return exact_knn.top_k(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=5, least_words=20, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer, packed=True).select("doc_id", "n_tokens", "ids")
    digest = F.sha2(F.col("ids"), 256).alias("ids_sha256")
    return bpe.decode(coded, tokenizer).select("doc_id", "n_tokens", digest, F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_secret_scan": op2_secret_scan,
    "op3_mix_sources": op3_mix_sources,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_near_dedup": op7_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_knn": op9_exact_knn,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_resample": op11_resample,
    "op12_bpe": op12_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op9_exact_knn": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b USING (shingle) JOIN n na ON na.doc_id = a.doc_id
      JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n
      HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u),
c AS (SELECT u AS doc_id, min(c) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op13_prefix_trie": r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
  lambda r, x: list_reduce([xor(r, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda v, z: xor(v // 2, 3988292384 * (v % 2)))), 4294967295) % 6 AS h FROM ids),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(o.turns, h.h + 1, len(o.turns))) AS turns
  FROM o JOIN h USING (c) LEFT JOIN o b ON b.c = o.c - o.c % 100),
p AS (SELECT c, d, list_slice(turns, 1, d) AS prefix, d = len(turns) AS ends FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS members,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[d].text) END AS saved, count(*) = count(*) FILTER (ends) AS leaf FROM p GROUP BY d, prefix),
s AS (SELECT v.d, v.prefix, count(*) FILTER (w.leaf) AS n_leaves, sum(w.saved) AS saved_tokens, count(*) FILTER (w.d = v.d + 1) AS n_children
  FROM n v JOIN p q ON q.d = v.d AND q.prefix = v.prefix JOIN n w ON w.conv_id = q.c AND w.d >= v.d
  JOIN p x ON x.c = q.c AND x.d = w.d AND x.prefix = w.prefix GROUP BY v.d, v.prefix)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(n.members) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN n m ON m.d = n.d - 1 AND m.prefix = list_slice(n.prefix, 1, n.d - 1) AND n.d > 0""",
}
