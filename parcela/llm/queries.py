"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import bpe, chat, common, convtrie, langid, neardup, negatives, ngrams, packing, sharding, syncmers, toxicity, urlrules, webp

#: Rules of the URL filter: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return syncmers.fingerprints(common.table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.predict(docs, model, "held_out")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048, end_id=0)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = common.table(spark, sf_dir, "documents").withColumn("learns", ~held)
    return ngrams.score(docs).select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return webp.round_trip(common.table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(common.table(spark, sf_dir, "pages"), urlrules.rule_table(spark, RULES))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM h
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels").withColumnRenamed("toxic", "grade")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(common.table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return convtrie.trie(common.table(spark, sf_dir, "conversations"), convtrie.rebuilt)


#: CRC-32 of a decimal number's characters, bit by bit: each byte is taken in, then eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"""
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, len, {_CRC} % 9 AS h FROM (SELECT c, count(*) AS len FROM t GROUP BY c)),
g AS (SELECT h.c, h.h, least(h.h, coalesce(b.len, 0)) AS took FROM h LEFT JOIN h b ON b.c = h.c - h.c % 5),
r AS (
  SELECT g.c, t.i AS d, t.r, t.x FROM g JOIN t ON t.c = g.c - g.c % 5 AND t.i <= g.h
  UNION ALL SELECT g.c, g.took + t.i - g.h, t.r, t.x FROM g JOIN t ON t.c = g.c AND t.i > g.h),
p AS (
  SELECT c, d, strlen(x) AS b, list(struct_pack(r, x)) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, [] FROM g),
m AS (SELECT c, d, b, min(c) OVER (PARTITION BY d, path) AS v, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
nodes AS (SELECT v, d, count(*) AS n, max(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids FROM m GROUP BY v, d),
up AS (SELECT n.v, n.d, m.v AS pv FROM nodes n JOIN m ON m.c = n.v AND m.d = n.d - 1),
kids AS (SELECT pv AS v, d - 1 AS d, count(*) AS k FROM up GROUP BY ALL),
below AS (
  SELECT m.v, m.d, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM nodes u LEFT JOIN kids USING (v, d) JOIN m ON m.c = u.v AND m.d <= u.d GROUP BY m.v, m.d)
SELECT n.v AS conv_id, n.d AS depth, up.pv AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
FROM nodes n LEFT JOIN up USING (v, d) LEFT JOIN kids USING (v, d) JOIN below USING (v, d)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector")))


OP12_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    talks = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    nodes, spans = chat.formatted(talks, ranks, public_tokenizers.PATTERN)
    return chat.read_back(nodes, spans, ranks, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_language_id, op3_best_fit_packing, op4_lm_scoring, op5_lossless_webp, op6_url_filters, op7_toxicity, op8_byte_bpe, op9_minhash_near_dedup, op10_sharding, op11_conversation_prefix_trie, op12_hard_negatives, op13_chat_formatting)}
ORACLE = {"op6_url_filters": OP6_SQL, "op11_conversation_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
