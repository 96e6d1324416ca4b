"""Registered queries of this folder and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, mixing, neardup, negatives, packing, pii, quality, tokens, topk, toxicity, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tokenizer file of the packing and counting queries.
TOKENIZER = "word_bpe_49k.json"
#: Key of the surrogates; a deployment sets its own.
SURROGATE_KEY = "corpusloom"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


@query("op1_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10""")
def op1(spark, sf_dir):
    return topk.top_k_inner_product(table(spark, sf_dir, "embeddings"))


@query("op2_ngram_jaccard_join", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each_one a JOIN each_one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
  coalesce(least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)), doc_id) AS component_id,
  (SELECT count(*) FROM links WHERE a = doc_id) AS n_links
FROM sets""")
def op2(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_approximate_nearest_neighbours")
def op4(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query("op6_pii_surrogates")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, SURROGATE_KEY, count_col="n_entities")


@query("op7_warc_transactions", """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""")
def op7(spark, sf_dir):
    return warc.page_records(warc.captures(table(spark, sf_dir, "pages")))


@query("op8_toxicity")
def op8(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_source_mix", f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS.format('text')}), 0) AS size,
    md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, 3 * source_size AS cap, CAST((src - 1) % 3 + 1 AS BIGINT) AS w FROM (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s0)),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s0),
lv AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM s1, t),
g AS (
  SELECT src, source, source_size, total,
    least(CAST(cap AS DOUBLE), (SELECT level FROM lv WHERE level <= cap / w ORDER BY cap / w, src LIMIT 1) * w) AS target FROM lv),
c AS (
  SELECT *, CAST(greatest(1, ceil(total / 1048576)) AS BIGINT) AS block,
    coalesce(sum(target) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo FROM g),
slots AS (SELECT (j * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM (SELECT unnest(range(total // (SELECT any_value(block) FROM c))) AS j FROM t)),
n AS (
  SELECT src, count(*) AS blocks FROM c JOIN slots ON u >= lo / greatest(total, 1) AND u < (lo + target) / greatest(total, 1) WHERE target > 0 GROUP BY src),
o AS (
  SELECT d.*, c.source_size, c.target, coalesce(n.blocks, 0) * c.block AS stop,
    CAST(sum(size) OVER (PARTITION BY c.src ORDER BY key) AS BIGINT) - size AS lo
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN n ON n.src = c.src)
SELECT doc_id, size, source_size, target,
  CAST(list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(size, stop - e * source_size - lo)))) AS BIGINT) AS taken
FROM o""")
def op9(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer())


@query("op11_conversation_trie", r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns,
    list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS inverse
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(inverse, 4294967295) % 4 AS h FROM c),
r AS (
  SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns
  FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, depth, len(turns) = depth AS stops, turns[1:depth] AS node, turns[1:depth - 1] AS up, turns[depth].text AS last FROM m),
n AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN up END) AS up,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) END AS own,
    sha256(coalesce(string_agg(CASE WHEN stops THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM k GROUP BY depth, node),
e AS (SELECT a.*, (SELECT count(*) FROM n b WHERE b.depth = a.depth + 1 AND b.up = a.node) AS n_children FROM n a),
t AS (
  SELECT a.depth, a.node, sum(b.own) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM e a JOIN e b ON b.depth >= a.depth AND b.node[1:a.depth] = a.node GROUP BY a.depth, a.node)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, t.n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN t ON t.depth = e.depth AND t.node = e.node LEFT JOIN e p ON p.depth = e.depth - 1 AND p.node = e.up AND e.depth > 0""")
def op11(spark, sf_dir):
    return trie.prefix_trie(trie.with_shared_heads(trie.conversations(table(spark, sf_dir, "conversations"))))


@query("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3""")
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


@query("op13_near_duplicates", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each_one a JOIN each_one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
    coalesce(least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)), doc_id) AS component_id FROM sets)
SELECT *, doc_id = component_id AS kept FROM c""")
def op13(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))
