"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import (bestfit, decontaminate, langid, licences, linededup, packing, simhash,
                            spelling, substring, tokencount, topk, toxicity, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_decontaminate", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
       FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dp.n, item_id FROM dp JOIN bw
        ON dp.n = bw.n AND array_to_string(w[i:i + dp.n - 1], ' ') = bw.k),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
             CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256
      FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM s""")
def op1(spark, sf_dir):
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"),
                                        _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


@_query("op2_toxicity")
def op2(spark, sf_dir):
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_quality", "p_toxic", F.col("toxic_pred").alias("toxic"))


@_query("op3_licences")
def op3(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.train(docs))
    return found.select("doc_id", "n_paragraphs", F.array_join("licences", ",").alias("licences"),
                        "n_unconfirmed")


@_query("op4_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM p WHERE i + 19 <= len(w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed,
                string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
         FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op4(spark, sf_dir):
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2("kept", 256).alias("kept_sha256"))


@_query("op5_packing")
def op5(spark, sf_dir):
    pieces = packing.pack(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@_query("op6_line_dedup")
def op6(spark, sf_dir):
    kept = linededup.dedupe_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "lines_removed", "lines_kept",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@_query("op7_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND
           len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
             AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op7(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query("op8_token_counts")
def op8(spark, sf_dir):
    return tokencount.section_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


@_query("op9_language_id")
def op9(spark, sf_dir):
    return langid.language_of(_table(spark, sf_dir, "documents"))


@_query("op10_simhash_golay")
def op10(spark, sf_dir):
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, bits=4)


@_query("op11_whitening")
def op11(spark, sf_dir):
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16, scale=64,
                             offset=1_000_000)
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


@_query("op12_best_fit")
def op12(spark, sf_dir):
    pieces = bestfit.pack(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


@_query("op13_spelling", r"""
WITH RECURSIVE crc(k, v, step) AS (
  SELECT k, k, 0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k) UNION ALL
  SELECT k, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1
  FROM crc WHERE step < 8),
bytes AS (SELECT list(v ORDER BY k) AS t FROM crc WHERE step = 8),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
per AS (SELECT doc_id, w, count(*) AS n FROM run GROUP BY ALL),
code AS (SELECT w, n, len(w) AS len, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM per),
sums AS (SELECT w, n, len, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(1, len(x), 2),
             lambda i: CAST(('0x' || x[i:i + 1]) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
         FROM code, bytes),
made AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % len) || substr(w, h % len + 2)
                ELSE w END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE len(word) >= 6
          GROUP BY word HAVING sum(n) >= 5),
pos AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS s FROM pos),
indel AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cut c JOIN words w ON w.word = c.s),
near AS (SELECT word, other, other_n FROM indel UNION ALL SELECT other, word, n FROM indel
         UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN cut b
         ON a.s = b.s AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -other_n, b := other)) AS other,
                max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT word, CASE WHEN other_n >= 5 * n THEN other END AS form, n,
                 CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
                 CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
way(word, root) AS (SELECT word, word FROM forms UNION ALL
  SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM forms f JOIN way w ON w.word = f.word JOIN forms e ON e.word = w.root AND e.form IS NULL""")
def op13(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"))
