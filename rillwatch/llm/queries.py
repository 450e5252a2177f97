"""The registered queries over the text operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rillwatch.llm import byte_bpe, chat, decontaminate, hard_negatives, language_id, licenses, pii, quality_model, quality_rules, simhash, substring, token_counts, whitening
from rillwatch.llm.tables import read


def op1_preference_pairs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))  # an answer may be NULL
    chosen, rejected = chat.swapped_answers(turns)
    return chat.digests(chat.format_preferences(chosen, rejected, "conv_id"), "conv_id")


def op2_simhash_near_duplicates(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_rules(spark, sf_dir):
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), trusted)


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_personal_data(spark, sf_dir):
    return pii.digests(pii.personal_data(read(spark, sf_dir, "documents")))


def op6_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                 public_tokenizers.PATTERN, keep_ids=False)


def op7_language_id(spark, sf_dir):
    docs, path = read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return language_id.identify(docs, path, language_id.learn(docs, path))


def op8_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))


def op9_remove_repeats(spark, sf_dir):
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, F.col("vec_id") % 50 == 0)


def op12_license_scan(spark, sf_dir):
    return licenses.digests(licenses.license_spans(read(spark, sf_dir, "documents")))


def op13_embedding_whitening(spark, sf_dir):
    """``deviation`` is NULL where it does not fit a long."""
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {f.__name__: f for f in (
    op1_preference_pairs, op2_simhash_near_duplicates, op3_quality_rules, op4_token_counts, op5_personal_data,
    op6_byte_bpe, op7_language_id, op8_quality_classifier, op9_remove_repeats, op10_benchmark_decontamination,
    op11_hard_negatives, op12_license_scan, op13_embedding_whitening)}

#: 64-bit hashes, byte-level tokens, span positions and fitted models are beyond SQL; those queries are held against
#: brute force in tests/llm
ORACLES: dict[str, str] = {
    "op1_preference_pairs": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 answer AS (SELECT conv_id, max(turn) AS spot, max_by(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id),
 swap AS (SELECT a.conv_id, a.spot, b.text AS other FROM answer a JOIN answer b ON a.conv_id = b.conv_id + 1),
 pair AS (SELECT t.*, CASE WHEN turn = spot AND role = 'assistant' THEN other ELSE text END AS other FROM t JOIN swap USING (conv_id)),
 placed AS (SELECT *, row_number() OVER w AS i, min(CASE WHEN text <> other THEN turn END) OVER (PARTITION BY conv_id) AS differ
  FROM pair WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 line AS (SELECT *, differ IS NULL OR turn < differ AS shared, '<|im_start|>' || role || chr(10) AS head,
   '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS r FROM placed),
 spans AS (SELECT *, COALESCE(sum(length(c)) OVER w, 0) + length(head) AS c_at, COALESCE(sum(length(r)) OVER w, 0) + length(head) AS r_at
  FROM line WINDOW w AS (PARTITION BY conv_id, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_chosen, CAST(count(*) AS INTEGER) AS n_rejected, CAST(count(*) FILTER (shared) AS INTEGER) AS n_prefix,
 sha256(COALESCE(string_agg(c, '' ORDER BY i) FILTER (shared), '')) AS prompt_sha256,
 sha256(COALESCE(string_agg(c, '' ORDER BY i) FILTER (NOT shared), '')) AS chosen_sha256,
 sha256(COALESCE(string_agg(r, '' ORDER BY i) FILTER (NOT shared), '')) AS rejected_sha256,
 COALESCE(string_agg(CAST(c_at AS BIGINT) || ':' || CAST(c_at + length(text) + 10 AS BIGINT), ',' ORDER BY i) FILTER (NOT shared AND role = 'assistant'), '') AS chosen_mask,
 COALESCE(string_agg(CAST(r_at AS BIGINT) || ':' || CAST(r_at + length(other) + 10 AS BIGINT), ',' ORDER BY i) FILTER (NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id""",
    "op9_remove_repeats": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
 rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(35)) AS j FROM win JOIN rep USING (k))),
 word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n, 0) AS BIGINT) AS n_removed,
 sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
   CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 positive AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
 n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3""",
}
