"""Registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, langid, licenses, mixing, negatives, packing, quality, rules, simhash, suffix_dedup, toxicity
from .common import id_remainder, table

TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, and its special token, whose string in a text becomes its id.
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
SPECIAL = {"<|endoftext|>": 50256}
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _scored(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs.filter(~held_out), labels.filter(~held_out))
    return _scored(toxicity.score(docs, model), held_out, toxicity.THRESHOLD)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 5) == 0
    model = quality.fit(docs.filter(~held_out), labels.filter(~held_out))
    return _scored(quality.score(docs, model), held_out, quality.THRESHOLD)


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_groups(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(licenses.background_sample(docs)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    found = langid.identify(docs, langid.dictionaries(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), tokenizer_path(PIECES))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), SPECIAL)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops = (op1_toxicity, op2_quality, op3_pareto_mix, op4_simhash, op5_exact_dedup, op6_licenses, op7_bpe, op8_language, op9_quality_rules, op10_suffix_dedup, op11_hard_negatives, op12_alignment, op13_packing)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, row_number() OVER () AS rid,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
per0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sizes GROUP BY source),
per1 AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS w_total FROM per0),
per2 AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS w_before
  FROM per1 WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per3 AS (SELECT *, (total - cap_before)::DOUBLE / (w_total - w_before) * weight > cap AS capped FROM per2),
per4 AS (
  SELECT *, (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS cap_sum, (sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::BIGINT AS w_sum
  FROM per3),
per5 AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE (total - cap_sum)::DOUBLE / (w_total - w_sum) * weight END AS target
  FROM per4),
per AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target / source_size::DOUBLE - floor(target / source_size::DOUBLE) ELSE 0 END AS phi
  FROM per5),
squares AS (SELECT source, sum(size::DOUBLE * size) AS squares FROM sizes GROUP BY source),
chances AS (
  SELECT s.doc_id, s.source, s.size, s.rid, s.u, p.source_size, p.target, p.whole, p.phi, p.target - p.whole * p.source_size AS rest,
         s.size * ((p.target - p.whole * p.source_size) / q.squares) AS chance
  FROM sizes s JOIN per p ON s.source IS NOT DISTINCT FROM p.source JOIN squares q ON s.source IS NOT DISTINCT FROM q.source),
odds AS (
  SELECT *, CASE WHEN phi > 0 AND size > 0 THEN CASE WHEN chance >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (chance / (1 - chance)) END END AS odds FROM chances),
ranked AS (
  SELECT *, CASE WHEN odds IS NOT NULL THEN row_number() OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size, rid) END AS place FROM odds),
walk AS (
  SELECT source, any_value(rest) AS gap, 0::BIGINT AS place FROM ranked GROUP BY source
  UNION ALL
  SELECT source, gap, place FROM (
    SELECT w.source, w.gap - r.size AS gap, r.place, row_number() OVER (PARTITION BY w.source ORDER BY r.place) AS n
    FROM walk w JOIN ranked r ON r.source IS NOT DISTINCT FROM w.source AND r.place > w.place AND r.size <= w.gap) WHERE n = 1),
drawn AS (
  SELECT r.*, w.place IS NOT NULL AS taken_first
  FROM ranked r LEFT JOIN walk w ON w.source IS NOT DISTINCT FROM r.source AND w.place = r.place AND w.place > 0),
gaps AS (
  SELECT source, any_value(rest) - sum(CASE WHEN taken_first THEN size ELSE 0 END) AS gap FROM drawn GROUP BY source),
best AS (
  SELECT d.source, arg_min(d.rid, {{'off': abs(d.size - g.gap), 'odds': d.odds, 'id': d.doc_id, 'size': d.size, 'rid': d.rid}}) AS pick
  FROM drawn d JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source
  WHERE g.gap > 0 AND d.phi > 0 AND NOT d.taken_first AND d.size > 0 AND abs(d.size - g.gap) < g.gap GROUP BY d.source)
SELECT d.doc_id, d.size, d.source_size, d.target,
       (d.whole + CASE WHEN d.taken_first OR b.pick IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((d.whole + CASE WHEN d.taken_first OR b.pick IS NOT NULL THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM drawn d LEFT JOIN best b ON d.rid = b.pick
"""

_OP5 = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM rows
"""

_OP9 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR (n_dup_lines > 10 AND 2 * n_dup_lines > n_words / 8)
            OR 2 * len(regexp_extract_all(text, '\p{{Lu}}')) > word_chars OR NOT regexp_matches(text, '\p{{L}}')) AS kept
FROM b
"""

_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER near)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW near AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER near <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force or held-out labels."""
    return {"op3_pareto_mix": _OP3, "op5_exact_dedup": _OP5, "op9_quality_rules": _OP9, "op11_hard_negatives": _OP11}
