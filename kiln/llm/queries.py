"""Queries of the training-data operators; added to the registry by __spark_entry__ if this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kiln.llm import consensus, leak, lookalike, markup, mixture, pairs, scan, tokens, toxic
from kiln.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found(table(spark, d, "blocks"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.convert(table(spark, d, "blocks"))


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.budget(table(spark, d, "documents"), table(spark, d, "book_catalog"), table(spark, d, "chunks"), table(spark, d, "tokenized_chunks"))


def p3_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_counts(table(spark, d, "documents"), table(spark, d, "book_catalog"), table(spark, d, "chunks"), table(spark, d, "tokenized_chunks"))


def p3_chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.chunk_budget(table(spark, d, "book_catalog"), table(spark, d, "chunks"), table(spark, d, "tokenized_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(table(spark, d, "judge_adjudication"))


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "judge_adjudication"))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "judge_adjudication"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.noise(table(spark, d, "chunks"), table(spark, d, "audit_log"), table(spark, d, "book_catalog"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan.repaired(table(spark, d, "chunks"), table(spark, d, "audit_log"), table(spark, d, "book_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "questions"), table(spark, d, "semantic_scores"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "chunks"), table(spark, d, "query_entities"))


def p7_titles(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.titled(table(spark, d, "query_entities"), table(spark, d, "entity_titles"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leak.report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxic.found(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxic.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxic.rates(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"p3_chunk_budget": P3_CHUNK_BUDGET, "p4_agreement": P4_AGREEMENT}


P3_CHUNK_BUDGET = """
WITH one AS (SELECT chunk_id, max(book) AS book, max(lang) AS lang FROM chunks GROUP BY chunk_id),
o AS (SELECT chunk_id, max_by(o200k_tokens, (counted_at, o200k_tokens)) AS o200k FROM tokenized_chunks WHERE o200k_tokens > 0 GROUP BY chunk_id),
b AS (SELECT chunk_id, max_by(bge_tokens, (counted_at, bge_tokens)) AS bge FROM tokenized_chunks WHERE bge_tokens > 0 GROUP BY chunk_id)
SELECT c.source, coalesce(one.lang, c.lang) AS lang, c.topic, count(*) AS n_chunks, count(o200k) AS n_o200k, count(bge) AS n_bge,
  sum(o200k)::BIGINT AS o200k_tokens, sum(bge)::BIGINT AS bge_tokens
FROM one LEFT JOIN book_catalog c USING (book) LEFT JOIN o USING (chunk_id) LEFT JOIN b USING (chunk_id)
GROUP BY 1, 2, 3
"""

P4_AGREEMENT = """
WITH latest AS (SELECT item_id, max_by(judge_flags, judged_at) AS f FROM judge_adjudication WHERE judge_flags IS NOT NULL GROUP BY item_id),
each AS (SELECT item_id, unnest(map_keys(f)) AS name, unnest(map_values(f)) AS flag FROM latest),
named AS (SELECT item_id, regexp_replace(name, ' run[0-9]+$', '') AS judge, coalesce(try_cast(regexp_extract(name, ' run([0-9]+)$', 1) AS INT), 1) AS run, flag FROM each WHERE flag IS NOT NULL),
votes AS (SELECT item_id, judge, min_by(flag, run) AS flag FROM named GROUP BY item_id, judge),
per AS (SELECT item_id, count(*) FILTER (flag)::DOUBLE AS yes, count(*) FILTER (NOT flag)::DOUBLE AS no FROM votes GROUP BY item_id HAVING count(*) >= 2),
s AS (SELECT count(*) AS n_items, sum(yes + no) AS n, sum(yes) AS y, sum(no) AS z, sum(2 * yes * no / (yes + no - 1)) AS pairs FROM per)
SELECT n_items, n::BIGINT AS n_votes, round(1 - pairs / n / (2 * y * z / (n * (n - 1))), 6) AS alpha FROM s
"""
