"""Thin queries over the driver's tables: one for each operator, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm, ngram_join, packing, quality, rules, secret_scan, suffix_dedup, toxicity, wrappers
from .common import crc_mod, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), words=51).drop("spans")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    return judged(quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items", "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 0
    return judged(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 5)
    out = lm.score(table(spark, sf_dir, "documents"), fold != 1, fold == 2)
    return out.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_secret_scans": op3_secret_scans,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_html_extraction": op10_html_extraction,
}

#: Lower-cased words, as the operator takes them.
TOKENS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {TOKENS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({TOKENS}, []) AS ws FROM documents),
grams AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT doc_id, i, grams.n, item FROM grams JOIN wins ON grams.g = wins.g AND grams.n = wins.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(k, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(k, 0) > 0 AND 20 * coalesce(k, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: The others are tested against brute force or on held-out rows: no SQL has their verdicts, or not in time.
ORACLE: dict[str, str] = {"op6_benchmark_decontamination": OP6}
