"""A training corpus from ``documents``: five stages, each written as Parquet and reread as the next one's input.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> secret scan -> packing.  Every stage but
the last returns the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontaminate, ngram_join, packing, rules, secret_scan
from stratalog.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far out in their language and source go."""
    return rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return ngram_join.first_of_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; secrets in their texts are replaced by a mark, and n_chars follows."""
    found = secret_scan.scan(docs)
    text = F.when(F.col("text").isNotNull(), secret_scan.redacted(F.col("text"), F.col("_findings")))
    changed = F.exists("_findings", lambda f: f["secret"])
    out = found.withColumn("n_chars", F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.withColumn("text", F.when(changed, text).otherwise(F.col("text"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed),
]

#: Mahalanobis verdicts, a random forest and a tokenizer are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
