"""Retention by anti-joins, shards, and audits that must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unreferenced(keys: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """Rows whose key no reference table has: one union, one anti-join (references: one column each)."""
    union = reduce(DataFrame.union, [r.select(r.columns[0]) for r in references]).toDF("_ref")
    return keys.join(union, F.col(key) == F.col("_ref"), "left_anti")


def eligible(targets: DataFrame, key: str, states: Column | None = None, keep_in: list[DataFrame] = (), drop_in: list[DataFrame] = ()) -> DataFrame:
    """Targets in a state, present in every keep_in and absent from every drop_in (each keyed by its first column)."""
    rows = targets if states is None else targets.where(states)
    for df in keep_in:
        rows = rows.join(df.select(F.col(df.columns[0]).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
    return unreferenced(rows, key, list(drop_in)) if drop_in else rows


def digest_shard(digest: Column) -> Column:
    """The first byte."""
    return F.conv(F.substr(F.hex(digest), F.lit(1), F.lit(2)), 16, 10).cast("int")


def key_shard(key: Column, shards: int = 256) -> Column:
    return F.pmod(key, F.lit(shards))


def aged(rows: DataFrame, observed: str, cutoff) -> DataFrame:
    return rows.where(F.col(observed) <= F.lit(cutoff))


def missing_parents(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def functional_dependency_violations(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def not_contiguous(rows: DataFrame, parent: str, position: str) -> DataFrame:
    """Parents whose positions are not 0..n-1."""
    out = rows.groupBy(parent).agg(F.count("*").alias("n"), F.min(position).alias("first"), F.max(position).alias("last"), F.countDistinct(position).alias("d"))
    return out.where("first <> 0 or last + 1 <> n or d <> n")


def partial_families(seal: DataFrame, members: dict[str, DataFrame], key: str) -> DataFrame:
    """Sealed keys without a row in some member table."""
    rows = seal.select(key)
    for name, df in members.items():
        rows = rows.join(df.select(key, F.lit(True).alias(f"_{name}")).distinct(), key, "left")
    return rows.where(reduce(lambda a, b: a | b, (F.col(f"_{n}").isNull() for n in members))).select(key)
