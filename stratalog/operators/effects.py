"""Append-only effects, acknowledgement, queue merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .publication import row_numbers


def derive_effects(removed: DataFrame, deletions: DataFrame, emitted: DataFrame, consumed: DataFrame) -> DataFrame:
    """gid, kind: removed gids not yet emitted, then deletion heads never consumed."""
    a = removed.select("gid").join(emitted.select("gid"), "gid", "left_anti").withColumn("kind", F.lit("REMOVED"))
    b = deletions.select("gid", "token").join(consumed.select("token"), "token", "left_anti").select("gid", F.lit("DELETED").alias("kind"))
    return a.unionByName(b)


def sequenced(events: DataFrame, by: list[str], ranges: int, start: int = 0) -> DataFrame:
    """sequence_no, contiguous from start in the order of by."""
    out = row_numbers(events, by, ranges, "sequence_no")
    return out.withColumn("sequence_no", F.col("sequence_no") + start)


def hash_chain(rows: DataFrame, order: str, payload: Column, start: str = "", partition: list[str] | None = None) -> DataFrame:
    """h_i = sha256(h_(i-1) || payload_i) over each partition in order: a sequential audit of one (bounded) batch."""
    groups = rows.groupBy(*(partition or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), payload.alias("p")))).alias("_r"))
    chain = F.aggregate("_r", F.sha2(F.lit(start), 256), lambda h, r: F.sha2(F.concat(h, r["p"]), 256))
    return groups.select(*(partition or []), F.size("_r").cast("long").alias("event_count"), chain.alias("chain_sha256"))


def acknowledged_range(events: DataFrame, through: int, target: int) -> DataFrame:
    """Events that an acknowledgement from ``through`` to ``target`` covers; backward is an error, equal is a replay."""
    if target < through:
        raise ValueError(f"acknowledged through {through}; {target} goes back")
    return events.where(F.col("sequence_no").between(through + 1, target))


def merge_requests(old: DataFrame, new: DataFrame) -> DataFrame:
    """gid, url, token: new tokens replace old ones, an empty new url keeps the old one."""
    a, b = old.select("gid", F.col("url").alias("_u"), F.col("token").alias("_t")), new.select("gid", F.col("url").alias("_nu"), F.col("token").alias("_nt"))
    return a.join(b, "gid", "full").select("gid", F.coalesce(F.nullif("_nu", F.lit("")), F.col("_u"), F.col("_nu")).alias("url"), F.coalesce("_nt", "_t").alias("token"))


def complete_requests(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without those whose exact (gid, token) is done."""
    return requests.join(done, ["gid", "token"], "left_anti")


def clear_missing(missing: DataFrame, found: DataFrame) -> DataFrame:
    return missing.join(found.select("gid"), "gid", "left_anti")


def latest_heads(log: DataFrame) -> DataFrame:
    """gid -> token of its latest generation."""
    return log.groupBy("gid").agg(F.max_by("token", "generation").alias("token"), F.max("generation").alias("generation"))
