"""Change detection between snapshots, worksets, and delta overlays over an ancestry of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An ancestry of this depth is compacted into a run of its own.
MAX_DEPTH = 16


def changed_galleries(base: DataFrame, target: DataFrame) -> DataFrame:
    """(gallery, observation) snapshots -> gallery, change_kind in ADDED, REPLACED, REMOVED."""
    a, b = base.select("gallery", F.col("observation").alias("_old")), target.select("gallery", F.col("observation").alias("_new"))
    kind = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").when(F.col("_old") != F.col("_new"), "REPLACED")
    return a.join(b, "gallery", "full").select("gallery", kind.alias("change_kind")).where("change_kind is not null")


def changed_files(base_occurrences: DataFrame, target_occurrences: DataFrame, changed: DataFrame) -> DataFrame:
    rows = base_occurrences.select("gallery", "file").unionByName(target_occurrences.select("gallery", "file"))
    return rows.join(changed.select("gallery"), "gallery", "left_semi").select("file").distinct()


def decision_workset(changed: DataFrame, all_files: DataFrame, depth: int) -> DataFrame:
    """At depth 0 every file is decided anew."""
    return changed.unionByName(all_files).distinct() if depth == 0 else changed


def impacted_galleries(changed: DataFrame, flipped: DataFrame, base_occurrences: DataFrame, target_occurrences: DataFrame) -> DataFrame:
    rows = base_occurrences.select("gallery", "file").unionByName(target_occurrences.select("gallery", "file"))
    touched = rows.join(flipped.select("file"), "file", "left_semi").select("gallery")
    return changed.select("gallery").unionByName(touched).distinct()


def impacted_keys(impacted: DataFrame, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old and the new key of each impacted gallery, with the least gallery that caused it."""
    both = old.select("gallery", key).unionByName(new.select("gallery", key)).where(F.col(key).isNotNull())
    return both.join(impacted.select("gallery"), "gallery", "left_semi").groupBy(key).agg(F.min("gallery").alias("witness"))


def overlay_delta(target: DataFrame, parent: DataFrame, key: str, values: list[str], depth: int = 1) -> DataFrame:
    """key, action and values: 'shadow' where target differs, 'tombstone' where it is gone; equal rows drop."""
    a = target.select(key, F.struct(*values).alias("_t"))
    if depth == 0:
        return a.select(key, F.lit("shadow").alias("action"), "_t.*")
    b = parent.select(key, F.struct(*values).alias("_p"))
    rows = a.join(b, key, "full").where(~F.col("_t").eqNullSafe(F.col("_p")))
    return rows.select(key, F.when(F.col("_t").isNull(), "tombstone").otherwise("shadow").alias("action"), "_t.*")


def resolve_overlay(ancestry: DataFrame, deltas: DataFrame, key: str, values: list[str]) -> DataFrame:
    """run, key and values: the nearest ancestor's row, unless it is a tombstone.

    ancestry (run, ancestor, depth); deltas (run, key, action, values).  One aggregate instead of nested
    anti-joins: at equal depth a tombstone wins."""
    steps = ancestry.select(F.col("run").alias("_run"), "ancestor", "depth")
    rows = steps.join(deltas.withColumnRenamed("run", "ancestor"), "ancestor")
    alive = F.col("action") != "tombstone"
    nearest = F.min_by(F.struct(alive.alias("_alive"), *values), F.struct("depth", alive)).alias("_n")
    return rows.groupBy(F.col("_run").alias("run"), key).agg(nearest).where("_n._alive").select("run", key, *(F.col(f"_n.{v}").alias(v) for v in values))


def ancestry_endpoint(ancestry: DataFrame) -> DataFrame:
    return ancestry.groupBy("run").agg(F.max_by("ancestor", "depth").alias("endpoint"), F.max("depth").alias("depth"))


def extend_ancestry(parent: list[tuple[int, str]], run: str, same_policy: bool) -> list[tuple[int, str]]:
    """(depth, run) of a new run: the parent's, one deeper; alone after a policy change or at MAX_DEPTH."""
    if not parent or not same_policy or max(d for d, _ in parent) >= MAX_DEPTH:
        return [(0, run)]
    return [(0, run), *((d + 1, a) for d, a in sorted(parent))]


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with their side: empty if and only if the two are equal as multisets."""
    a, b = left.select(*sorted(left.columns)), right.select(*sorted(left.columns))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def exact_overlay_violations(target: DataFrame, parent: DataFrame, delta: DataFrame, key: str, values: list[str], depth: int = 1) -> DataFrame:
    """Delta rows that are missing, extra or different from what overlay_delta gives."""
    return differences(overlay_delta(target, parent, key, values, depth), delta)
