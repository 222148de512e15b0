"""Per-file statistics, exclusion policy, content fingerprints and the two arg-max decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    artist_threshold: int = 1
    occurrence_threshold: int = 3


def occurrence_counts(files: DataFrame, role: str | None = None) -> DataFrame:
    """(gallery, file) -> occurrence_count; with a role column, only CONTENT files count."""
    rows = files.where(F.col(role) == "CONTENT") if role else files
    return rows.groupBy("gallery", "file").agg(F.count("*").alias("occurrence_count"))


def artists_of(tags: DataFrame) -> DataFrame:
    """Distinct (gallery, artist) from tags (gallery, namespace, artist)."""
    return tags.where(F.col("namespace") == "artist").select("gallery", "artist").distinct()


def file_decisions(occurrences: DataFrame, artists: DataFrame) -> DataFrame:
    """file -> occurrence_count, artist_count, maximum_gallery_artist_count.

    The occurrence side is summed before and beside the distinct count, so nothing is multiplied: galleries
    learn their artist number first, and only (file, artist) pairs are deduplicated."""
    per_gallery = artists.groupBy("gallery").agg(F.count("*").alias("n_artists"))
    sums = occurrences.join(per_gallery, "gallery", "left").groupBy("file").agg(F.sum("occurrence_count").alias("occurrence_count"), F.max(F.coalesce("n_artists", F.lit(0))).alias("maximum_gallery_artist_count"))
    named = occurrences.select("gallery", "file").join(artists, "gallery").groupBy("file").agg(F.countDistinct("artist").alias("artist_count"))
    out = sums.join(named, "file", "left")
    return out.select("file", "occurrence_count", F.coalesce("artist_count", F.lit(0)).alias("artist_count"), "maximum_gallery_artist_count")


def is_excluded(policy: Policy = Policy()) -> Column:
    """A missing decision is not excluded."""
    most = F.col("maximum_gallery_artist_count")
    rule = (F.col("occurrence_count") >= policy.occurrence_threshold) & (most > 0) & (F.col("artist_count") > policy.artist_threshold * most)
    return F.coalesce(rule, F.lit(False))


def exclusions(decisions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return decisions.withColumn("excluded", is_excluded(policy))


def exclusion_delta(old: DataFrame, new: DataFrame, old_policy: Policy = Policy(), new_policy: Policy = Policy()) -> DataFrame:
    """Files whose exclusion changed, each side under its own policy."""
    a = old.select("file", is_excluded(old_policy).alias("old_excluded"))
    b = new.select("file", is_excluded(new_policy).alias("new_excluded"))
    out = a.join(b, "file", "full").select("file", F.coalesce("old_excluded", F.lit(False)).alias("old_excluded"), F.coalesce("new_excluded", F.lit(False)).alias("new_excluded"))
    return out.where("old_excluded <> new_excluded")


def effective_files(occurrences: DataFrame, decisions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Occurrences without excluded files."""
    return occurrences.join(decisions.where(is_excluded(policy)).select("file"), "file", "left_anti")


def effective_content(occurrences: DataFrame, digest: Column) -> DataFrame:
    """gallery -> content_sha256: SHA-256 over the sorted multiset of its files' hex digests.

    Equal files of a gallery arrive as one row with a count, so a group is as large as its distinct files."""
    rows = occurrences.withColumn("_d", digest).groupBy("gallery").agg(F.array_sort(F.collect_list(F.struct("_d", "occurrence_count"))).alias("_f"))
    joined = F.array_join(F.transform("_f", lambda f: F.repeat(f["_d"], f["occurrence_count"].cast("int"))), "")
    return rows.select("gallery", F.sha2(joined, 256).alias("content_sha256"))


def content_owners(candidates: DataFrame) -> DataFrame:
    """content_sha256 -> owner: greatest (prefer, title_scalars, download_time, gid, scope, locator)."""
    order = F.struct("prefer", "title_scalars", "download_time", "gid", "scope", "locator")
    return candidates.groupBy("content_sha256").agg(F.max_by("gallery", order).alias("owner"))


def gid_candidates(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """Galleries that own their content."""
    return candidates.join(owners.select(F.col("owner").alias("gallery")), "gallery", "left_semi")


def gid_winners(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """gid -> winner among galleries that own their content."""
    order = F.struct("prefer", "title_scalars", "download_time", "scope", "locator")
    return gid_candidates(candidates, owners).groupBy("gid").agg(F.max_by("gallery", order).alias("winner"))


def file_counts(files: DataFrame) -> DataFrame:
    """gallery -> files, bytes, contiguous (positions 0..n-1)."""
    out = files.groupBy("gallery").agg(F.count("*").alias("file_count"), F.sum("size").alias("byte_count"), F.max("position").alias("_last"), F.countDistinct("position").alias("_n"))
    return out.select("gallery", "file_count", "byte_count", ((F.col("_last") + 1 == F.col("file_count")) & (F.col("_n") == F.col("file_count"))).alias("contiguous"))


def snapshot_totals(counts: DataFrame, content: DataFrame) -> DataFrame:
    rows = counts.join(content, "gallery", "left")
    return rows.agg(F.count("*").alias("gallery_count"), F.sum("file_count").alias("file_count"), F.sum("byte_count").alias("byte_count"), F.count("content_sha256").alias("content_present"))


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n <> 1")


def minimum_witness(provenance: DataFrame, key: str, gallery: str = "gallery") -> DataFrame:
    return provenance.groupBy(key).agg(F.min(gallery).alias("witness"))
