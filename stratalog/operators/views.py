"""Derived relations of revisions, batches and commits, as joins and computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generation_baseline(base: DataFrame, generations: DataFrame) -> DataFrame:
    """Each (owner, revision) with the generation of its revision; generations (revision, generation)."""
    return base.select("owner", "revision").join(generations.select("revision", "generation"), "revision").select("owner", "revision", "generation")


def generation_head(heads: DataFrame, generations: DataFrame, advanced: DataFrame) -> DataFrame:
    """Each channel's revision, its generation and when it advanced; advanced (channel, advanced_at)."""
    rows = heads.select("channel", "revision").join(generations.select("revision", "generation"), "revision")
    return rows.join(advanced.select("channel", "advanced_at"), "channel").select("channel", "revision", "generation", "advanced_at")


def batch_receipts(stored: DataFrame) -> DataFrame:
    """stored (.., start_generation, start_processed_count, row_count) and what follows from it: an empty batch ends."""
    end = F.col("row_count") == 0
    return stored.select(
        "*",
        (F.col("start_generation") + 1).alias("committed_generation"),
        (F.col("start_processed_count") + F.col("row_count")).alias("next_processed_count"),
        end.cast("int").alias("terminal"),
        F.when(end, "COMPLETE").otherwise("OPEN").alias("next_state"),
    )


def winner_keyset(selected: DataFrame, runs: DataFrame, members: DataFrame, metadata: DataFrame, impacted: DataFrame) -> DataFrame:
    """run, gid, winner: the gid of each selected winner, from the metadata of the observation in the run's build.

    selected (run, winner); runs (run, build); members (build, gallery, observation); metadata (gallery, observation, gid);
    impacted (run, gid)."""
    rows = selected.select("run", "winner", F.col("winner").alias("gallery")).join(runs.select("run", "build"), "run")
    rows = rows.join(members.select("build", "gallery", "observation"), ["build", "gallery"])
    rows = rows.join(metadata.select("gallery", "observation", "gid"), ["gallery", "observation"])
    return rows.join(impacted.select("run", "gid").distinct(), ["run", "gid"], "left_semi").select("run", "gid", "winner")


def commit_baseline(base: DataFrame, commits: DataFrame) -> DataFrame:
    """owner and the revisions and generation of the commit it builds on; base (owner, base_receipt)."""
    told = commits.select(F.col("receipt").alias("base_receipt"), F.col("source_revision").alias("base_source_revision"), F.col("revision").alias("base_revision"), F.col("generation").alias("base_generation"))
    return base.select("owner", "base_receipt").join(told, "base_receipt").select("owner", "base_receipt", "base_source_revision", "base_revision", "base_generation")


def published_descriptors(descriptors: DataFrame, commits: DataFrame, by: str = "revision") -> DataFrame:
    """Descriptors of committed revisions and when they were published."""
    return descriptors.join(commits.select(by, F.col("committed_at").alias("published_at")), by)


def commit_head(heads: DataFrame, commits: DataFrame, sources: DataFrame) -> DataFrame:
    """channel and its head's commit, whose source revision must be of the same channel.

    heads (channel, receipt); commits (receipt, source_revision, ..); sources (source_revision, channel)."""
    rows = heads.select("channel", "receipt").join(commits, "receipt")
    return rows.join(sources.select("source_revision", "channel"), ["source_revision", "channel"], "left_semi")


def head_projection(head: DataFrame) -> DataFrame:
    return head.withColumnRenamed("committed_at", "advanced_at")


def receipts(commits: DataFrame, catalogs: DataFrame, sources: DataFrame, finalized: DataFrame, ended: DataFrame) -> DataFrame:
    """Each commit with its channel, publication count, state, and when its projection ended.

    commits (receipt, revision, source_revision); catalogs (revision, publication_count); sources (source_revision,
    channel); finalized (receipt); ended (receipt, committed_at) of the terminal batch."""
    rows = commits.join(catalogs.select("revision", "publication_count"), "revision").join(sources.select("source_revision", "channel"), "source_revision")
    done = finalized.select("receipt", F.lit(True).alias("_done")).join(ended.select("receipt", F.col("committed_at").alias("_ended")), "receipt", "left")
    rows = rows.join(done, "receipt", "left")
    state = F.when(F.col("_done"), "PROJECTION_FINALIZED").otherwise("DB_COMMITTED")
    return rows.select("receipt", "channel", "revision", "source_revision", "publication_count", state.alias("state"), F.col("_ended").alias("finalized_at"))
