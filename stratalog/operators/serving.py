"""Reads pinned to a revision: pages, lookups, nested children and queue eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pinned(head: DataFrame, commits: DataFrame, channel: str, revision: int | None = None) -> DataFrame:
    """The commit of a channel's head, or of the asked revision."""
    rows = commits.where(F.col("channel") == channel)
    if revision is not None:
        return rows.where(F.col("revision") == revision)
    return rows.join(F.broadcast(head.where(F.col("channel") == channel).select("revision").limit(1)), "revision", "left_semi")


def page_by_position(catalog: DataFrame, offset: int, limit: int) -> DataFrame:
    """Positions are dense, so a page is a range filter."""
    return catalog.where((F.col("position") >= offset) & (F.col("position") < offset + limit)).orderBy("position")


def page_filtered(catalog: DataFrame, artifacts: DataFrame, offset: int, limit: int) -> DataFrame:
    """Publications with an artifact, by OFFSET; the total comes along."""
    rows = catalog.join(artifacts.select("key"), "key", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("position").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # total is one row


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a (composite) cursor."""
    if after is not None:
        # the least key bounds the scan; struct comparison would push nothing down
        past = F.lit(False)
        for k, v in reversed(list(zip(keys, after, strict=True))):
            past = (F.col(k) > F.lit(v)) | (F.col(k) == F.lit(v)) & past
        rows = rows.where(F.col(keys[0]) >= F.lit(after[0])).where(past)
    return rows.orderBy(*keys).limit(limit)


def look_ahead(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> tuple[list, bool]:
    """A page and whether more follows."""
    got = keyset_page(rows, keys, after, limit + 1).collect()
    return got[:limit], len(got) > limit


def nested_children(parents: DataFrame, children: DataFrame, key: str, columns: list[str]) -> DataFrame:
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("children"))
    return parents.join(lists, key, "left")


def lookup_names(artifacts: DataFrame, names: list[str], most: int = 128) -> DataFrame:
    """Rows of the asked names in the order of the request, each name once."""
    once = list(dict.fromkeys(names))
    if len(once) > most:
        raise ValueError(f"at most {most} names")
    asked = artifacts.sparkSession.createDataFrame([(n, i) for i, n in enumerate(once)], "name string, _at int")
    return artifacts.join(F.broadcast(asked), "name").orderBy("_at").drop("_at")


def candidate_states(asked: DataFrame, catalog: DataFrame, schedule: DataFrame, removed: DataFrame, deletions: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """gid -> cataloged, redownload_required, requested, in any order.

    asked (gid); catalog (gid, gallery); schedule (gallery, redownload_at); the others (gid)."""
    due = schedule.where(F.col("redownload_at") <= now).select("gallery", F.lit(True).alias("_due"))
    flag = lambda df, name: df.select("gid").distinct().withColumn(name, F.lit(True))
    rows = asked.select("gid").distinct().join(catalog.select("gid", "gallery").withColumn("_cat", F.lit(True)), "gid", "left").join(due, "gallery", "left")
    for df, name in ((removed, "_rem"), (deletions, "_del"), (requests, "_req")):
        rows = rows.join(flag(df, name), "gid", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select("gid", yes("_cat").alias("cataloged"), (yes("_cat") & yes("_due") & ~yes("_rem") & ~yes("_del")).alias("redownload_required"), yes("_req").alias("requested"))


def pending_redownloads(schedule: DataFrame, catalog: DataFrame, removed: DataFrame, deletions: DataFrame, cutoff: int, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """A page of scanned schedule rows with their eligibility; the limit comes before the joins."""
    rows = schedule.where(F.col("redownload_at") <= cutoff)
    page = keyset_page(rows, ["redownload_at", "gallery"], after, limit)
    out = page.join(catalog.select("gallery", "gid"), "gallery", "left")
    out = out.join(removed.select("gid", F.lit(True).alias("_rem")), "gid", "left").join(deletions.select("gid", F.lit(True).alias("_del")), "gid", "left")
    ok = F.col("gid").isNotNull() & F.col("_rem").isNull() & F.col("_del").isNull()
    return out.select("redownload_at", "gallery", "gid", ok.alias("eligible"))


def redownload_page(schedule: DataFrame, catalog: DataFrame, removed: DataFrame, deletions: DataFrame, cutoff: int, after: tuple[int, int] | None, limit: int) -> tuple[list[int], tuple[int, int] | None]:
    """Eligible gids of a page and the cursor of the last row scanned (None at the end)."""
    got = sorted(pending_redownloads(schedule, catalog, removed, deletions, cutoff, after, limit + 1).collect(), key=lambda r: (r.redownload_at, r.gallery))
    page, more = got[:limit], len(got) > limit
    return [r.gid for r in page if r.eligible], (page[-1].redownload_at, page[-1].gallery) if more else None
