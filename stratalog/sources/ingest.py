"""From observations to normalised tables: discovery, dictionaries, matching, assembly, cache and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.publication import row_numbers


def binary_files(spark, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with name, size and content digest; bytes do not leave the scan."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("file_sha256"))


def discovery(locators: DataFrame, locator: str = "locator", ranges: int = 8) -> DataFrame:
    """Each locator's digest and its 0-based position in unsigned digest order."""
    rows = locators.select(locator, F.sha2(F.col(locator).cast("binary"), 256).alias("locator_sha256"))
    return row_numbers(rows, ["locator_sha256"], ranges)


def repeated_locators(locators: DataFrame, locator: str = "locator") -> DataFrame:
    return locators.groupBy(locator).agg(F.count("*").alias("n")).where("n > 1")


def pending(expected: DataFrame, members: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Expected galleries without a linked observation, in order."""
    rows = expected.join(members.select(key), key, "left_anti")
    return rows.orderBy("position").limit(n) if n else rows


def assembly(expected: DataFrame, members: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """expected with observation and statistics, and whether the row is complete."""
    rows = expected.join(members, key, "left").join(stats, key, "left")
    parts = [c for c in rows.columns if c not in expected.columns]
    complete = F.lit(True)
    for c in parts:
        complete = complete & F.col(c).isNotNull()
    return rows.withColumn("complete", complete)


def assembly_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("gallery_count"), F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("file_count"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("long").alias("byte_count"))


def encode_terms(tags: DataFrame, known: DataFrame, ranges: int = 8) -> DataFrame:
    """term_id of each (namespace, value): known ids stay, new terms continue after the greatest."""
    terms = tags.select("namespace", "value").distinct().join(known, ["namespace", "value"], "left")
    last = known.agg(F.coalesce(F.max("term_id"), F.lit(0))).first()[0]
    fresh = row_numbers(terms.where("term_id is null").drop("term_id"), ["namespace", "value"], ranges, "_n")
    return known.select("namespace", "value", "term_id").unionByName(fresh.select("namespace", "value", (F.col("_n") + 1 + last).alias("term_id")))


def allocate(keys: DataFrame, known: DataFrame, key: str, surrogate: str, ranges: int = 8) -> DataFrame:
    """key -> surrogate: resolved where known, else allocated in key order after the greatest."""
    last = known.agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
    fresh = row_numbers(keys.select(key).distinct().join(known, key, "left_anti"), [key], ranges, "_n")
    return known.select(key, surrogate).unionByName(fresh.select(key, (F.col("_n") + 1 + last).cast("long").alias(surrogate)))


def mismatches(left: DataFrame, right: DataFrame, key: str, equal: list[tuple[str, str]]) -> DataFrame:
    """Keys that one side lacks or whose compared columns differ (the FILE and DIRECTORY match)."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    rows = a.alias("a").join(b.alias("b"), key, "full")
    for x, y in equal:
        bad = bad | ~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}"))
    reason = F.when(F.col("_l").isNull(), "left").when(F.col("_r").isNull(), "right").otherwise("differs")
    return rows.where(bad).select(key, reason.alias("missing"))


def cache_lookup(wanted: DataFrame, sources: DataFrame, digests: DataFrame, identity: list[str], fingerprint: str) -> DataFrame:
    """wanted with the cached digest of the same source identity and fingerprint."""
    return wanted.join(sources, [*identity], "left").join(digests, ["source_id", fingerprint], "left")


def cache_insert(cache: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return cache.unionByName(rows.join(cache, keys, "left_anti"))


def insert_or_compare(old: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """old with the new keys, and the conflicts: keys that are there with another value."""
    clash = new.join(old.select(key, F.col(value).alias("_v")), key).where(~F.col(value).eqNullSafe(F.col("_v"))).select(key)
    return old.unionByName(new.join(old, key, "left_anti").select(old.columns)), clash


def read_jdbc(spark, url: str, table: str, key: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A database table as ranges of an integer key, read in parallel."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties={k: str(v) for k, v in options.items()})


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **options) -> None:
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties={k: str(v) for k, v in options.items()})


def metadata_columns(payload: Column) -> Column:
    """A metadata document (JSON) as a struct; unknown fields are dropped, a broken one is null."""
    return F.from_json(payload, "gid long, upload_time long, download_time long, modified_time long, title string, uploader string, comment string")
