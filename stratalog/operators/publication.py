"""Selection, projection, ordering, artifact operations and catalog differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.staging import stage

#: Tag namespaces that name contributors.
CONTRIBUTOR_NAMESPACES = ("artist", "author", "cosplayer", "group", "illustrator", "uploader")


def select_by_joins(members: DataFrame, winners: DataFrame, content: DataFrame, owners: DataFrame) -> DataFrame:
    """(gallery, gid) that win their gid and own their content (or have none)."""
    rows = members.join(winners.select("gid", F.col("winner").alias("gallery")), ["gid", "gallery"])
    rows = rows.join(content, "gallery", "left").join(owners, "content_sha256", "left")
    return rows.where(F.col("content_sha256").isNull() | (F.col("owner") == F.col("gallery"))).select("gallery", "gid")


def select_by_existence(members: DataFrame, winners: DataFrame, content: DataFrame, owners: DataFrame) -> DataFrame:
    """The same by semi- and anti-joins, as an independent evaluation."""
    won = members.join(winners.select("gid", F.col("winner").alias("gallery")), ["gid", "gallery"], "left_semi")
    hashless = won.join(content, "gallery", "left_anti")
    owned = content.join(owners.select("content_sha256", F.col("owner").alias("gallery")), ["content_sha256", "gallery"], "left_semi")
    return hashless.unionByName(won.join(owned, "gallery", "left_semi")).select("gallery", "gid")


def display_title(title: Column, leaf_name: Column) -> Column:
    return F.when(F.length(title) > 0, title).otherwise(leaf_name)


def catalog_order(publications: DataFrame, title: str = "title", key: str = "key", fold: Callable[[Column], Column] = codec.casefold, ranges: int = 0) -> DataFrame:
    """position: dense rank from 0 by (folded title bytes, key).

    A global row number without a global task: rows are range-partitioned and sorted, partitions are counted, and
    each adds the sizes of the ones before (a table with a row for each partition)."""
    n = ranges or int(publications.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = publications.withColumn("sort_title", fold(F.col(title)))
    return row_numbers(rows, ["sort_title", key], n)


def row_numbers(rows: DataFrame, by: list[str], n: int, name: str = "position") -> DataFrame:
    """Range bounds are sampled anew at every execution, so the dealt rows are written once and counted from there."""
    dealt = rows.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id())
    local = stage(dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*by))), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")  # a row a partition
    return out.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def contributors(tags: DataFrame, uploaders: DataFrame | None = None) -> DataFrame:
    """publication, position, name, role: the uploader first, then contributor tags in tag order, first
    occurrence of each (name, role), contiguous positions.

    tags (publication, position, namespace, value); uploaders (publication, uploader)."""
    rows = tags.where(F.col("namespace").isin(*CONTRIBUTOR_NAMESPACES) & (F.length("value") > 0)).select("publication", F.col("position").cast("long").alias("_at"), F.col("value").alias("name"), F.col("namespace").alias("role"))
    if uploaders is not None:
        first = uploaders.where(F.length("uploader") > 0).select("publication", F.lit(-1).cast("long").alias("_at"), F.col("uploader").alias("name"), F.lit("uploader").alias("role"))
        rows = rows.unionByName(first)
    once = rows.groupBy("publication", "name", "role").agg(F.min("_at").alias("_at"))
    at = F.row_number().over(Window.partitionBy("publication").orderBy("_at", "role", "name")) - 1
    return once.withColumn("position", at.cast("long")).select("publication", "position", "name", "role")


def subjects(tags: DataFrame) -> DataFrame:
    """All tags with their original position."""
    return tags.select("publication", "position", "namespace", "value")


def languages(publications: DataFrame, tags: DataFrame) -> DataFrame:
    found = tags.where((F.col("namespace") == "language") & (F.length("value") > 0)).groupBy("publication").agg(F.min_by("value", "position").alias("language"))
    return publications.select("publication").join(found, "publication", "left").select("publication", F.coalesce("language", F.lit("und")).alias("language"))


def member_plan(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every file in order with its excluded flag (METADATA never; a missing decision is no exclusion) and transform."""
    rows = files.join(decisions.select("file", "excluded"), "file", "left")
    flag = F.when(F.col("role") == "METADATA", False).otherwise(F.coalesce("excluded", F.lit(False)))
    kind = F.when(F.col("role") == "METADATA", "RAW_COPY").otherwise(codec.transform_kind(F.col("name")))
    rows = rows.withColumn("excluded", flag).withColumn("transform", kind)
    return rows.withColumn("member_name", codec.archive_member_name(F.col("position"), F.col("role"), F.col("transform"), F.col("excluded")))


def artifact_operations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, semantics) on both sides -> key, operation in CREATE, DELETE, UNCHANGED, REBUILD."""
    a, b = old.select("key", F.col("semantics").alias("_o")), new.select("key", F.col("semantics").alias("_n"))
    kind = F.when(F.col("_o").isNull(), "CREATE").when(F.col("_n").isNull(), "DELETE").when(F.col("_o") == F.col("_n"), "UNCHANGED").otherwise("REBUILD")
    return a.join(b, "key", "full").select("key", kind.alias("operation"))


def artifact_operations_by_existence(old: DataFrame, new: DataFrame) -> DataFrame:
    kind = lambda rows, name: rows.select("key", F.lit(name).alias("operation"))
    same = new.join(old, ["key", "semantics"], "left_semi")
    both = new.join(old.select("key"), "key", "left_semi")
    parts = [kind(new.join(old, "key", "left_anti"), "CREATE"), kind(old.join(new, "key", "left_anti"), "DELETE"), kind(same, "UNCHANGED"), kind(both.join(old, ["key", "semantics"], "left_anti"), "REBUILD")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def carried_artifacts(operations: DataFrame, old_artifacts: DataFrame) -> DataFrame:
    """UNCHANGED publications keep their old artifact."""
    return old_artifacts.join(operations.where("operation = 'UNCHANGED'").select("key"), "key", "left_semi")


def operation_counts(operations: DataFrame) -> DataFrame:
    return operations.groupBy().pivot("operation", ["CREATE", "REBUILD", "DELETE", "UNCHANGED"]).agg(F.count(F.lit(1))).na.fill(0)


def new_and_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    a = new.join(old, "key", "left_anti").select("key", F.lit("NEW").alias("kind"))
    return a.unionByName(old.join(new, "key", "left_anti").select("key", F.lit("REMOVED").alias("kind")))


def changed_items(old: DataFrame, new: DataFrame, scalars: list[str], children: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """Keys on both sides whose scalars or child sets differ; order position and artifact are not compared.

    children: name -> (old rows, new rows, columns).  A side is one struct a key: scalars and sorted children."""

    def whole(rows: DataFrame, side: int) -> DataFrame:
        out = rows.select("key", F.struct(*scalars).alias("_s"))
        for name, parts in children.items():
            lists = parts[side].groupBy("key").agg(F.array_sort(F.collect_set(F.struct(*parts[2]))).alias(f"_c_{name}"))
            out = out.join(lists, "key", "left")
        return out.select("key", F.struct("_s", *(F.col(f"_c_{n}") for n in children)).alias(f"_side{side}"))

    return whole(old, 0).join(whole(new, 1), "key").where(~F.col("_side0").eqNullSafe(F.col("_side1"))).select("key")


def duplicate_losers(members: DataFrame, selected: DataFrame) -> DataFrame:
    return members.join(selected.select("gallery"), "gallery", "left_anti").select("gallery")


def unprepared(operations: DataFrame, prepared: DataFrame) -> DataFrame:
    """CREATE and REBUILD without a prepared artifact of equal facts; empty when covered."""
    need = operations.where(F.col("operation").isin("CREATE", "REBUILD"))
    return need.join(prepared, [c for c in ("key", "semantics") if c in need.columns and c in prepared.columns], "left_anti")


def next_preparation(operations: DataFrame, prepared: DataFrame, n: int = 1) -> DataFrame:
    return unprepared(operations, prepared).orderBy("key").limit(n)
