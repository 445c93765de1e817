"""Change detection and staleness: joins of the present files with what an index holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["repo", "file_path"]


def detect_changes(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Every path of either side as new, changed, deleted or same. Both: repo, file_path, file_hash."""
    now, then = current.withColumnRenamed("file_hash", "now"), indexed.withColumnRenamed("file_hash", "then")
    joined = now.withColumn("here", F.lit(True)).join(then.withColumn("known", F.lit(True)), KEY, "full_outer")
    status = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("here").isNull(), "deleted")
        .when(F.col("now").eqNullSafe(F.col("then")), "same")
        .otherwise("changed")
    )
    return joined.select(*KEY, status.alias("status"))


def pending_files(current: DataFrame, indexed: DataFrame, zero_chunk: DataFrame) -> DataFrame:
    """Files to index: hash unknown or different, and not known, at this hash, to yield no chunks."""
    rest = current.join(zero_chunk.select(*KEY, "file_hash"), [*KEY, "file_hash"], "left_anti")
    known = indexed.withColumnRenamed("file_hash", "known_hash")
    return rest.join(known, KEY, "left").where(~F.col("file_hash").eqNullSafe(F.col("known_hash"))).select(*KEY, "file_hash")


def in_order(files: DataFrame) -> DataFrame:
    """Pending and zero-chunk files ascending."""
    return files.orderBy(*KEY)


def stale_indexed(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """D3, U4: indexed files that are gone."""
    return indexed.select(*KEY).distinct().join(current.select(*KEY), KEY, "left_anti")


def never_indexed(current: DataFrame, indexed: DataFrame, zero_chunk: DataFrame) -> DataFrame:
    """Present files that neither the index nor the zero-chunk set knows."""
    return current.select(*KEY).join(indexed, KEY, "left_anti").join(zero_chunk, KEY, "left_anti")


def staleness_suspects(current: DataFrame, indexed: DataFrame, last_indexed: float) -> DataFrame:
    """Files touched since the last indexing whose hash differs from the stored one."""
    touched = current.where(F.col("mtime") > F.lit(last_indexed))
    known = indexed.withColumnRenamed("file_hash", "known_hash")
    return touched.join(known, KEY, "left").where(~F.col("file_hash").eqNullSafe(F.col("known_hash"))).select(*KEY)


def staleness(current: DataFrame, indexed: DataFrame, zero_chunk: DataFrame, last_indexed: float) -> DataFrame:
    """One row per reason to refresh a repository, as counts: never_indexed, deleted, modified."""
    parts = [
        never_indexed(current, indexed, zero_chunk).select("repo", F.lit("never_indexed").alias("reason")),
        stale_indexed(indexed, current).select("repo", F.lit("deleted").alias("reason")),
        staleness_suspects(current, indexed, last_indexed).select("repo", F.lit("modified").alias("reason")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("repo", "reason").count()


def flag_stale(rows: DataFrame, indexed: DataFrame, current: DataFrame, oversized: Column | None = None) -> DataFrame:
    """``rows`` with is_stale: the file is missing, too large, or of another hash than when indexed."""
    known = indexed.select(*KEY, F.col("file_hash").alias("known_hash"))
    large = F.lit(False) if oversized is None else oversized
    now = current.select(*KEY, F.col("file_hash").alias("now_hash"), large.alias("too_large"))
    joined = rows.join(known, KEY, "left").join(now, KEY, "left")
    fresh = F.coalesce(F.col("known_hash") == F.col("now_hash"), F.lit(False)) & ~F.coalesce("too_large", F.lit(True))
    return joined.withColumn("is_stale", ~fresh).drop("known_hash", "now_hash", "too_large")
