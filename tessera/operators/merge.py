"""Mutations as frames: append, upsert, delete, id sets (B1-B4, B7, B8). Writing them is the store's part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows)


def upsert(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the same key replaced, others added. The last of equal keys in ``rows`` is not defined; keep them unique."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows.select(*target.columns))


def delete_files(target: DataFrame, file_paths: list[str]) -> DataFrame:
    """A column comparison, so quotes in a path need no care."""
    return target.where(~F.col("file_path").isin(file_paths)) if file_paths else target


def replace_files(target: DataFrame, rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the touched files (repo, file_path) give way to ``rows``: retract and insert in one step."""
    return target.join(touched.select("repo", "file_path"), ["repo", "file_path"], "left_anti").unionByName(rows.select(*target.columns))


def merge_on_read(rows: DataFrame, gone: DataFrame, key: list[str], version: str = "_at") -> DataFrame:
    """``rows`` without those of a gone key that were written before it went.

    Both carry the ``version`` that wrote them; a key may go and come back any number of times. Keys are combined
    before they are exchanged, and a small side of keys is broadcast by its size as the planner sees it.
    """
    latest = gone.groupBy(*key).agg(F.max(version).alias("_gone"))
    same = [rows[k].eqNullSafe(latest[k]) for k in key]
    met = (rows[version] < latest["_gone"])
    for s in same:
        met = s & met
    return rows.join(latest, met, "left_anti")


def merge_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both have cache_key and alias_paths; the union in order of first sight."""
    more = new.withColumnRenamed("alias_paths", "more")
    joined = old.join(more, "cache_key", "full_outer")
    none = F.array().cast("array<string>")
    return joined.withColumn(
        "alias_paths", F.array_distinct(F.concat(F.coalesce("alias_paths", none), F.coalesce("more", none)))
    ).drop("more")
