"""Digests of folders (D1-D5, I10): what a listing shows, summed by folder, so that unchanged folders are set aside whole.

A file is seen by its name, size and time; a folder's digest is a sum over its own files, and combines in any order
and any pieces. Only folders whose digest differs from the stored one are compared file by file, and only files
that differ there are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["repo", "file_path"]


def folder() -> Column:
    """The folder of ``file_path``; empty at the root."""
    return F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)


def folder_digests(files: DataFrame) -> DataFrame:
    """repo, folder, files, digest of every folder that has files. ``files``: repo, file_path, size, mtime.

    The digest is two sums of 32 bits of a hash, which cannot overflow below 2 ** 31 files of a folder.
    """
    seen = F.xxhash64("file_path", "size", "mtime")
    halves = [F.sum(x).alias(n) for n, x in (("a", seen.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), ("b", F.shiftrightunsigned(seen, 32)))]
    summed = files.groupBy("repo", folder().alias("folder")).agg(F.count(F.lit(1)).alias("files"), *halves)
    return summed.select("repo", "folder", "files", F.concat_ws(":", "a", "b").alias("digest"))


def changed_folders(now: DataFrame, then: DataFrame) -> DataFrame:
    """repo, folder of the folders that are new, gone or of another digest. Both as :func:`folder_digests` gives them."""
    before = then.select("repo", "folder", F.struct("files", "digest").alias("then"))
    both = now.select("repo", "folder", F.struct("files", "digest").alias("now")).join(before, ["repo", "folder"], "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("repo", "folder")


def suspects(listed: DataFrame, seen: DataFrame, folders: DataFrame) -> DataFrame:
    """Files of changed folders that were not seen before with this size and time: only these need be opened."""
    within = listed.withColumn("folder", folder()).join(folders, ["repo", "folder"], "left_semi").drop("folder")
    known = seen.select(*KEY, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = [within[k] == known[k] for k in KEY] + [within["size"] == known["_size"], within["mtime"] == known["_mtime"]]
    return within.join(known, same[0] & same[1] & same[2] & same[3], "left_anti")


def current(listed: DataFrame, seen: DataFrame, opened: DataFrame) -> DataFrame:
    """repo, file_path, size, mtime, file_hash of every listed file: of ``opened`` ones (suspects) their present hash, of
    the others the one they were seen with."""
    fresh = opened.select(*KEY, F.col("file_hash").alias("_fresh"), F.lit(True).alias("_opened"))
    held = seen.select(*KEY, F.col("file_hash").alias("_held"))
    both = listed.select(*KEY, "size", "mtime").join(fresh, KEY, "left").join(held, KEY, "left")
    return both.select(*KEY, "size", "mtime", F.when(F.col("_opened"), F.col("_fresh")).otherwise(F.col("_held")).alias("file_hash"))
