"""Corpus sources: directories, Parquet corpora and fetched blobs as ``source_files`` frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import ids, paths, text
from tessera.operators import ignore
from tessera.operators import predicates as P
from tessera.sources import tree
from tessera.sources.tree import TreeSource

#: Files of a remote tree that one task fetches.
BLOBS_PER_TASK = 64


def mounted(root: str) -> bool:
    return "://" not in root or root.startswith("file://")


def listing(spark: SparkSession, root: str, repo: str | None = None, only: Iterable[str] | None = None, beginning: str = "") -> DataFrame:
    """repo, file_path, ext, size and mtime of every file below ``root``; no file is opened.

    ``only`` names the paths that are asked for, ``beginning`` what they begin with. A mounted tree is walked by the
    ``source_tree`` source, which then looks into their folders alone. Any other store is listed by Spark's binary reader,
    which leaves out names that begin with "_" or "."; its content column is pruned.
    """
    if mounted(root):
        spark.dataSource.register(TreeSource)
        asked = {"beginning": beginning} | ({} if only is None else {"paths": json.dumps(sorted(only))})
        return spark.read.format("source_tree").options(path=root, repo=repo or root, **asked).load()
    found = _binary(spark, root, repo).drop("content", "file_hash").where(F.startswith("file_path", F.lit(beginning)))
    return found if only is None else found.where(F.col("file_path").isin(sorted(only)))


def _binary(spark: SparkSession, root: str, repo: str | None) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = listed.where(F.col("length") <= P.MAX_FILE_BYTES)
    path = paths.relative(F.col("path"), root)
    return found.select(
        F.lit(repo or root).alias("repo"), path.alias("file_path"), F.lower(paths.suffix(path)).alias("ext"),
        F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content",
        F.sha2("content", 256).alias("file_hash"))


def contents(files: DataFrame, root: str, head: int | None = None) -> DataFrame:
    """``files`` (a listing of ``root``, or a part of one) with content and file_hash; only these files are opened."""
    if mounted(root):
        return tree.contents(files, root, head)
    bodies = _binary(files.sparkSession, root, None).select("file_path", "content", "file_hash")
    return files.drop("content", "file_hash").join(bodies, "file_path")


def directory(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Every file below ``root`` with its content; files above the size limit are left out unread."""
    return contents(listing(spark, root, repo).where(F.col("size") <= P.MAX_FILE_BYTES), root)


def table(rows: DataFrame, repo: str, file_path: str, content: str, mtime: float | None = None) -> DataFrame:
    """A corpus that already is a table: names of its columns for repo, path and text or bytes."""
    body = F.col(content).cast("binary")
    return rows.select(
        F.col(repo).cast("string").alias("repo"), F.col(file_path).alias("file_path"),
        F.lower(paths.suffix(F.col(file_path))).alias("ext"), F.octet_length(body).cast("long").alias("size"),
        F.lit(mtime).cast("double").alias("mtime"), body.alias("content"), F.sha2(body, 256).alias("file_hash"))


def fetched(spark: SparkSession, repo: str, listing: Iterable[str], fetch: Callable[[str], bytes | None], max_files: int = 500) -> DataFrame:
    """A remote tree: its paths are cut at ``max_files`` in order, and ``fetch`` runs in the tasks (A4)."""
    chosen = sorted(listing)[: max(0, max_files)]
    parts = max(1, -(-len(chosen) // BLOBS_PER_TASK))
    names = spark.createDataFrame([(p,) for p in chosen], "file_path string").repartition(parts, "file_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(p, fetch(p)) for p in batch.column(0).to_pylist()]
            got = [(p, b) for p, b in got if b is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([b for _, b in got], pa.binary())], names=["file_path", "content"])

    blobs = names.mapInArrow(run, "file_path string, content binary")
    return table(blobs.withColumn("repo", F.lit(repo)), "repo", "file_path", "content")


def with_text(files: DataFrame) -> DataFrame:
    """A2: content as text."""
    return files.withColumn("content", text.decode(F.col("content")))


def root_rules(spark: SparkSession, root: str) -> list[ignore.Rule]:
    """The rules of the root's own ignore files; those deeper down are not read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rules: list[ignore.Rule] = []
    for name in (".gitignore", ".tesseraignore"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            stream = fs.open(path)
            try:
                rules += ignore.parse_rules(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace"))
            finally:
                stream.close()
    return rules


def files_of(source_files: DataFrame, version: str = schemas.INDEX_VERSION) -> DataFrame:
    """The index's own view of a corpus: repo, file_path, file_hash, version."""
    return source_files.select("repo", "file_path", "file_hash", F.lit(version).alias("version"))


def project_keys(projects: DataFrame) -> DataFrame:
    return projects.withColumn("cache_key", ids.cache_key(F.col("project_path")))
