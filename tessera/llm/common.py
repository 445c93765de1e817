"""What several training-data operators share: durable cuts of lineage, bounded batches, word rules, samples."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sampling import smallest

#: The white space of the word contracts, [\x20\x09-\x0D], as Spark, DuckDB and Python patterns take it.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^ \\t\\n\\x0B\\f\\r]+"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so a lost executor costs a reread only.

    The folder is the one the session names in spark.checkpoint.dir. Only where that is unset and the session is
    local, as in tests, a temporary folder stands in; a cluster without the setting is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a folder of its own in the shared folder and read it back: for whole texts."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folders that :func:`stored` wrote for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    top = shared_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("stored-") and folder.rsplit("/", 1)[0].endswith(top.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each that may be broadcast; they are counted first.
BROADCAST_ROWS = 200_000


def bounded(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the broadcast hint if they are at most ``most``; beyond, the join exchanges both sides."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row but maps, which have no order; independent of ``xxhash64`` of the text."""
    plain = [F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(1), *plain)


BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let Arrow batches of texts hold at most ``limit`` bytes (and one row), whatever the texts' lengths.

    A worker holds several copies of its batch, as bytes, lines and results, so the default of 64 MB is more
    than small executors have. This is a setting of the session; one that is lower already stays.
    """
    held = spark.conf.get(_BATCH_SETTING, None)
    if held is None or not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= limit:
        spark.conf.set(_BATCH_SETTING, str(limit))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session, as a number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["SPACE", "WORD_PATTERN", "bound_batches", "bounded", "discard", "durable", "parallelism", "row_hash", "shared_folder", "smallest", "stored", "text_or_empty"]
