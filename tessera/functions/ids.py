"""Keys and identities as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def cache_key(project_path: Column) -> Column:
    return F.substr(sha256(project_path), F.lit(1), F.lit(12))


def index_key(repo: Column) -> Column:
    return F.substr(sha256(repo), F.lit(1), F.lit(16))


def chunk_id(file_path: Column, chunk_index: Column) -> Column:
    return sha256(F.concat_ws(":", file_path, chunk_index.cast("string")))


def symbol_id(file_path: Column, kind: Column, name: Column, parent: Column) -> Column:
    return F.concat_ws(":", file_path, kind, F.concat_ws(".", parent, name))


def occurrence_id(file_path: Column, name: Column, start_byte: Column) -> Column:
    return F.concat_ws(":", file_path, F.lit("occurrence"), name, start_byte.cast("string"))


def distinct_ids(symbols: DataFrame) -> DataFrame:
    """The first symbol of an id keeps it, later ones get '@' and their place in bytes."""
    order = Window.partitionBy("repo", "id").orderBy("file_path", "start_byte")
    again = F.row_number().over(order) > 1
    return symbols.withColumn("id", F.when(again, F.concat_ws("@", "id", F.col("start_byte").cast("string"))).otherwise(F.col("id")))
