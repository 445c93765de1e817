"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; empty for none and for dot files such as .env."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem_parts(path: Column) -> Column:
    """The directories above the file."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def normal(path: Column) -> Column:
    """'.' and empty parts gone, '..' resolved against what precedes it; a leading '..' stays."""
    kept = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def inside(path: Column, root: str) -> Column:
    """Whether the resolved path lies under ``root``; relative paths are taken from there."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    resolved = normal(full)
    return (resolved == F.lit(root.rstrip("/"))) | resolved.startswith(root.rstrip("/") + "/")


def relative(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
