"""Corpus scans: verdicts per rule, the file tree, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import languages
from tessera.operators import predicates as P
from tessera.operators.ignore import Rule, ignored

RULES = ("outside", "secret", "skipped_dir", "oversized", "rule_ignored", "git", "binary")


def with_verdicts(files: DataFrame, root: str = "/repo", rules: list[Rule] = ()) -> DataFrame:
    """``files`` (file_path, size, content) with a flag per rule and ``ignored``.

    Names and sizes come first; the flag that needs bytes is the last operand, so a scan can leave content out
    by using :func:`named` before reading it.
    """
    path = F.col("file_path")
    flags = files.withColumns(
        {
            "outside": P.escapes_root(path, root),
            "secret": P.is_secret(path),
            "skipped_dir": P.in_skipped_dir(path),
            "oversized": P.is_oversized(F.col("size")),
            "rule_ignored": ignored(path, list(rules)),
            "git": P.under_git(path),
            "binary": P.is_binary(F.col("content")),
        }
    )
    return flags.withColumn("ignored", P.any_of([F.col(r) for r in RULES]))


def named(files: DataFrame, root: str = "/repo", rules: list[Rule] = ()) -> DataFrame:
    """Files that no rule on names or sizes rejects; content is not touched."""
    path = F.col("file_path")
    return files.where(
        ~P.escapes_root(path, root) & ~P.is_secret(path) & ~P.in_skipped_dir(path)
        & ~P.is_oversized(F.col("size")) & ~ignored(path, list(rules)) & ~P.under_git(path)
    )


def discover(files: DataFrame, root: str = "/repo", rules: list[Rule] = ()) -> DataFrame:
    """Files to index: cheap predicates first, then the byte sniff on what is left."""
    return named(files, root, rules).where(~P.is_binary(F.col("content")))


def file_tree(files: DataFrame, max_files: int | None = 500) -> DataFrame:
    """Paths in order, at most ``max_files`` (T9); None for all, by a distributed sort instead of a top-k heap."""
    ordered = files.select("repo", "file_path").orderBy("repo", "file_path")
    return ordered if max_files is None else ordered.limit(max(0, max_files))


def supported(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Files of languages with symbols; the cap counts them alone."""
    found = files.where(languages.has_symbols(F.col("file_path")))
    return found if max_files is None else found.orderBy("repo", "file_path").limit(max(0, max_files))
