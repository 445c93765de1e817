"""Maintenance as frames over inventories: pruning, aliases, worktrees, ledgers, jobs.

An inventory is a listing that the driver has made; whatever a step needs to know of the disk is a column of
it (null where it could not be read), and the time is a parameter, so reports are pure. Deleting is the
caller's part, behind :func:`tessera.operators.predicates.granted`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import predicates as P

GRACE_S = 3600
TOKENS_PER_SYMBOL = 150
DOLLARS_PER_MILLION = 3.0
EMBED_DOLLARS_PER_MILLION = 0.18
# The reasons and errors that callers read. Reasons: missing_meta, unreadable_meta, missing_chunks,
# project_path_enoent, unreadable_index_json, missing_repo_path_field, repo_path_enoent, orphan_sidecar_json, stale_index_tmp.
CLEAR_REASONS = ("missing_meta", "project_path_enoent", "repo_path_enoent", "missing_repo_path_field")


def orphan_caches(inventory: DataFrame, active: DataFrame, now: float, grace_s: int = GRACE_S) -> DataFrame:
    """Name, reason, bytes, project_path of orphaned cache folders.

    ``inventory``: name, is_dir, is_symlink, has_meta, meta_ok, has_chunks, project_path, project_exists, mtime,
    bytes. ``active``: name. A project whose existence is unknown keeps its cache.
    """
    shaped = inventory.where(
        F.col("name").rlike(P.CACHE_NAME) & F.col("is_dir") & ~F.col("is_symlink") & (F.col("has_meta") | F.col("has_chunks"))
    )
    reason = (
        F.when(~F.col("has_meta"), "missing_meta")
        .when(~F.col("meta_ok"), "unreadable_meta")
        .when(~F.col("has_chunks"), "missing_chunks")
        .when(F.coalesce("project_path", F.lit("")) == "", "unreadable_meta")
        .when(~F.col("project_exists"), "project_path_enoent")
    )
    path = F.when(F.col("has_meta") & F.col("meta_ok"), F.col("project_path"))
    found = shaped.join(active.select("name"), "name", "left_anti").withColumn("reason", reason).where(F.col("reason").isNotNull())
    kept = found.where(F.col("reason").isin(*CLEAR_REASONS) | ~P.recent(F.col("mtime"), now, grace_s))
    return kept.select("name", "reason", "bytes", path.alias("project_path"))


def stale_indexes(inventory: DataFrame, active: DataFrame, now: float, grace_s: int = GRACE_S) -> DataFrame:
    """Name, reason, bytes, repo_path of files of the symbol store to reclaim.

    ``inventory``: name, is_file, is_symlink, json_ok, repo_path (from a verified sidecar, else from the body),
    repo_exists, mtime, bytes. ``active``: repo_path. A stale index takes its sidecar along.
    """
    files = inventory.where(F.col("is_file") & ~F.col("is_symlink"))
    stem = F.regexp_extract("name", r"^(index_[0-9a-f]{16})", 1)
    busy = active.select("repo_path", F.lit(True).alias("busy")).distinct()
    reason = (
        F.when(~F.col("json_ok"), "unreadable_index_json")
        .when(F.coalesce("repo_path", F.lit("")) == "", "missing_repo_path_field")
        .when(F.col("repo_path").startswith("github:"), F.lit(None))
        .when(~F.col("repo_exists"), "repo_path_enoent")
    )
    indexes = files.where(F.col("name").rlike(P.INDEX_NAME)).withColumn("reason", reason).where(F.col("reason").isNotNull())
    indexes = indexes.withColumn("repo_path", F.when(F.col("reason") == "repo_path_enoent", F.col("repo_path")))
    fresh = ~F.col("reason").isin(*CLEAR_REASONS) & P.recent(F.col("mtime"), now, grace_s)
    indexes = indexes.join(busy, "repo_path", "left").where(F.col("busy").isNull() & ~fresh).withColumn("stem", stem)
    sidecars = files.where(F.col("name").rlike(P.SIDECAR_NAME)).withColumn("stem", stem)
    along = sidecars.select("stem", F.col("name").alias("side"), F.col("bytes").alias("side_bytes"))
    companions = indexes.join(along, "stem").select(F.col("side").alias("name"), "reason", F.col("side_bytes").alias("bytes"), "repo_path")
    present = inventory.where(F.col("name").rlike(P.INDEX_NAME)).select(stem.alias("stem"))
    lonely = sidecars.join(present, "stem", "left_anti").join(busy, "repo_path", "left").where(
        F.col("busy").isNull() & ~P.recent(F.col("mtime"), now, grace_s)
    ).select("name", F.lit("orphan_sidecar_json").alias("reason"), "bytes", "repo_path")
    temps = files.where(F.col("name").rlike(P.TEMP_NAME) & ~P.recent(F.col("mtime"), now, grace_s)).select(
        "name", F.lit("stale_index_tmp").alias("reason"), "bytes", F.lit(None).cast("string").alias("repo_path")
    )
    own = indexes.select("name", "reason", "bytes", "repo_path")
    return own.unionByName(companions).unionByName(lonely).unionByName(temps)


def reclaimable(report: DataFrame) -> DataFrame:
    """Files and bytes by reason."""
    return report.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def collect_aliases(meta: DataFrame, existing: DataFrame) -> DataFrame:
    """cache_key, alias_paths with those of missing folders gone; ``existing`` has path (or may be null: unknown)."""
    one = meta.select("cache_key", F.posexplode_outer("alias_paths").alias("pos", "path"))
    alive = one.join(existing.select("path", F.lit(True).alias("alive")).distinct(), "path", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("alive"), F.struct("pos", "path"))))
    return alive.groupBy("cache_key").agg(kept.alias("k")).select("cache_key", F.col("k.path").alias("alias_paths"))


def invalidate_worktrees(paths: DataFrame, meta: DataFrame, sizes: DataFrame, existing: DataFrame) -> DataFrame:
    """Per path what happens: path, cache_key, alias_removed, cache_deleted, bytes_reclaimed, error.

    ``paths``: path, is_symlink. ``meta``: cache_key, project_path, alias_paths. ``sizes``: cache_key, bytes, has_meta
    of the cache folders. ``existing``: path. The cache goes only if the main project is gone and no alias is left.
    """
    alive = existing.select(F.col("path").alias("project_path"), F.lit(True).alias("alive")).distinct()
    keyed = paths.withColumn("cache_key", ids.cache_key(F.col("path")))
    joined = keyed.join(sizes, "cache_key", "left").join(meta.join(alive, "project_path", "left"), "cache_key", "left")
    error = (
        F.when(F.col("is_symlink"), "refused: path is a symlink")
        .when(F.col("bytes").isNull(), "no cache dir found for path")
        .when(~F.coalesce("has_meta", F.lit(False)) | F.col("project_path").isNull(), "no project meta found")
    )
    none = F.array().cast("array<string>")
    removed = F.array_contains(F.coalesce("alias_paths", none), F.col("path"))
    rest = F.filter(F.coalesce("alias_paths", none), lambda a: a != F.col("path"))
    deleted = F.col("alive").isNull() & (F.size(rest) == 0)
    fine = error.isNull()
    return joined.select(
        "path", "cache_key", (fine & F.coalesce(removed, F.lit(False))).alias("alias_removed"), (fine & deleted).alias("cache_deleted"),
        F.when(fine & deleted, F.col("bytes")).otherwise(F.lit(0)).alias("bytes_reclaimed"), error.alias("error"))


def job_histogram(jobs: DataFrame, column: str = "status") -> DataFrame:
    """E14."""
    return jobs.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def job_snapshot(jobs: DataFrame, now: float) -> DataFrame:
    """P10: job_id, tool, status, age and duration in milliseconds."""
    end = F.coalesce("finished_at", F.lit(now))
    return jobs.select(
        "job_id", "tool", "status", ((F.lit(now) - F.col("created_at")) * 1000).cast("long").alias("age_ms"),
        F.when(F.col("started_at").isNotNull(), ((end - F.col("started_at")) * 1000).cast("long")).alias("duration_ms"))


def savings(symbols_returned: int) -> int:
    return symbols_returned * TOKENS_PER_SYMBOL


def cost_avoided(tokens: int) -> float:
    return round(tokens * DOLLARS_PER_MILLION / 1_000_000, 6)


def savings_by(symbols: DataFrame, by: str = "file_path") -> DataFrame:
    """Per group of returned symbols the tokens saved and the cost avoided."""
    saved = symbols.groupBy(by).agg((F.count(F.lit(1)) * TOKENS_PER_SYMBOL).alias("tokens_saved"))
    return saved.withColumn("cost_avoided_usd", F.round(F.col("tokens_saved") * DOLLARS_PER_MILLION / 1e6, 6))


def token_cost(rows: DataFrame, column: str = "content", by: str = "repo") -> DataFrame:
    """Estimated tokens of the texts and what embedding them costs."""
    from tessera.functions.text import token_estimate

    grouped = rows.groupBy(by).agg(F.coalesce(F.sum(token_estimate(F.col(column)).cast("long")), F.lit(0)).alias("tokens"))
    return grouped.withColumn("cost_usd", F.round(F.col("tokens") / 1e6 * EMBED_DOLLARS_PER_MILLION, 9))


class Ledger:
    """Tokens saved, of the session and in all; the total is kept by ``store`` (a pair of functions)."""

    def __init__(self, load=lambda: 0, save=lambda total: None):
        self._save = save
        self.session, self.total = 0, int(load() or 0)

    def record(self, tokens: int) -> None:
        self.session += tokens
        self.total += tokens

    def flush(self) -> None:
        self._save(self.total)

    def meta(self) -> dict:
        return {"session_tokens": self.session, "total_tokens": self.total, "cost_avoided_usd": cost_avoided(self.total)}
