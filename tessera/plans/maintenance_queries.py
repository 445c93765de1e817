"""Queries of maintenance, ledgers and change streams, over inventories derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import maintenance, merge, predicates
from tessera.plans import views
from tessera.session import table
from tessera.sources import store
from tessera.streaming import changes

NOW = 100_000.0


def _caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache folders: one per document, healthy or broken by its number."""
    n = F.col("doc_id")
    return views.corpus(spark, sf_dir).select(
        "doc_id", F.when(n % 9 == 0, F.concat(F.lit("other"), n.cast("string"))).otherwise(ids.cache_key(F.col("file_path"))).alias("name"),
        (n % 8 != 0).alias("is_dir"), (n % 15 == 0).alias("is_symlink"), (n % 5 != 1).alias("has_meta"), (n % 5 != 2).alias("meta_ok"),
        (n % 4 != 3).alias("has_chunks"), F.when(n % 14 != 2, F.col("file_path")).alias("project_path"),
        F.when(n % 6 != 5, n % 3 != 1).alias("project_exists"), F.col("mtime"), F.col("size").alias("bytes"))


def prune_orphans_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _caches(spark, sf_dir).where("doc_id % 37 = 4").select("name")
    return maintenance.orphan_caches(_caches(spark, sf_dir), active, NOW)


def prune_orphans_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.reclaimable(prune_orphans_report(spark, sf_dir))


def cache_shaped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17."""
    return _caches(spark, sf_dir).agg(F.count_if(F.col("name").rlike(predicates.CACHE_NAME)).alias("dirs_examined"))


def _index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a symbol store: indexes, sidecars, staging files and strangers; doc 2k+1 is the sidecar of doc 2k."""
    n = F.col("doc_id")
    key = F.substring(F.sha2(F.floor(n / 2).cast("string"), 256), 1, 16)
    name = (
        F.when(n % 22 == 21, F.concat(F.lit("index_"), key, F.lit(".meta.12.0123abcd.tmp")))
        .when(n % 22 == 19, F.concat(F.lit("index_"), key, F.lit(".lock")))
        .when(n % 26 == 0, F.concat(F.lit("index_"), key, F.lit(".tmp")))
        .when(n % 2 == 1, F.concat(F.lit("index_"), key, F.lit(".meta.json")))
        .otherwise(F.concat(F.lit("index_"), key, F.lit(".json")))
    )
    repo = F.when(n % 14 == 2, F.lit("")).when(n % 14 == 4, F.concat(F.lit("github:a/b"), n.cast("string"))).otherwise(F.concat(F.lit("/r/"), F.floor(n / 2).cast("string")))
    return views.corpus(spark, sf_dir).select(
        "doc_id", name.alias("name"), (n % 17 != 0).alias("is_file"), (n % 19 == 0).alias("is_symlink"), (n % 10 != 6).alias("json_ok"),
        F.when(n % 10 != 6, repo).alias("repo_path"), F.when(n % 16 != 8, n % 6 == 0).alias("repo_exists"), F.col("mtime"), F.col("size").alias("bytes"))


def prune_symbols_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _index_files(spark, sf_dir).where("doc_id % 23 = 5").select("repo_path")
    return maintenance.stale_indexes(_index_files(spark, sf_dir), active, NOW)


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.corpus(spark, sf_dir)
    n = F.col("doc_id").cast("string")
    names = F.array(F.concat(F.lit("/w/a"), n), F.concat(F.lit("/w/b"), n), F.concat(F.lit("/w/a"), n))
    return docs.select(
        "doc_id", ids.cache_key(F.concat(F.lit("/w/a"), n)).alias("cache_key"), F.concat(F.lit("/p/"), n).alias("project_path"), F.col("mtime").alias("updated_at"),
        F.array_distinct(F.slice(names, 1, F.when(F.col("doc_id") % 4 == 2, 2).otherwise(1))).alias("alias_paths"))


def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened: old aliases, then unseen new ones."""
    old = _meta(spark, sf_dir).select("cache_key", "alias_paths")
    n = F.col("doc_id").cast("string")
    new = _meta(spark, sf_dir).where("doc_id % 3 = 0").select("cache_key", F.array(F.concat(F.lit("/w/c"), n), F.concat(F.lit("/w/a"), n)).alias("alias_paths"))
    merged = merge.merge_aliases(old, new)
    return merged.select("cache_key", F.posexplode("alias_paths").alias("pos", "path"))


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    docs = views.corpus(spark, sf_dir)
    return docs.where("doc_id % 3 <> 1").select(F.concat(F.lit("/w/b"), n).alias("path")).unionByName(docs.where("doc_id % 5 = 0").select(F.concat(F.lit("/w/a"), n).alias("path"))).unionByName(docs.where("doc_id % 4 = 0").select(F.concat(F.lit("/p/"), n).alias("path")))


def alias_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintenance.collect_aliases(_meta(spark, sf_dir), _existing(spark, sf_dir))
    return kept.select("cache_key", F.posexplode("alias_paths").alias("pos", "path"))


def worktree_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.corpus(spark, sf_dir)
    paths = docs.select(F.concat(F.lit("/w/a"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 13 == 0).alias("is_symlink"))
    sizes = docs.where("doc_id % 7 <> 3").select(ids.cache_key(F.concat(F.lit("/w/a"), F.col("doc_id").cast("string"))).alias("cache_key"), F.col("size").alias("bytes"), (F.col("doc_id") % 2 == 0).alias("has_meta"))
    return maintenance.invalidate_worktrees(paths, _meta(spark, sf_dir).drop("doc_id", "updated_at"), sizes, _existing(spark, sf_dir))


def recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = _existing(spark, sf_dir).select(F.col("path").alias("project_path"))
    return store.recent_projects(_meta(spark, sf_dir), existing, 20).select("project_path", "updated_at")


def verified_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.col("file_path")
    names = F.concat(F.lit("index_"), F.when(F.col("doc_id") % 3 == 0, F.lit("0123456789abcdef")).otherwise(ids.index_key(repo)), F.lit(".meta.json"))
    return store.verified_sidecars(views.corpus(spark, sf_dir).select(names.alias("file_name"), repo.alias("repo_path")))


def job_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.job_histogram(table(spark, sf_dir, "events"), "event_type")


def job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(
        n.cast("string").alias("job_id"), F.col("event_type").alias("tool"), F.lit("running").alias("status"), (n % 5000).cast("double").alias("created_at"),
        F.when(n % 3 != 0, (n % 5000 + 2).cast("double")).alias("started_at"), F.when(n % 2 == 0, (n % 5000 + 10).cast("double")).alias("finished_at"))
    return maintenance.job_snapshot(jobs, 6000.0).fillna(-1, ["duration_ms"])


def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    bursts = changes.debounced(events, "user_id", gap="5 minutes")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_ts", "edge_ts")}
    return bursts.withColumns(shown)


def stream_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances after the events: an error deletes, anything else sets the value."""
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return changes.apply_changes(target, events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", ["value"])


C = f"WITH {views.CORPUS_SQL}"
CACHES = f"""{C}, caches AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'other' || doc_id::VARCHAR ELSE substr(sha256(file_path), 1, 12) END AS name, doc_id % 8 <> 0 AS is_dir,
    doc_id % 15 = 0 AS is_symlink, doc_id % 5 <> 1 AS has_meta, doc_id % 5 <> 2 AS meta_ok, doc_id % 4 <> 3 AS has_chunks,
    CASE WHEN doc_id % 14 <> 2 THEN file_path END AS project_path, CASE WHEN doc_id % 6 <> 5 THEN doc_id % 3 <> 1 END AS project_exists, mtime, size AS bytes FROM corpus),
why AS (
  SELECT *, CASE WHEN NOT has_meta THEN 'missing_meta' WHEN NOT meta_ok THEN 'unreadable_meta' WHEN NOT has_chunks THEN 'missing_chunks'
    WHEN coalesce(project_path, '') = '' THEN 'unreadable_meta' WHEN NOT project_exists THEN 'project_path_enoent' END AS reason
  FROM caches WHERE regexp_matches(name, '^[0-9a-f]{{12}}$') AND is_dir AND NOT is_symlink AND (has_meta OR has_chunks)
    AND name NOT IN (SELECT name FROM caches WHERE doc_id % 37 = 4)),
orphans AS (
  SELECT name, reason, bytes, CASE WHEN has_meta AND meta_ok THEN project_path END AS project_path FROM why
  WHERE reason IS NOT NULL AND (reason IN ('missing_meta', 'project_path_enoent') OR NOT 100000 - mtime < 3600))"""
INDEXES = f"""{C}, inv AS (
  SELECT doc_id, 'index_' || substr(sha256((doc_id // 2)::VARCHAR), 1, 16) AS stem,
    CASE WHEN doc_id % 22 = 21 THEN '.meta.12.0123abcd.tmp' WHEN doc_id % 22 = 19 THEN '.lock' WHEN doc_id % 26 = 0 THEN '.tmp' WHEN doc_id % 2 = 1 THEN '.meta.json' ELSE '.json' END AS tail,
    doc_id % 17 <> 0 AS is_file, doc_id % 19 = 0 AS is_symlink, doc_id % 10 <> 6 AS json_ok,
    CASE WHEN doc_id % 10 = 6 THEN NULL WHEN doc_id % 14 = 2 THEN '' WHEN doc_id % 14 = 4 THEN 'github:a/b' || doc_id::VARCHAR ELSE '/r/' || (doc_id // 2)::VARCHAR END AS repo_path,
    CASE WHEN doc_id % 16 <> 8 THEN doc_id % 6 = 0 END AS repo_exists, mtime, size AS bytes FROM corpus),
act AS (SELECT DISTINCT repo_path FROM inv WHERE doc_id % 23 = 5 AND repo_path IS NOT NULL),
fl AS (SELECT *, 100000 - mtime < 3600 AS fresh FROM inv WHERE is_file AND NOT is_symlink),
ix AS (
  SELECT stem, stem || tail AS name, reason, bytes, CASE WHEN reason = 'repo_path_enoent' THEN repo_path END AS repo_path, fresh FROM (
    SELECT *, CASE WHEN NOT json_ok THEN 'unreadable_index_json' WHEN coalesce(repo_path, '') = '' THEN 'missing_repo_path_field'
      WHEN starts_with(repo_path, 'github:') THEN NULL WHEN NOT repo_exists THEN 'repo_path_enoent' END AS reason FROM fl WHERE tail = '.json')
  WHERE reason IS NOT NULL),
st AS (SELECT * FROM ix WHERE (repo_path IS NULL OR repo_path NOT IN (SELECT repo_path FROM act)) AND (reason IN ('repo_path_enoent', 'missing_repo_path_field') OR NOT fresh))
SELECT name, reason, bytes, repo_path FROM st
UNION ALL SELECT f.stem || f.tail, s.reason, f.bytes, s.repo_path FROM st s JOIN fl f ON f.stem = s.stem AND f.tail = '.meta.json'
UNION ALL SELECT stem || tail, 'orphan_sidecar_json', bytes, repo_path FROM fl WHERE tail = '.meta.json' AND NOT fresh
  AND stem NOT IN (SELECT stem FROM inv WHERE tail = '.json') AND (repo_path IS NULL OR repo_path NOT IN (SELECT repo_path FROM act))
UNION ALL SELECT stem || tail, 'stale_index_tmp', bytes, NULL FROM fl WHERE ends_with(tail, '.tmp') AND NOT fresh"""
META = f"""{C}, meta AS (
  SELECT doc_id, substr(sha256('/w/a' || doc_id::VARCHAR), 1, 12) AS cache_key, '/p/' || doc_id::VARCHAR AS project_path, mtime AS updated_at,
    CASE WHEN doc_id % 4 = 2 THEN ['/w/a' || doc_id::VARCHAR, '/w/b' || doc_id::VARCHAR] ELSE ['/w/a' || doc_id::VARCHAR] END AS alias_paths FROM corpus),
alive AS (SELECT '/w/b' || doc_id::VARCHAR AS path FROM corpus WHERE doc_id % 3 <> 1 UNION SELECT '/w/a' || doc_id::VARCHAR FROM corpus WHERE doc_id % 5 = 0
  UNION SELECT '/p/' || doc_id::VARCHAR FROM corpus WHERE doc_id % 4 = 0)"""
ORACLES = {
    "prune_orphans_report": f"{CACHES} SELECT * FROM orphans",
    "prune_orphans_bytes": f"{CACHES} SELECT reason, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM orphans GROUP BY reason",
    "cache_shaped_count": f"{CACHES} SELECT count(*) FILTER (WHERE regexp_matches(name, '^[0-9a-f]{{12}}$')) AS dirs_examined FROM caches",
    "prune_symbols_report": INDEXES,
    "alias_merge": f"""{META}, a AS (
  SELECT cache_key, unnest(alias_paths) AS path, generate_subscripts(alias_paths, 1) AS i FROM meta
  UNION ALL SELECT cache_key, '/w/c' || doc_id::VARCHAR, 3 FROM meta WHERE doc_id % 3 = 0)
SELECT cache_key, (row_number() OVER (PARTITION BY cache_key ORDER BY i) - 1)::INTEGER AS pos, path FROM a""",
    "alias_gc": f"""{META}, a AS (SELECT cache_key, unnest(alias_paths) AS path, generate_subscripts(alias_paths, 1) AS i FROM meta)
SELECT cache_key, (row_number() OVER (PARTITION BY cache_key ORDER BY i) - 1)::INTEGER AS pos, path FROM a WHERE path IN (SELECT path FROM alive)""",
    "worktree_invalidate": f"""{META}, w AS (
  SELECT c.doc_id, '/w/a' || c.doc_id::VARCHAR AS path, CASE WHEN c.doc_id % 13 = 0 THEN 'refused: path is a symlink' WHEN c.doc_id % 7 = 3 THEN 'no cache dir found for path'
    WHEN c.doc_id % 2 = 1 THEN 'no project meta found' END AS error, c.size FROM corpus c),
v AS (SELECT *, error IS NULL AND NOT ('/p/' || doc_id::VARCHAR) IN (SELECT path FROM alive) AND doc_id % 4 = 0 AS gone FROM w)
SELECT path, substr(sha256(path), 1, 12) AS cache_key, error IS NULL AS alias_removed, gone AS cache_deleted, CASE WHEN gone THEN size ELSE 0 END::BIGINT AS bytes_reclaimed, error FROM v""",
    "recent_projects": f"{META} SELECT project_path, updated_at FROM meta WHERE project_path IN (SELECT path FROM alive) ORDER BY updated_at DESC, project_path LIMIT 20",
    "verified_sidecars": f"{C} SELECT 'index_' || substr(sha256(file_path), 1, 16) || '.meta.json' AS file_name, file_path AS repo_path FROM corpus WHERE doc_id % 3 <> 0",
    "job_histogram": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type",
    "job_snapshot": """SELECT event_id::VARCHAR AS job_id, event_type AS tool, 'running' AS status, ((6000 - event_id % 5000) * 1000)::BIGINT AS age_ms,
  CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 8000 ELSE (6000 - event_id % 5000 - 2) * 1000 END ELSE -1 END::BIGINT AS duration_ms FROM events""",
    "debounce_events": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS edge_ts, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_event FROM s GROUP BY user_id, burst""",
    "stream_apply_changes": """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)
UNION ALL SELECT user_id, value FROM l WHERE e <> 'error'""",
}
QUERIES = {
    f.__name__: f
    for f in (
        prune_orphans_report, prune_orphans_bytes, cache_shaped_count, prune_symbols_report, alias_merge, alias_gc,
        worktree_invalidate, recent_projects, verified_sidecars, job_histogram, job_snapshot, debounce_events, stream_apply_changes,
    )
}
