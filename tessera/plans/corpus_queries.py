"""Queries of discovery, chunking, change detection and the tables of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, languages, paths, text
from tessera.operators import chunking, diff, discovery, maintenance, merge, predicates
from tessera.operators.ignore import parse_rules
from tessera.plans import views
from tessera.sources import store
from tessera.streaming import changes

RULES = "docs/*\n!docs/d1*\n*.ts\n"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below their repository, as discovery sees them."""
    own = views.corpus(spark, sf_dir)
    inner = F.expr("substring(file_path, length(repo) + 2)")
    odd = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("../"), inner)).otherwise(inner)
    large = F.when(F.col("doc_id") % 50 == 0, F.lit(1024 * 1024 + 1)).when(F.col("doc_id") % 50 == 1, F.lit(1024 * 1024)).otherwise(F.col("size"))
    body = F.when(F.col("doc_id") % 41 == 0, F.concat(F.lit("\0"), "content")).otherwise(F.col("content"))
    return own.select("doc_id", "repo", odd.alias("file_path"), large.cast("long").alias("size"), body.alias("content"))


def discovery_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.with_verdicts(_files(spark, sf_dir), "/repo", parse_rules(RULES))
    return found.select("doc_id", "file_path", *discovery.RULES, "ignored")


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.file_tree(discovery.discover(_files(spark, sf_dir), "/repo", parse_rules(RULES)), None)


def file_tree_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.file_tree(discovery.discover(_files(spark, sf_dir), "/repo", parse_rules(RULES)), 25)


def supported_files_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.supported(views.corpus(spark, sf_dir), 40).select("repo", "file_path")


def test_file_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus(spark, sf_dir).select("file_path", predicates.is_test_file(F.col("file_path")).alias("is_test_file"))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return views.corpus(spark, sf_dir).select(
        "file_path", paths.suffix(path).alias("suffix"), languages.language(path, languages.CHUNK_LANGUAGES).alias("chunk_language"),
        languages.language(path, languages.SYMBOL_LANGUAGES).alias("symbol_language"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus(spark, sf_dir).select("file_path", ids.sha256(F.col("content")).alias("file_hash"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = views.corpus(spark, sf_dir).select("repo").distinct()
    return repos.select("repo", ids.cache_key(F.col("repo")).alias("cache_key"), ids.index_key(F.col("repo")).alias("index_key"))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored versions force a new parse."""
    rows = views.corpus(spark, sf_dir).select("doc_id", F.concat(F.lit("2."), (F.col("doc_id") % 13).cast("string")).alias("version"))
    return rows.select("doc_id", "version", (text.version_key(F.col("version")) < text.version_key(F.lit("2.3"))).alias("outdated"))


def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("repo", "file_path", "chunk_index", "start_line", "end_line", "token_count", ids.sha256(F.col("content")).alias("content_hash"), "id")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.max("end_line").alias("last_line"))


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.embedding_batches(views.chunks(spark, sf_dir), 3, 400)


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus(spark, sf_dir).select("repo", "file_path", "file_hash")


def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.detect_changes(_now(spark, sf_dir), views.prior(spark, sf_dir))


def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.pending_files(_now(spark, sf_dir), views.prior(spark, sf_dir), views.zero_chunk(spark, sf_dir))


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.stale_indexed(views.prior(spark, sf_dir), _now(spark, sf_dir))


def never_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.never_indexed(_now(spark, sf_dir), views.prior(spark, sf_dir), views.zero_chunk(spark, sf_dir))


def staleness_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.staleness_suspects(views.corpus(spark, sf_dir), views.prior(spark, sf_dir), views.LAST_INDEXED)


def staleness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.staleness(views.corpus(spark, sf_dir), views.prior(spark, sf_dir), views.zero_chunk(spark, sf_dir), views.LAST_INDEXED)


def except_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.stale_indexed(_now(spark, sf_dir), views.prior(spark, sf_dir))


def union_zero_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero-chunk set with another added."""
    more = views.corpus(spark, sf_dir).where("doc_id % 20 = 3").select("repo", "file_path", "file_hash")
    return views.zero_chunk(spark, sf_dir).unionByName(more).distinct()


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.corpus(spark, sf_dir).select("doc_id", F.concat(F.lit("/repo/"), "file_path").alias("full_path"))
    return rows.select("doc_id", paths.relative(F.col("full_path"), "/repo").alias("file_path"))


def index_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending files in windows of 7 by repository."""
    return changes.windows(pending_files(spark, sf_dir), 7).select("repo", "file_path", "window")


def window_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each window of pending files adds."""
    return chunking.window_rollup(views.chunks(spark, sf_dir), index_windows(spark, sf_dir))


def chunk_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that hold some characters of each file."""
    rows = views.corpus(spark, sf_dir).select("file_path", "content", F.explode(F.array(F.lit(0), F.lit(17), F.lit(400))).alias("offset"))
    rows = rows.where(F.col("offset") <= F.length("content"))
    return rows.select("file_path", "offset", chunking.line_of(F.col("content"), F.col("offset")).alias("line_number"))


_COLUMNS = ("id", "repo", "file_path", "chunk_index", "file_hash")


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select(*_COLUMNS)


def append_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunk_rows(spark, sf_dir)
    return merge.append(rows.where("chunk_index < 2"), rows.where("chunk_index >= 2"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunk_rows(spark, sf_dir)
    fresh = rows.where("chunk_index BETWEEN 1 AND 3").withColumn("file_hash", F.lit("new"))
    return merge.upsert(rows, fresh)


def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = [r[0] for r in views.corpus(spark, sf_dir).where("doc_id IN (0, 1, 2, 3, 4)").select("file_path").collect()]
    return merge.delete_files(_chunk_rows(spark, sf_dir), gone)


def replace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunk_rows(spark, sf_dir)
    touched = pending_files(spark, sf_dir).select("repo", "file_path")
    fresh = rows.join(touched, ["repo", "file_path"], "left_semi").where("chunk_index = 0").withColumn("file_hash", F.lit("new"))
    return merge.replace_files(rows, fresh, touched)


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(views.chunks(spark, sf_dir))


def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.indexed_files(views.chunks(spark, sf_dir))


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.file_hashes(views.chunks(spark, sf_dir))


def latest_indexed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_indexed_at(views.chunks(spark, sf_dir))


def latest_indexed_at_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_indexed_at(views.chunks(spark, sf_dir).where("repo = 'none'"))


def list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_repos(_now(spark, sf_dir))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.token_cost(views.corpus(spark, sf_dir))


C, P, K = f"WITH {views.CORPUS_SQL}", f"WITH {views.PRIOR_SQL}", f"WITH {views.CHUNKS_SQL}"
SKIPPED = ", ".join(f"'{d}'" for d in predicates.SKIP_DIRS)
NAMES = ", ".join(f"'{d}'" for d in predicates.SECRET_NAMES)
ENDS = " OR ".join(f"ends_with(name, '{s}')" for s in predicates.SECRET_SUFFIXES)
STARTS = " OR ".join(f"starts_with(name, '{s}')" for s in predicates.SECRET_PREFIXES)
FILES_SQL = f"""{views.CORPUS_SQL}, own AS (
  SELECT doc_id, repo, CASE WHEN doc_id % 97 = 0 THEN '../' ELSE '' END || substr(file_path, length(repo) + 2) AS file_path,
    CASE WHEN doc_id % 50 = 0 THEN 1048577 WHEN doc_id % 50 = 1 THEN 1048576 ELSE size END::BIGINT AS size, doc_id % 41 = 0 AS nul FROM corpus),
parts AS (SELECT *, list_last(string_split(file_path, '/')) AS name, string_split(file_path, '/') AS p FROM own),
verdict AS (
  SELECT doc_id, repo, file_path, starts_with(file_path, '../') AS outside, name IN ({NAMES}) OR {ENDS} OR {STARTS} AS secret,
    len(list_filter(p[:-2], lambda x: x IN ({SKIPPED}) OR ends_with(x, '.egg-info'))) > 0 AS skipped_dir, size > 1048576 AS oversized,
    CASE WHEN regexp_matches(file_path, '\\.ts$') THEN true WHEN regexp_matches(file_path, '^docs/d1') THEN false
         WHEN regexp_matches(file_path, '^docs/.') THEN true ELSE false END AS rule_ignored,
    list_contains(p, '.git') AS git, nul AS "binary" FROM parts)"""
ANY = "outside OR secret OR skipped_dir OR oversized OR rule_ignored OR git OR \"binary\""
SUFFIX = "regexp_extract(list_last(string_split(file_path, '/')), '^.+(\\.[^.]+)$', 1)"


def _map(values: dict[str, str]) -> str:
    return "CASE lower(suffix) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items() if k == k.lower()) + " END"


NEVER = "SELECT repo, file_path FROM corpus c WHERE NOT EXISTS (FROM prior p WHERE p.repo = c.repo AND p.file_path = c.file_path) AND NOT EXISTS (FROM zero z WHERE z.repo = c.repo AND z.file_path = c.file_path)"
GONE = "SELECT DISTINCT repo, file_path FROM prior p WHERE NOT EXISTS (FROM corpus c WHERE p.repo = c.repo AND p.file_path = c.file_path)"
SUSPECT = "SELECT c.repo, c.file_path FROM corpus c LEFT JOIN prior p ON p.repo = c.repo AND p.file_path = c.file_path WHERE c.mtime > 50000 AND c.file_hash IS DISTINCT FROM p.file_hash"
PENDING = """pend AS (SELECT c.repo, c.file_path, c.file_hash FROM corpus c LEFT JOIN prior p ON p.repo = c.repo AND p.file_path = c.file_path
  WHERE c.file_hash IS DISTINCT FROM p.file_hash AND NOT EXISTS (FROM zero z WHERE z.repo = c.repo AND z.file_path = c.file_path AND z.file_hash = c.file_hash))"""
FIVE = "id, repo, file_path, chunk_index, file_hash"
ORACLES = {
    "discovery_verdict": f"WITH {FILES_SQL} SELECT doc_id, file_path, outside, secret, skipped_dir, oversized, rule_ignored, git, \"binary\", {ANY} AS ignored FROM verdict",
    "file_tree": f"WITH {FILES_SQL} SELECT repo, file_path FROM verdict WHERE NOT ({ANY})",
    "file_tree_limit": f"WITH {FILES_SQL} SELECT repo, file_path FROM verdict WHERE NOT ({ANY}) ORDER BY repo, file_path LIMIT 25",
    "supported_files_limit": f"{C} SELECT repo, file_path FROM (SELECT *, {SUFFIX} AS suffix FROM corpus) WHERE {_map(languages.SYMBOL_LANGUAGES)} IS NOT NULL ORDER BY repo, file_path LIMIT 40",
    "test_file_flag": f"{C} SELECT file_path, {views.IS_TEST_SQL} AS is_test_file FROM corpus",
    "language_detect": f"{C} SELECT file_path, suffix, {_map(languages.CHUNK_LANGUAGES)} AS chunk_language, {_map(languages.SYMBOL_LANGUAGES)} AS symbol_language FROM (SELECT *, {SUFFIX} AS suffix FROM corpus)",
    "content_hash": f"{C} SELECT file_path, sha256(content) AS file_hash FROM corpus",
    "cache_key": f"{C} SELECT DISTINCT repo, substr(sha256(repo), 1, 12) AS cache_key, substr(sha256(repo), 1, 16) AS index_key FROM corpus",
    "version_order": f"{C} SELECT doc_id, '2.' || (doc_id % 13)::VARCHAR AS version, doc_id % 13 < 3 AS outdated FROM corpus",
    "chunk_greedy": f"{K} SELECT repo, file_path, chunk_index, start_line, end_line, token_count, sha256(content) AS content_hash, id FROM chunks",
    "chunk_stats": f"{K} SELECT repo, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(end_line) AS last_line FROM chunks GROUP BY repo",
    "embed_batches": f"""{K}, e AS (SELECT repo, file_path, chunk_index, (length(content) // 4)::INTEGER AS tokens FROM chunks),
g AS (WITH RECURSIVE r AS (
    SELECT repo, file_path, chunk_index, tokens, 1 AS n, tokens AS s, 0 AS batch FROM e WHERE chunk_index = 0
    UNION ALL
    SELECT e.repo, e.file_path, e.chunk_index, e.tokens, CASE WHEN r.n >= 3 OR r.s + e.tokens > 400 THEN 1 ELSE r.n + 1 END,
      CASE WHEN r.n >= 3 OR r.s + e.tokens > 400 THEN e.tokens ELSE r.s + e.tokens END,
      CASE WHEN r.n >= 3 OR r.s + e.tokens > 400 THEN r.batch + 1 ELSE r.batch END
    FROM r JOIN e ON e.repo = r.repo AND e.file_path = r.file_path AND e.chunk_index = r.chunk_index + 1) SELECT * FROM r)
SELECT repo, file_path, chunk_index, tokens, batch FROM g""",
    "detect_changes": f"""{P} SELECT coalesce(c.repo, p.repo) AS repo, coalesce(c.file_path, p.file_path) AS file_path,
  CASE WHEN p.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted' WHEN c.file_hash = p.file_hash THEN 'same' ELSE 'changed' END AS status
FROM corpus c FULL JOIN prior p ON p.repo = c.repo AND p.file_path = c.file_path""",
    "pending_files": f"{P}, {PENDING} SELECT * FROM pend",
    "stale_files": f"{P} {GONE}",
    "never_indexed": f"{P} {NEVER}",
    "staleness_suspects": f"{P} {SUSPECT}",
    "staleness_report": f"""{P} SELECT repo, reason, count(*) AS count FROM (
  SELECT repo, 'never_indexed' AS reason FROM ({NEVER}) UNION ALL SELECT repo, 'deleted' FROM ({GONE}) UNION ALL SELECT repo, 'modified' FROM ({SUSPECT})) GROUP BY ALL""",
    "except_paths": f"{P} SELECT repo, file_path FROM corpus EXCEPT SELECT repo, file_path FROM prior",
    "union_zero_chunk": f"{P} SELECT * FROM zero UNION SELECT repo, file_path, file_hash FROM corpus WHERE doc_id % 20 = 3",
    "relative_paths": f"{C} SELECT doc_id, substr('/repo/' || file_path, 7) AS file_path FROM corpus",
    "index_windows": f'{P}, {PENDING} SELECT repo, file_path, (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // 7 AS "window" FROM pend',
    "window_status": f"""WITH {views.PRIOR_SQL}, {views.CHUNKS_SQL.split('corpus AS (')[1].split('FROM documents),', 1)[1]}, {PENDING},
w AS (SELECT repo, file_path, (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // 7 AS "window" FROM pend)
SELECT w.repo, "window", count(DISTINCT w.file_path) AS files, count(c.token_count) AS chunks, coalesce(sum(c.token_count), 0)::BIGINT AS tokens
FROM w LEFT JOIN chunks c ON c.repo = w.repo AND c.file_path = w.file_path GROUP BY ALL""",
    "chunk_line_ranges": f"""{C}, o AS (SELECT file_path, content, unnest([0, 17, 400])::INTEGER AS "offset" FROM corpus)
SELECT file_path, "offset", (length(substr(content, 1, "offset")) - length(replace(substr(content, 1, "offset"), chr(10), '')) + 1)::INTEGER AS line_number FROM o WHERE "offset" <= length(content)""",
    "append_chunks": f"{K} SELECT {FIVE} FROM chunks",
    "upsert_chunks": f"""{K}, s AS (SELECT id, repo, file_path, chunk_index, 'new' AS file_hash FROM chunks WHERE chunk_index BETWEEN 1 AND 3)
SELECT {FIVE} FROM chunks WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT * FROM s""",
    "delete_by_file": f"{K} SELECT {FIVE} FROM chunks WHERE file_path NOT IN (SELECT file_path FROM corpus WHERE doc_id IN (0, 1, 2, 3, 4))",
    "replace_files": f"""WITH {views.PRIOR_SQL}, {views.CHUNKS_SQL.split('corpus AS (')[1].split('FROM documents),', 1)[1]}, {PENDING},
hit AS (SELECT repo, file_path FROM pend)
SELECT {FIVE} FROM chunks c WHERE NOT EXISTS (FROM hit h WHERE h.repo = c.repo AND h.file_path = c.file_path)
UNION ALL SELECT id, repo, file_path, chunk_index, 'new' FROM chunks c WHERE chunk_index = 0 AND EXISTS (FROM hit h WHERE h.repo = c.repo AND h.file_path = c.file_path)""",
    "index_counts": f"{K} SELECT repo, count(*) AS chunks, count(DISTINCT file_path) AS files, coalesce(max(indexed_at), 0.0)::DOUBLE AS latest_indexed_at FROM chunks GROUP BY repo",
    "indexed_files": f"{K} SELECT DISTINCT repo, file_path FROM chunks",
    "file_hashes": f"{K} SELECT repo, file_path, min(file_hash) AS file_hash FROM chunks GROUP BY ALL",
    "latest_indexed_at": f"{K} SELECT coalesce(max(indexed_at), 0.0)::DOUBLE AS latest_indexed_at FROM chunks",
    "latest_indexed_at_empty": f"{K} SELECT coalesce(max(indexed_at), 0.0)::DOUBLE AS latest_indexed_at FROM chunks WHERE repo = 'none'",
    "list_repos": f"{C} SELECT repo, count(*) AS files, substr(sha256(repo), 1, 16) AS index_key FROM corpus GROUP BY repo",
    "token_cost": f"{C} SELECT repo, sum(length(content) // 4)::BIGINT AS tokens, round(sum(length(content) // 4) / 1e6 * 0.18, 9)::DOUBLE AS cost_usd FROM corpus GROUP BY repo",
}
QUERIES = {
    f.__name__: f
    for f in (
        discovery_verdict, file_tree, file_tree_limit, supported_files_limit, test_file_flag, language_detect, content_hash,
        cache_key, version_order, chunk_greedy, chunk_stats, embed_batches, detect_changes, pending_files, stale_files,
        never_indexed, staleness_suspects, staleness_report, except_paths, union_zero_chunk, relative_paths, index_windows,
        window_status, chunk_line_ranges, append_chunks, upsert_chunks, delete_by_file, replace_files, index_counts, indexed_files, file_hashes,
        latest_indexed_at, latest_indexed_at_empty, list_repos, token_cost,
    )
}
