"""Queries of what stands between the operators: stored tables, answers, events, parsing details, orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import languages, text
from tessera.operators import chunking, diff, embedding, extract, maintenance, search
from tessera.plans import corpus_queries, search_queries, views
from tessera.session import scratch_folder, table
from tessera.sources import store
from tessera.streaming import changes

PROJECT = "src3"
TASK_WORDS = 1 << 22


def _store(spark: SparkSession) -> store.Store:
    """A store of this query alone, where the session keeps its checkpoints; a local folder only in a local session."""
    return store.Store(spark, f"{scratch_folder(spark)}/tables-{uuid.uuid4().hex}")


def _index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus(spark, sf_dir).select("repo", "file_path", "file_hash", F.lit("2.3").alias("version"))


def store_project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in two appends, a part replaced, one project read from its own folders."""
    held, rows = _store(spark), _index_files(spark, sf_dir)
    first = F.xxhash64("file_path") % 2 == 0
    held.append("files", rows.where(first))
    held.append("files", rows.where(~first))
    changed = rows.where(F.col("file_path").contains("/tests/")).withColumn("file_hash", F.lit("new"))
    held.replace("files", changed, changed.select("repo", "file_path"))
    return held.read("files", repo=PROJECT)


def merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of files written one after another, some again, some deleted; every read merges what is there."""
    held, rows = _store(spark), _index_files(spark, sf_dir)
    window = F.xxhash64("file_path") % 2
    for n in (-1, 0, 1):
        new = rows.where(window == n)
        held.replace("files", new, new.select("repo", "file_path"), known=new.select("repo", "file_path").limit(0))
    changed = rows.where(F.col("file_path").contains("/tests/")).withColumn("file_hash", F.lit("new"))
    held.replace("files", changed, changed.select("repo", "file_path"))
    gone = rows.where(F.col("file_path").endswith(".md"))
    held.replace("files", rows.limit(0), gone.select("repo", "file_path"))
    back = gone.where(F.col("file_path").contains("/docs/")).withColumn("file_hash", F.lit("back"))
    held.replace("files", back, back.select("repo", "file_path"))
    return held.read("files")


MERGED = f"""WITH {views.CORPUS_SQL} SELECT repo, file_path, '2.3' AS version,
  CASE WHEN file_path LIKE '%.md' THEN 'back' WHEN file_path LIKE '%/tests/%' THEN 'new' ELSE file_hash END AS file_hash
  FROM corpus WHERE file_path NOT LIKE '%.md' OR file_path LIKE '%/docs/%'"""


def store_index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar's counts of one project."""
    held = _store(spark)
    held.append("files", _index_files(spark, sf_dir))
    # a text's words take less than the text itself: their ids, which are most of the bytes, are said by the other columns
    texts = held.dealt("occurrences", views.corpus(spark, sf_dir).select("repo", "file_path", "content"), F.octet_length("content"))
    uses = views.occurrences(spark, sf_dir, texts).drop("id").withColumn("end_byte", F.lit(0)).withColumn("line_text", F.lit("")).withColumn("enclosing_symbol_id", F.lit(None).cast("string"))
    held.append("occurrences", uses, dealt=True)
    held.write_index_meta(7.0, PROJECT)
    return held.read("index_meta")


def store_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and versions before and after."""
    held = _store(spark)
    missing = held.exists("files")
    held.append("files", _index_files(spark, sf_dir))
    before = held.read("files").agg(F.count(F.lit(1)).alias("before"))
    held.clear("files")
    after = held.read("files").agg(F.count(F.lit(1)).alias("after"))
    kept = held.read("files", version=1).agg(F.count(F.lit(1)).alias("n"))
    return before.select("before", F.lit(after.first()["after"]).alias("after"), F.lit(kept.first()["n"]).alias("old_version"), F.lit(missing).alias("existed"))


def _text_index(spark: SparkSession, sf_dir: str, k: int) -> search.Pruned:
    """The best ``k`` by stored postings, blocks and lengths of all documents."""
    held, docs = _store(spark), search_queries._documents(spark, sf_dir)
    repo, key = F.lit("documents").alias("repo"), F.lpad(F.col("id").cast("string"), 20, "0").alias("id")  # in order of numbers
    held.write("doc_lengths", search.document_lengths(docs).where("dl IS NOT NULL").select(repo, key, "dl"))
    n, tokens, *_ = held.projects("doc_lengths").get("documents", [0, 0])
    # one project: its texts are dealt to tasks that sort their postings in memory, and neither a posting nor a bound is shuffled
    texts = search.dealt_by_block(docs, 1 + tokens // TASK_WORDS)
    held.write("postings", search.sharded_postings(texts).select(repo, "term", "shard", key, "tf", "dl"), dealt=True)
    held.write("posting_blocks", search.local_blocks(held.read("postings"), "repo"), dealt=True)
    return search.pruned_topk(held.read("postings", repo="documents"), held.read("posting_blocks", repo="documents"), n, tokens, search_queries.QUERY, k)


def fts_bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows, by block-max pruning; nothing but the blocks that can hold one of them is read."""
    found = _text_index(spark, sf_dir, search_queries.LIMIT).rows
    return found.select(F.col("id").cast("long").alias("id"), "score")


def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words from stored postings, read by term, instead of from the texts."""
    scored = _text_index(spark, sf_dir, search.candidates_per_list(search_queries.LIMIT)).rows
    scored = scored.select(F.col("id").cast("long").alias("id"), "score")
    return search.hybrid_topk(search_queries._vectors(spark, sf_dir), search_queries._query_vector(spark, sf_dir), search_queries.QUERY, search_queries.LIMIT, scored=scored)


def text_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to text; a byte that is no UTF-8 becomes one U+FFFD."""
    body = F.concat(F.col("content").cast("binary"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    decoded = text.decode(body)
    return views.corpus(spark, sf_dir).select("doc_id", F.char_length(decoded).alias("n_chars"), F.sha2(decoded, 256).alias("text_hash"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, changes.EVENT_TYPES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return views.corpus(spark, sf_dir).select("doc_id", "file_path", kind.alias("event_type"))


def relevant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched suffixes, and every deletion."""
    return changes.relevant(_events(spark, sf_dir))


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chunks as an answer."""
    rows = views.chunks(spark, sf_dir)
    found = rows.orderBy(F.desc("token_count"), "id").limit(20).select("id", F.col("token_count").alias("score"))
    return search.response_rows(found, rows).withColumn("content", F.sha2("content", 256))


class _Lengths:
    """A model whose vectors are a text's length and its line breaks."""

    dimension = 2

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("\n"))] for t in texts]


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the rows of their chunks, through requests of 7 texts."""
    rows = embedding.embed_chunks(views.chunks(spark, sf_dir), _Lengths(), max_texts=7)
    return rows.select("id", "file_hash", "indexed_at", F.col("vector")[0].cast("double").alias("v0"), F.col("vector")[1].cast("double").alias("v1"))


def chunk_python_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two functions to a chunk; one that is left over is below the least size."""
    found = chunking.chunk_files(views.code(spark, sf_dir).withColumn("file_hash", F.lit("h")), 12)
    return found.select("file_path", "chunk_index", "start_line", "end_line", "token_count", F.sha2("content", 256).alias("content_hash"))


def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files to index, by path."""
    now = views.corpus(spark, sf_dir).select("repo", "file_path", "file_hash")
    return diff.in_order(diff.pending_files(now, views.prior(spark, sf_dir), views.zero_chunk(spark, sf_dir))).limit(25)


def zero_chunk_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5."""
    return diff.in_order(views.zero_chunk(spark, sf_dir)).limit(10).select("repo", "file_path")


def _go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Go file a brand: grouped imports with aliases, and grouped types, a struct, an interface or an alias each."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".go")).alias("file_path"), "p_partkey",
        F.concat(F.lit("\ta"), k, F.lit(' "x/y'), z, F.lit('"\n')).alias("one"),
        F.concat(F.lit("\tT"), k, F.when(F.col("p_partkey") % 3 == 0, F.lit(" struct { f int }\n")).when(F.col("p_partkey") % 3 == 1, F.lit(" interface { M() }\n")).otherwise(F.lit(" = int\n"))).alias("two"))
    grouped = parts.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "one", "two"))).alias("p"))
    source = F.concat(F.lit("package p\n\nimport (\n"), F.array_join("p.one", ""), F.lit(")\n\ntype (\n"), F.array_join("p.two", ""), F.lit(")\n"))
    return grouped.select(F.lit("parts").alias("repo"), "file_path", source.alias("content"))


def go_import_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: an alias of an import is a use of kind import."""
    found = extract.occurrences_of(extract.extract_files(_go(spark, sf_dir), tags=("occurrence",))).where("kind = 'import'")
    return found.select("name", "file_path", "start_byte", "end_byte", "line_number")


def go_grouped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: one symbol for each type of a group."""
    return extract.symbols_of(extract.extract_files(_go(spark, sf_dir), tags=("symbol",))).select("name", "kind", "file_path")


QUOTES = ('"""', "'''", '"', "'")


def python_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docstrings without their quotes and the space around."""
    k = F.col("p_partkey").cast("string")
    quote = F.element_at(F.array(*map(F.lit, QUOTES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    one = F.concat(F.lit("def part_"), k, F.lit("(x):\n    "), quote, F.lit(" Doc of "), k, F.lit(". "), quote, F.lit("\n    return x\n"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".py")).alias("file_path"), one.alias("body"))
    files = parts.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list("body")), "").alias("content")).withColumn("repo", F.lit("parts"))
    return extract.symbols_of(extract.extract_files(files, tags=("symbol",))).select("name", "file_path", "docstring")


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15."""
    return maintenance.savings_by(extract.symbols_of(extract.extract_files(views.code(spark, sf_dir), tags=("symbol",))))


def meta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of meta, some broken, some null."""
    n = F.col("doc_id")
    body = F.to_json(F.struct(F.concat(F.lit("/p/"), n.cast("string")).alias("project_path"), F.col("mtime").alias("updated_at"), F.array(F.concat(F.lit("/w/"), n.cast("string"))).alias("alias_paths")))
    broken = F.when(n % 7 == 3, F.concat(F.lit("{"), F.substring(body, 5, 10))).when(n % 7 != 4, body)
    found = store.parse_meta(views.corpus(spark, sf_dir).select("doc_id", broken.alias("body")))
    return found.select("doc_id", "project_path", "updated_at", F.col("alias_paths")[0].alias("alias"))


C, P, K = f"WITH {views.CORPUS_SQL}", f"WITH {views.PRIOR_SQL}", f"WITH {views.CHUNKS_SQL}"
WATCHED = ", ".join(f"'{s}'" for s in sorted({s.lower() for s in languages.CHUNK_LANGUAGES if s == s.lower()}))
BRAND = "'pkg/' || replace(p_brand, '#', '_') ||"
GO = f"""WITH parts AS (
  SELECT {BRAND} '.go' AS file_path, p_partkey AS k, chr(9) || 'a' || p_partkey::VARCHAR || ' "x/y' || p_size::VARCHAR || '"' || chr(10) AS one FROM part),
placed AS (SELECT *, {len("package p" + chr(10) * 2 + "import (" + chr(10))} + coalesce(sum(length(one)) OVER w, 0) AS off, row_number() OVER (PARTITION BY file_path ORDER BY k) AS rn
  FROM parts WINDOW w AS (PARTITION BY file_path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ORACLES = {
    "store_project_files": f"{C} SELECT repo, file_path, CASE WHEN contains(file_path, '/tests/') THEN 'new' ELSE file_hash END AS file_hash, '2.3' AS version FROM corpus WHERE repo = '{PROJECT}'",
    "store_index_meta": f"WITH {views.OCCURRENCES_SQL} SELECT '{PROJECT}' AS repo, '2.3' AS version, (SELECT count(*) FROM corpus WHERE repo = '{PROJECT}') AS files, 0::BIGINT AS symbols, (SELECT count(*) FROM occurrences WHERE repo = '{PROJECT}') AS occurrences, 7.0::DOUBLE AS updated_at",
    "store_truncate": "SELECT count(*) AS before, 0::BIGINT AS after, count(*) AS old_version, false AS existed FROM documents",
    "fts_bm25_pruned": search_queries.ORACLES["fts_bm25_topk"],
    "hybrid_indexed": search_queries.ORACLES["hybrid_rrf_topk_whole"],
    "merge_on_read": MERGED,
    "text_read": f"{C} SELECT doc_id, (length(content) + (doc_id % 5 = 0)::INTEGER)::INTEGER AS n_chars, sha256(content || CASE WHEN doc_id % 5 = 0 THEN chr(65533) ELSE '' END) AS text_hash FROM corpus",
    "relevant_events": f"""{C} SELECT doc_id, file_path, event_type FROM (SELECT *, {corpus_queries.SUFFIX} AS suffix, ['created', 'modified', 'deleted'][(doc_id % 3 + 1)::INTEGER] AS event_type FROM corpus)
WHERE event_type = 'deleted' OR lower(suffix) IN ({WATCHED})""",
    "search_response": f"{K} SELECT id, token_count AS score, file_path, start_line AS line_number, end_line, sha256(content) AS content FROM chunks ORDER BY token_count DESC, id LIMIT 20",
    "chunk_vectors": f"{K} SELECT id, file_hash, indexed_at, length(content)::DOUBLE AS v0, (length(content) - length(replace(content, chr(10), '')))::DOUBLE AS v1 FROM chunks",
    "chunk_python_syntax": f"""WITH {views.CODE_SQL}, pair AS (SELECT file_path, (rn - 1) // 2 AS c, min(rn) AS a, max(rn) AS b, rtrim(string_agg(body, '' ORDER BY rn), chr(10)) AS content FROM placed GROUP BY ALL HAVING count(*) = 2)
SELECT file_path, c::INTEGER AS chunk_index, (2 * a - 1)::INTEGER AS start_line, (2 * b)::INTEGER AS end_line, 12 AS token_count, sha256(content) AS content_hash FROM pair""",
    "pending_first": f"{P}, {corpus_queries.PENDING} SELECT repo, file_path, file_hash FROM pend ORDER BY repo, file_path LIMIT 25",
    "zero_chunk_first": f"{P} SELECT repo, file_path FROM zero ORDER BY repo, file_path LIMIT 10",
    "go_import_occurrences": f"{GO} SELECT 'a' || k::VARCHAR AS name, file_path, (off + 1)::INTEGER AS start_byte, (off + 2 + length(k::VARCHAR))::INTEGER AS end_byte, (3 + rn)::INTEGER AS line_number FROM placed",
    "go_grouped_types": f"SELECT 'T' || p_partkey::VARCHAR AS name, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'alias' END AS kind, {BRAND} '.go' AS file_path FROM part",
    "python_docstrings": f"SELECT 'part_' || p_partkey::VARCHAR AS name, {BRAND} '.py' AS file_path, 'Doc of ' || p_partkey::VARCHAR || '.' AS docstring FROM part",
    "savings": f"SELECT {BRAND} '.py' AS file_path, (count(*) * 150)::BIGINT AS tokens_saved, round(count(*) * 150 * 3.0::DOUBLE / 1e6, 6)::DOUBLE AS cost_avoided_usd FROM part GROUP BY ALL",
    "meta_parse": f"""{C} SELECT doc_id, CASE WHEN doc_id % 7 NOT IN (3, 4) THEN '/p/' || doc_id::VARCHAR END AS project_path, CASE WHEN doc_id % 7 NOT IN (3, 4) THEN mtime END AS updated_at,
  CASE WHEN doc_id % 7 NOT IN (3, 4) THEN '/w/' || doc_id::VARCHAR END AS alias FROM corpus""",
}
QUERIES = {
    f.__name__: f
    for f in (
        store_project_files, store_index_meta, store_truncate, fts_bm25_pruned, hybrid_indexed, merge_on_read, text_read, relevant_events, search_response, chunk_vectors,
        chunk_python_syntax, pending_first, zero_chunk_first, go_import_occurrences, go_grouped_types, python_docstrings, savings, meta_parse,
    )
}
