"""Derived tables of the test data, once for Spark and once as SQL of the oracle, from the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.session import table

ID = "CAST(doc_id AS {string})"
FOLDER = (
    "CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'node_modules' WHEN 3 THEN '.git' "
    "WHEN 4 THEN 'lib/core' WHEN 5 THEN 'docs' WHEN 6 THEN 'build' WHEN 7 THEN 'pkg' WHEN 8 THEN 'app/my_test' "
    "WHEN 9 THEN 'lib.egg-info' ELSE 'venv' END"
)
FILE = (
    "CASE CAST(doc_id % 13 AS INT) WHEN 0 THEN '.env' WHEN 1 THEN 'credentials.json' WHEN 2 THEN concat('c', {id}, '.pem') "
    "WHEN 3 THEN concat('test_m', {id}, '.py') WHEN 4 THEN concat('m', {id}, '_test.py') WHEN 5 THEN 'conftest.py' "
    "WHEN 6 THEN concat('m', {id}, '.go') WHEN 7 THEN 'README.md' WHEN 8 THEN concat('data', {id}, '.bin') "
    "WHEN 9 THEN concat('m', {id}, '.ts') WHEN 10 THEN '.env.example' WHEN 11 THEN concat('m', {id}, '.py') "
    "ELSE concat('m', {id}, '.JS') END"
)
PATH = "concat(source, '/', {folder}, '/d', {id}, '/', {file})"
MTIME = "CAST((doc_id * 7919) % 100000 AS DOUBLE)"
LAST_INDEXED = 50_000.0


def path_sql(string: str) -> str:
    own = ID.format(string=string)
    return PATH.format(folder=FOLDER, id=own, file=FILE.format(id=own))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo, file_path, content, file_hash, size, mtime."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo"), F.expr(path_sql("STRING")).alias("file_path"), F.col("text").alias("content"),
        F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size"), F.expr(MTIME).alias("mtime"))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of before: some files unknown, some of another hash, some since deleted."""
    now = corpus(spark, sf_dir)
    kept = now.where("doc_id % 10 <> 3").select(
        "repo", "file_path", F.when(F.col("doc_id") % 10 == 4, F.sha2(F.concat(F.lit("old"), "content"), 256)).otherwise(F.col("file_hash")).alias("file_hash")
    )
    gone = now.where("doc_id % 10 = 5").select(
        "repo", F.concat("repo", F.lit("/gone/d"), (F.col("doc_id") + 1000000).cast("string"), F.lit(".py")).alias("file_path"), "file_hash"
    )
    return kept.unionByName(gone)


def zero_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("doc_id % 30 = 3").select("repo", "file_path", "file_hash")


CORPUS_SQL = f"""corpus AS (
  SELECT doc_id, source AS repo, {path_sql("VARCHAR")} AS file_path, text AS content, sha256(text) AS file_hash,
    strlen(text)::BIGINT AS size, {MTIME} AS mtime FROM documents)"""
PRIOR_SQL = f"""{CORPUS_SQL}, prior AS (
  SELECT repo, file_path, CASE WHEN doc_id % 10 = 4 THEN sha256('old' || content) ELSE file_hash END AS file_hash
  FROM corpus WHERE doc_id % 10 <> 3
  UNION ALL SELECT repo, repo || '/gone/d' || (doc_id + 1000000)::VARCHAR || '.py', file_hash FROM corpus WHERE doc_id % 10 = 5),
zero AS (SELECT repo, file_path, file_hash FROM corpus WHERE doc_id % 30 = 3)"""

CHUNK_SIZE = 100


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in greedy chunks, with a time of indexing by place."""
    cut = chunking.chunk_files(corpus(spark, sf_dir), CHUNK_SIZE, by_syntax=False)
    return cut.withColumn("indexed_at", (F.col("chunk_index") * 10 + F.length("repo")).cast("double"))


CHUNKS_SQL = f"""{CORPUS_SQL}, ln AS (
  SELECT repo, file_path, file_hash, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) AS n FROM corpus),
tk AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) + 1 AS cost FROM ln),
walk AS (
  WITH RECURSIVE r AS (
    SELECT repo, file_path, n, cost AS run, 0 AS seg FROM tk WHERE n = 1
    UNION ALL
    SELECT t.repo, t.file_path, t.n, CASE WHEN r.run + t.cost > {CHUNK_SIZE} THEN t.cost ELSE r.run + t.cost END,
      CASE WHEN r.run + t.cost > {CHUNK_SIZE} THEN r.seg + 1 ELSE r.seg END
    FROM r JOIN tk t ON t.repo = r.repo AND t.file_path = r.file_path AND t.n = r.n + 1)
  SELECT * FROM r),
pieces AS (
  SELECT k.repo, k.file_path, k.file_hash, w.seg, min(k.n)::INTEGER AS start_line, max(k.n)::INTEGER AS end_line,
    string_agg(k.line, chr(10) ORDER BY k.n) AS content, sum(k.cost)::INTEGER AS token_count
  FROM tk k JOIN walk w ON w.repo = k.repo AND w.file_path = k.file_path AND w.n = k.n GROUP BY ALL),
chunks AS (
  SELECT repo, file_path, file_hash, chunk_index, start_line, end_line, content, token_count,
    sha256(repo || '/' || file_path || ':' || chunk_index::VARCHAR) AS id, (chunk_index * 10 + length(repo))::DOUBLE AS indexed_at
  FROM (SELECT *, (row_number() OVER (PARTITION BY repo, file_path ORDER BY seg) - 1)::INTEGER AS chunk_index
        FROM pieces WHERE regexp_matches(content, '\\S')))"""


def occurrences(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Words of the corpus, or of ``files``, as candidate uses: place is the word's number in its line, kind its neighbour's."""
    from tessera.functions import ids
    from tessera.operators import predicates

    files = corpus(spark, sf_dir) if files is None else files
    files = files.select("repo", "file_path", predicates.is_test_file(F.col("file_path")).alias("is_test_file"), "content")  # once a file, not for each word
    lines = files.select("repo", "file_path", "is_test_file", F.posexplode(F.split("content", "\n")).alias("l", "line"))
    words = lines.select("repo", "file_path", "is_test_file", (F.col("l") + 1).alias("line_number"), F.posexplode(F.split("line", " ")).alias("w", "word"))
    name = F.regexp_extract("word", r"[\p{L}\p{N}_]+", 0)
    kind = (
        F.when(F.col("word").endswith("."), "call").when(F.col("word").endswith(","), "attribute")
        .when(F.col("word").rlike("^[A-Z]"), "import").otherwise("reference")
    )
    place = (F.col("line_number") * 10000 + F.col("w")).cast("int").alias("start_byte")
    found = words.select("repo", "file_path", "line_number", place, name.alias("name"), kind.alias("kind"), "is_test_file").where("name <> ''")
    return found.select("repo", "file_path", "line_number", "start_byte", "name", "kind", ids.occurrence_id(F.col("file_path"), F.col("name"), F.col("start_byte")).alias("id"), "is_test_file")


IS_TEST_SQL = """(len(list_filter(string_split(file_path, '/'), lambda p: p = 'tests' OR starts_with(p, 'test_') OR ends_with(p, '_test'))) > 0
    OR starts_with(list_last(string_split(file_path, '/')), 'test_') OR ends_with(file_path, '_test.py') OR list_last(string_split(file_path, '/')) = 'conftest.py')"""
OCCURRENCES_SQL = f"""{CORPUS_SQL}, lns AS (
  SELECT repo, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM corpus),
wds AS (SELECT repo, file_path, line_number, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS w FROM lns),
occurrences AS (
  SELECT *, file_path || ':occurrence:' || name || ':' || start_byte::VARCHAR AS id FROM (
    SELECT repo, file_path, line_number::INTEGER AS line_number, (line_number * 10000 + w)::INTEGER AS start_byte,
      regexp_extract(word, '[\\p{{L}}\\p{{N}}_]+', 0) AS name,
      CASE WHEN ends_with(word, '.') THEN 'call' WHEN ends_with(word, ',') THEN 'attribute' WHEN regexp_matches(word, '^[A-Z]') THEN 'import' ELSE 'reference' END AS kind,
      {IS_TEST_SQL} AS is_test_file FROM wds) WHERE name <> '')"""


def _function(key: Column, size: Column) -> Column:
    return F.concat(F.lit("def part_"), key.cast("string"), F.lit("(x):\n    return helper_"), size.cast("string"), F.lit("(x)\n"))


CODE_ORDER = ("p_partkey", "p_size")


def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of :func:`code` before they are put together: a row for each function, in ``CODE_ORDER``."""
    path = F.concat(F.lit("pkg/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".py"))
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("repo"), path.alias("file_path"), *CODE_ORDER)


def code_content() -> Column:
    return _function(*map(F.col, CODE_ORDER))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files rendered from ``part``: one per brand, a function per part in order of key."""
    # numbers are collected, and become texts one file at a time
    grouped = code_parts(spark, sf_dir).groupBy("repo", "file_path").agg(F.array_sort(F.collect_list(F.struct(*CODE_ORDER))).alias("p"))
    return grouped.select("repo", "file_path", F.array_join(F.transform("p", lambda p: _function(p.p_partkey, p.p_size)), "").alias("content"))


CODE_SQL = """bodies AS (
  SELECT 'pkg/' || replace(p_brand, '#', '_') || '.py' AS file_path, p_partkey AS k, p_size AS z,
    'def part_' || p_partkey::VARCHAR || '(x):' || chr(10) || '    return helper_' || p_size::VARCHAR || '(x)' || chr(10) AS body FROM part),
placed AS (
  SELECT *, (coalesce(sum(length(body)) OVER (PARTITION BY file_path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off,
    row_number() OVER (PARTITION BY file_path ORDER BY k) AS rn FROM bodies),
symbols AS (
  SELECT 'parts' AS repo, file_path, 'part_' || k::VARCHAR AS name, 'function' AS kind, file_path || ':function:part_' || k::VARCHAR AS id,
    off::INTEGER AS start_byte, (off + length(body) - 1)::INTEGER AS end_byte, rtrim(body, chr(10)) AS source, k, z, off, rn FROM placed)"""
