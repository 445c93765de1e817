"""Queries of the search operators over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ann, search
from tessera.plans import views
from tessera.session import table

QUERY = "onble der reen"
LIMIT = 10
RECALL_QUERIES = 300
NEEDLE = "The th"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query's embedding: here that of vec_id 0."""
    found = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in found[0]]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).join(_vectors(spark, sf_dir), "id")


def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), LIMIT, "l2").select("id", "score", F.lit("vector").alias("match_type"))


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), LIMIT, "cosine").select("id", "score", F.lit("vector").alias("match_type"))


def vector_topk_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without Python."""
    return search.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), LIMIT, "l2", builtin=True).select("id", "score")


def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated index, as the engine builds it, against an exact search of all rows: queries (rows by hash, other
    than those of the calibration), neighbours looked for, and whether at least 0.9 of them are found."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = ann.train(rows, ann.n_buckets(rows.count()))
    indexed = ann.build(rows, index)
    index = ann.calibrate(indexed, index)
    asked = ann.held_out(rows, RECALL_QUERIES, seed=20)
    found, exact = (ann.search_many(indexed, index, asked, LIMIT, exact=e).select("query", "id", F.lit(e).alias("exact")) for e in (False, True))
    both = found.unionByName(exact).groupBy("query", "id").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("exact"))
    return both.where("exact").agg(F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count_if(F.col("n") == 2) >= 0.9 * F.count(F.lit(1))).alias("reached"))


def vector_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate index, probed in every bucket, where it must equal the exact search; tests measure recall with few."""
    rows = _vectors(spark, sf_dir)
    centres = ann.fit(rows, 16)
    return ann.topk(ann.build(rows, centres), centres, _query_vector(spark, sf_dir), LIMIT, len(centres)).select("id", "score")


def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fts_topk(_documents(spark, sf_dir), QUERY, LIMIT)


def fts_bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores, from postings and lengths."""
    docs = _documents(spark, sf_dir)
    return search.fts_index(search.postings(docs), search.document_lengths(docs), QUERY)


def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_topk(_both(spark, sf_dir), _query_vector(spark, sf_dir), QUERY, LIMIT)


def hybrid_degraded_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_topk(_both(spark, sf_dir), _query_vector(spark, sf_dir), QUERY, LIMIT, fts_ready=False)


def hybrid_rrf_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents and all vectors; hybrid_rrf_topk and its SQL search the ids that have both."""
    return search.hybrid_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), QUERY, LIMIT, texts=_documents(spark, sf_dir))


def hybrid_degraded_vector_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), QUERY, LIMIT, fts_ready=False)


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_documents(spark, sf_dir))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_lengths(_documents(spark, sf_dir))


def text_search_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_search(views.corpus(spark, sf_dir), NEEDLE, 50).withColumn("line_number", F.col("line_number").cast("long"))


def text_search_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_search(views.corpus(spark, sf_dir), NEEDLE, 50, case_sensitive=True).withColumn("line_number", F.col("line_number").cast("long"))


QV = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
L2 = "round(list_sum(list_transform(list_zip(embedding, qv), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
COSINE = f"round(1 - {DOT.format(a='embedding', b='qv')} / (sqrt({DOT.format(a='embedding', b='embedding')}) * sqrt({DOT.format(a='qv', b='qv')})), 6) + 0.0::DOUBLE"
TERMS = ", ".join(f"'{t}'" for t in sorted(set(QUERY.split())))


def _bm25(ids: str) -> str:
    return f"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents {ids}),
post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS dl FROM documents {ids}),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM len),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT p.id, round(sum(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6)), 6) AS score
  FROM post p JOIN dfs USING (term) JOIN len ON len.id = p.id, st WHERE p.term IN ({TERMS}) GROUP BY p.id)"""


HALF = f"""WITH {QV}, {_bm25('WHERE doc_id IN (SELECT vec_id FROM embeddings)')},
near AS (SELECT vec_id AS id, {L2} AS d FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents))"""
ORACLES = {
    "vector_topk_l2": f"WITH {QV} SELECT vec_id AS id, {L2} AS score, 'vector' AS match_type FROM embeddings, q ORDER BY score, id LIMIT {LIMIT}",
    "vector_topk_cosine": f"WITH {QV} SELECT vec_id AS id, {COSINE} AS score, 'vector' AS match_type FROM embeddings, q ORDER BY score, id LIMIT {LIMIT}",
    "vector_topk_builtin": f"WITH {QV} SELECT vec_id AS id, {L2} AS score FROM embeddings, q ORDER BY score, id LIMIT {LIMIT}",
    "vector_recall": f"""WITH n AS (SELECT count(*) AS rows FROM embeddings WHERE embedding IS NOT NULL)
        SELECT least(rows, {RECALL_QUERIES}) AS queries, least(rows, {RECALL_QUERIES}) * least({LIMIT}, rows - 1) AS neighbours, true AS reached FROM n""",
    "vector_topk_ivf": f"WITH {QV} SELECT vec_id AS id, {L2} AS score FROM embeddings, q ORDER BY score, id LIMIT {LIMIT}",
    "fts_bm25_topk": f"WITH {_bm25('')} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {LIMIT}",
    "fts_bm25_indexed": f"WITH {_bm25('')} SELECT id, score FROM bm",
    "hybrid_rrf_topk": f"""{HALF},
a AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM near QUALIFY r <= 20),
b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 20),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT id, score, 'hybrid' AS match_type, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM f ORDER BY rank LIMIT {LIMIT}""",
    "hybrid_degraded_vector": f"""{HALF}
SELECT id, d AS score, 'vector' AS match_type, row_number() OVER (ORDER BY d, id)::INTEGER AS rank FROM near ORDER BY rank LIMIT {LIMIT}""",
    "postings_build": f"WITH {_bm25('')} SELECT term, id, tf FROM post",
    "doc_lengths": f"WITH {_bm25('')} SELECT id, dl FROM len",
}
WHOLE = f"""WITH {QV}, {_bm25('')},
near AS (SELECT vec_id AS id, {L2} AS d FROM embeddings, q)"""
for _name in ("hybrid_rrf_topk", "hybrid_degraded_vector"):
    ORACLES[f"{_name}_whole"] = ORACLES[_name].replace(HALF, WHOLE)
for _name, _test in (("text_search_ci", f"contains(lower(line), lower('{NEEDLE}'))"), ("text_search_cs", f"contains(line, '{NEEDLE}')")):
    ORACLES[_name] = f"""WITH {views.CORPUS_SQL}, l AS (
  SELECT repo, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM corpus)
SELECT repo, file_path, line_number, regexp_replace(line, '\\s+$', '') AS line FROM l WHERE {_test} ORDER BY repo, file_path, line_number LIMIT 50"""
QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_l2, vector_topk_cosine, vector_topk_builtin, vector_topk_ivf, vector_recall, fts_bm25_topk, fts_bm25_indexed, hybrid_rrf_topk,
        hybrid_degraded_vector, hybrid_rrf_topk_whole, hybrid_degraded_vector_whole, postings_build, doc_lengths, text_search_ci, text_search_cs,
    )
}
