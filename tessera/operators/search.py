"""Vector, full-text and hybrid top-k, and literal line search.

Every list has a total order: score, then id. Scores are rounded before they are ranked, so that the order of
a floating-point sum decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, vectors

K1, B = 1.2, 0.75
RRF = 60
DIGITS = 6
SPREAD = 64
FIRST_ENTRIES = 20  # times k: so many postings are scored before the rest is pruned


def candidates_per_list(limit: int) -> int:
    return max(2 * limit, 20)


def vector_topk(rows: DataFrame, query: list[float], k: int = 10, metric: str = "l2", id_column: str = "id", vector: str = "vector", builtin: bool = False) -> DataFrame:
    """G1: the k nearest rows; score is the distance, lower is better. No exchange but that of the k rows."""
    measure = vectors.distance_builtin if builtin else vectors.distance
    scored = rows.withColumn("score", F.round(measure(F.col(vector), query, metric), DIGITS) + 0.0)
    # rows without a score are dropped behind the limit: a filter before it would evaluate the distance twice
    return scored.orderBy(F.asc_nulls_last("score"), id_column).limit(max(0, k)).where(F.col("score").isNotNull())


def postings(rows: DataFrame, id_column: str = "id", column: str = "content") -> DataFrame:
    """Term, id, tf."""
    words = rows.select(F.col(id_column).alias("id"), F.explode(text.tokens(F.col(column))).alias("term"))
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(rows: DataFrame, id_column: str = "id", column: str = "content") -> DataFrame:
    return rows.select(F.col(id_column).alias("id"), F.size(text.tokens(F.col(column))).cast("long").alias("dl"))


def _bm25(tf: Column, dl: Column, df: Column, n: Column, mean: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.round(idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / mean)), DIGITS)


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term)).cast("long")


def fts_scan(rows: DataFrame, query: str, id_column: str = "id", column: str = "content") -> DataFrame:
    """id, score over the texts themselves: one pass counts the query's terms, no posting is shuffled.

    The corpus statistics are one row; it reaches the scored rows by a broadcast of that row.
    """
    terms = sorted(set(_query_terms(query)))
    # the tokens are bound as a lambda variable and come out of a generator, so that they are made once a text,
    # whatever filters and sums stand above
    counts = F.transform(
        F.array(text.tokens(F.col(column))),
        lambda words: F.struct(F.size(words).cast("long").alias("dl"), *[_occurrences(words, t).alias(f"tf{i}") for i, t in enumerate(terms)]),
    )
    counted = rows.select(F.col(id_column).alias("id"), F.explode_outer(counts).alias("c")).select("id", "c.*").where(F.col("dl") >= 0)
    totals = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    if not terms or not totals["n"]:
        return counted.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    parts = [
        F.when(F.col(f"tf{i}") > 0, _bm25(F.col(f"tf{i}"), F.col("dl"), F.lit(totals[f"df{i}"]), F.lit(totals["n"]), F.lit(totals["mean"]))).otherwise(F.lit(0.0))
        for i in range(len(terms))
    ]
    any_term = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return counted.where(any_term).select("id", F.round(reduce(lambda a, b: a + b, parts), DIGITS).alias("score"))


def length_shard(dl: Column, id_column: Column) -> Column:
    """A block's number: documents of about one length, ``SPREAD`` blocks a length. So there are never more than
    some thousands of blocks, and those of long documents have low bounds."""
    tier = F.floor(2 * F.log2(F.greatest(dl, F.lit(1))))
    return (tier * SPREAD + F.pmod(F.xxhash64(id_column), F.lit(SPREAD))).cast("int")


def sharded_postings(rows: DataFrame, id_column: str = "id", column: str = "content") -> DataFrame:
    """Term, shard, id, tf, dl: postings with their documents' lengths inside, dealt to blocks by length. Ids are unique."""
    # a text's words are sorted and counted inside its row, so that no word and no posting is shuffled; they come out
    # of a generator with their number, so that they are made once a text and not once a word
    def counted(words: Column) -> Column:
        n = F.size(words)
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.get(words, i - 1).eqNullSafe(F.get(words, i - 2)))
        return F.struct(n.cast("long").alias("dl"), words.alias("words"), firsts.alias("firsts"))

    texts = rows.select(F.col(id_column).alias("id"), F.explode(F.transform(F.array(F.array_sort(text.tokens(F.col(column)))), counted)).alias("t"))
    entries = F.transform("t.firsts", lambda at, k: F.struct(F.get("t.words", at - 1).alias("term"), (F.coalesce(F.get("t.firsts", k + 1).cast("long"), F.col("t.dl") + 1) - at).alias("tf")))
    hits = texts.select("id", F.col("t.dl").alias("dl"), F.explode(entries).alias("e"))
    return hits.select("e.term", length_shard(F.col("dl"), F.col("id")).alias("shard"), "id", "e.tf", "dl")


def posting_blocks(postings_: DataFrame, *by: str) -> DataFrame:
    """What a query reads first: of each term and block the entries, the highest count and the shortest document.

    Bounds stay right when entries go, so that blocks are only ever added.
    """
    return postings_.groupBy(*by, "term", "shard").agg(F.count(F.lit(1)).alias("entries"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def dealt_by_block(rows: DataFrame, parts: int, id_column: str = "id", column: str = "content") -> DataFrame:
    """Texts dealt to tasks by the number that :func:`sharded_postings` gives their block: a block's postings then come from one task."""
    return rows.repartition(parts, length_shard(F.size(text.tokens(F.col(column))).cast("long"), F.col(id_column)))


def local_blocks(postings_: DataFrame, *by: str) -> DataFrame:
    """:func:`posting_blocks` without an exchange: a row for each block and batch of rows that holds some of it.

    Readers add a block's rows up, so the bounds are the same. Of texts that were dealt by block and stored in order of
    term and block there is hardly more than a row a block.
    """
    keys = [*by, "term", "shard"]
    names = [*keys, "entries", "max_tf", "min_dl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([([], "count_all"), ("tf", "max"), ("dl", "min")])
            columns = [found[c].combine_chunks() for c in (*keys, "count_all", "tf_max", "dl_min")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join([*(f"{c} string" for c in (*by, "term")), "shard int, entries long, max_tf long, min_dl long"])
    return postings_.select(*keys, F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl")).mapInArrow(run, kinds)


@dataclass(frozen=True)
class Pruned:
    """The best rows (id, score), and how much of the query's postings had to be read for them."""

    rows: DataFrame
    blocks_read: int
    blocks: int
    entries_read: int
    entries: int


def pruned_topk(index: DataFrame, blocks: DataFrame, n: int, tokens: int, query: str, k: int = 10) -> Pruned:
    """The same best rows as :func:`fts_topk` gives, by block-max pruning over stored postings.

    A block's bound is the score of its shortest document with each term's highest count. The blocks of the highest
    bounds are scored first; then only those whose bound reaches the k-th score found. ``n`` and ``tokens`` are the
    corpus's documents and words. The driver gets a row for each of the query's terms and blocks, of which there
    are some thousands at most, whatever the corpus.
    """
    terms = sorted(set(_query_terms(query)))
    hits = index.where(F.col("term").isin(terms))
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row per term
    none = hits.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    if not df or k <= 0 or not n:
        return Pruned(none, 0, 0, 0, 0)
    mean = tokens / n
    counts = F.element_at(F.create_map(*[F.lit(x) for kv in df.items() for x in kv]), F.col("term"))
    part = lambda tf, dl: _bm25(tf, dl, counts, F.lit(n), F.lit(mean))
    known = blocks.where(F.col("term").isin(sorted(df))).groupBy("term", "shard").agg(F.sum("entries").alias("entries"), F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
    bounds = known.groupBy("shard").agg(F.sum(part(F.col("tf"), F.col("dl"))).alias("bound"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("blocks"))
    order = sorted(bounds.collect(), key=lambda r: (-r["bound"], r["shard"]))  # a row per shard

    def best(shards: list) -> DataFrame:
        scored = hits.where(F.col("shard").isin([r["shard"] for r in shards])).withColumn("part", part(F.col("tf"), F.col("dl")))
        return scored.groupBy("id").agg(F.round(F.sum("part"), DIGITS).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    first, held = [], 0
    for r in order:
        first.append(r)
        held += r["entries"]
        if held >= FIRST_ENTRIES * k:
            break
    found = best(first).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    limit = found["least"] if found["n"] == k else float("-inf")
    chosen = first + [r for r in order[len(first) :] if r["bound"] + 10.0**-DIGITS >= limit]
    return Pruned(best(chosen), sum(r["blocks"] for r in chosen), sum(r["blocks"] for r in order), sum(r["entries"] for r in chosen), sum(r["entries"] for r in order))


def fts_index(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """id, score from stored postings: only the query's terms are read (partition or row-group pruning)."""
    terms = sorted(set(_query_terms(query)))
    hits = index.where(F.col("term").isin(terms))
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row per term
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    if not df:
        return hits.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    counts = F.element_at(F.create_map(*[F.lit(x) for kv in df.items() for x in kv]), F.col("term"))
    scored = hits.join(lengths, "id").withColumn("part", _bm25(F.col("tf"), F.col("dl"), counts, F.lit(totals["n"]), F.lit(totals["mean"])))
    return scored.groupBy("id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def _query_terms(query: str) -> list[str]:
    import regex

    return regex.findall(text.TOKEN_PATTERN, query.lower())


def fts_topk(rows: DataFrame, query: str, k: int = 10, id_column: str = "id", column: str = "content") -> DataFrame:
    return fts_scan(rows, query, id_column, column).orderBy(F.desc("score"), "id").limit(max(0, k))


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Rank from 1 over a list that its limit has already cut to a few rows."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(lists: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal ranks summed by id over lists (id, rank); a sum over a union is the full outer join."""
    parts = [x.select("id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part")) for x in lists]
    together = reduce(lambda a, b: a.unionByName(b), parts)
    fused = together.groupBy("id").agg(F.round(F.sum("part"), 8).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(max(0, k))


def hybrid_topk(rows: DataFrame, query_vector: list[float], query: str, k: int = 10, metric: str = "l2", fts_ready: bool = True, id_column: str = "id", column: str = "content", vector: str = "vector", texts: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Id, score, match_type, rank. Without a text index (G3) the vector list alone, and match_type says so.

    ``scored`` (id, score), such as :func:`fts_index` gives of stored postings, spares the pass over the texts.

    ``rows`` holds vectors and texts, or the vectors alone where ``texts`` gives the texts: each half then searches
    its whole table, and an id of one table alone can be returned.
    """
    near = vector_topk(rows.select(F.col(id_column).alias("id"), vector), query_vector, candidates_per_list(k) if fts_ready else k, metric, "id", vector)
    near = ranked(near.select("id", "score"), [F.asc("score"), F.asc("id")])
    if not fts_ready:
        return near.select("id", "score", F.lit("vector").alias("match_type"), "rank")
    if scored is None:
        scored = fts_scan(rows if texts is None else texts, query, id_column, column)
    words = ranked(scored.orderBy(F.desc("score"), "id").limit(candidates_per_list(k)), [F.desc("score"), F.asc("id")])
    fused = ranked(fuse([near, words], k), [F.desc("score"), F.asc("id")])
    return fused.select("id", "score", F.lit("hybrid").alias("match_type"), "rank")


def response_rows(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids as the rows of an answer, which calls the first line line_number."""
    rows = chunks.select("id", "file_path", F.col("start_line").alias("line_number"), "end_line", "content")
    return F.broadcast(found).join(rows, "id")  # ``found`` is a top-k


def line_search(files: DataFrame, query: str, k: int = 50, case_sensitive: bool = False) -> DataFrame:
    """file_path, line_number, line of the first k matching lines by path and place.

    A file is tested as a whole before its lines are split, which most files fail.
    """
    body = F.col("content")
    maybe = files.where(text.contains_literal(body, query, case_sensitive))
    exploded = maybe.select("repo", "file_path", F.posexplode(text.lines(body)).alias("at", "line"))
    hits = exploded.where(text.contains_literal(F.col("line"), query, case_sensitive))
    out = hits.select("repo", "file_path", (F.col("at") + 1).alias("line_number"), text.strip_right(F.col("line")).alias("line"))
    return out.orderBy("repo", "file_path", "line_number").limit(max(0, k))
