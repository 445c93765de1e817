"""Ranked lexical search by Fagin's threshold algorithm (operator 11).

Method: documents become a forward index (terms of the queries and their counts, one slim row a document), from
which the corpus counts follow. Rows of the index are dealt into shards of a bounded number of documents. In a
shard every term has a list of its documents sorted by impact; a query reads its lists round-robin, some entries
of each in turn, looks the whole score of each document that it has not met up in the forward index, keeps the
best k, and stops once the threshold, the score of an imaginary document with the impacts read last, is strictly
below the k-th score. Ties at the k-th score are thus all met. What a task has kept is the bar of its next shard,
and no row is dropped but those that k documents of the same task, or of the pilot, outrank.

Scale: texts are read once, in place; the forward index holds the queries' terms alone. Shards are runs of rows
of the stored index, so a hot source or term is spread like any other, and a shard's arrays have a fixed size
(``CELLS``). A pilot over a 64th of the documents, chosen by hash, gives each query a first bar, so that most
shards stop after a few entries and return little. Each task returns k rows a query at most; the last exchange
orders those, after Spark's limit by group within the tasks. Queries are taken in blocks of ``BLOCK_ROWS`` rows
and ``BLOCK_TERMS`` terms (or one query): the driver holds a block's terms, their document counts and bars.

Cases: a null or empty text has no terms, a document without terms counts nowhere; a query without terms, or with
none that the corpus has, has no result; repeated documents are ranked each on its own, repeated queries each
answered; equal scores go by id, null (or 2 ** 63 - 1) last, equal ids are in no set order; an empty table gives an empty result.
Only the columns named are read. Scores and lengths are 64-bit integers: 75 * n * N must stay below 2 ** 63.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, durable, stored

K = 10
BLOCK_ROWS = 2_000
BLOCK_TERMS = 20_000
CELLS = 1 << 23  # of a shard's forward index: documents by terms, 4 bytes each
MOST_DOCS = 16_384
STEP = 64  # entries of each list in the first turn; turns double
PILOT = 64  # one document in so many gives the first bars
FORWARD = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "query int, doc_id long, score long"

_TABLE = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Letters and digits of ASCII and all that is beyond it, A-Z lower-cased; every other character parts terms."""
    return text.translate(_TABLE).split()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """A row for each document with terms: its length and the counts of the terms that the queries have."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of BLOCK_TERMS terms, or one query's

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = terms_of(text or b"")
                if found:
                    own = sorted((known[t], c) for t, c in Counter(found).items() if t in known)
                    rows.append((doc, len(found), [t for t, _ in own], [c for _, c in own]))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(counted, FORWARD)


class Shard:
    """Documents with their impacts as a forward index, and for each term its documents sorted by impact."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """``starts``: of each document's entries in ``terms`` and ``impacts``; null ids are the largest number."""
        rows = np.repeat(np.arange(len(docs)), np.diff(starts))
        self.docs = docs
        self.present, columns = np.unique(terms, return_inverse=True)
        self.forward = np.zeros((len(self.present), len(docs)), np.int32)
        self.forward[columns, rows] = impacts
        order = np.lexsort((rows, -impacts, columns))
        self.listed, self.impacts = rows[order], impacts[order].astype(np.int64)
        self.ends = np.searchsorted(columns[order], np.arange(len(self.present) + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of at least the best k documents that reach ``bar``, and how many entries were read."""
        at = np.searchsorted(self.present, terms)
        here = at < len(self.present)
        here[here] = self.present[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        rows, scores, read = np.empty(0, np.int64), np.empty(0, np.int64), 0
        if not len(at):
            return rows, scores, read
        lists = [(self.listed[a:b], self.impacts[a:b]) for a, b in zip(self.ends[at], self.ends[at + 1], strict=True)]
        forward, met = self.forward[at], np.zeros(len(self.docs), bool)
        depth, step = 0, STEP
        while True:
            turn = np.unique(np.concatenate([docs[depth : depth + step] for docs, _ in lists]))
            read += sum(len(docs[depth : depth + step]) for docs, _ in lists)
            fresh = turn[~met[turn]]
            met[fresh] = True
            found = weights @ forward[:, fresh].astype(np.int64)  # random lookups
            rows, scores = np.concatenate([rows, fresh[found >= bar]]), np.concatenate([scores, found[found >= bar]])
            if len(scores) >= k:
                bar = max(bar, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                rows, scores = rows[scores >= bar], scores[scores >= bar]
            depth, step = depth + step, step * 2
            # an unmet document's impact is at most that read last; nothing is left of a list read to its end
            last = np.array([impacts[depth - 1] if depth < len(impacts) else 0 for _, impacts in lists], np.int64)
            if not last.any() or int(weights @ last) < bar:
                return rows, scores, read


def _impacts(n: np.ndarray, tfs: np.ndarray, counts: np.ndarray, total: int, length: int) -> np.ndarray:
    m = 25 + (75 * n * total) // length
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts))


def _merged(best: tuple[np.ndarray, np.ndarray], docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    docs, scores = np.concatenate([best[0], docs]), np.concatenate([best[1], scores])
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


LAST = np.iinfo(np.int64).max  # stands for a null id inside a task


def _search(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], bars: list[int], totals: tuple[int, int], width: int, k: int) -> DataFrame:
    """Each task's best k documents of every query, if they reach its bar."""
    held = index.sparkSession.sparkContext.broadcast((queries, bars))
    most = max(16, min(MOST_DOCS, CELLS // max(1, width)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, first = held.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked]
        for docs, n, starts, terms, tfs in _shards(batches, most):
            shard = Shard(docs, starts, terms, _impacts(n, tfs, np.diff(starts), *totals))
            for q, (own, weights) in enumerate(asked):
                bar = int(best[q][1][-1]) if len(best[q][1]) == k else 1
                rows, scores, _ = shard.search(own, weights, k, max(bar, first[q]))
                if len(rows):
                    best[q] = _merged(best[q], docs[rows], scores, k)
        ids = np.concatenate([d for d, _ in best]) if best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best), dtype=np.int32), [len(d) for d, _ in best])),
                pa.array(ids, mask=ids == LAST),
                pa.array(np.concatenate([s for _, s in best]) if best else np.empty(0, np.int64)),
            ],
            ["query", "doc_id", "score"],
        )

    return index.mapInArrow(searched, FOUND)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of at most ``most`` rows: ids, lengths, starts of the entries, terms, counts."""
    held: list[pa.RecordBatch] = []

    def made() -> tuple[np.ndarray, ...]:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
        ids = rows.column("doc_id").combine_chunks().fill_null(LAST).to_numpy()
        starts = terms.offsets.to_numpy().astype(np.int64)
        return ids, rows.column("n").to_numpy(), starts - starts[0], terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()

    for batch in batches:
        while batch.num_rows:
            taken = min(batch.num_rows, most - sum(b.num_rows for b in held))
            held.append(batch.slice(0, taken))
            batch = batch.slice(taken)
            if sum(b.num_rows for b in held) == most:
                yield made()
                held.clear()
    if held:
        yield made()


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """The queries, a block at a time: rows come to the driver one partition at a time."""
    block: list[tuple[int | None, Counter]] = []
    names: set[bytes] = set()
    for item, text in items.select(F.col(id_column).cast("long"), F.col(text_column)).toLocalIterator():
        own = Counter(terms_of((text or "").encode()))
        if block and (len(block) == BLOCK_ROWS or len(names | own.keys()) > BLOCK_TERMS):
            yield block
            block, names = [], set()
        if own:
            block.append((item, own))
            names |= own.keys()
    if block:
        yield block


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score: every item's best ``k`` documents of a score above 0."""
    spark, out = docs.sparkSession, None
    for block in _blocks(items, item_column, item_text):
        found = _rank_block(docs, block, k, id_column, text_column)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _rank_block(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    index = stored(forward_index(docs, vocabulary, id_column, text_column))
    total, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row a term
    queries = []
    for _, own in block:
        known = sorted((vocabulary[t], c) for t, c in own.items() if vocabulary[t] in having)
        weights = [c * math.floor(1000 * math.log((2 * total + 2) / (2 * having[t] + 1))) for t, c in known]
        queries.append((np.array([t for t, _ in known], np.int64), np.array(weights, np.int64)))
    search = lambda rows, bars: _search(rows, queries, bars, (total, max(1, length)), len(vocabulary), k)
    pilot = F.pmod(F.xxhash64(F.lit(11), "doc_id", "n", "terms"), F.lit(PILOT)) == 0
    # of the pilot's k best the last is a bar that the whole corpus's k best reach; fewer than k give none
    first = dict(_best(search(index.where(pilot), [1] * len(queries)), k).where(F.col("rank") == k).select("query", "score").collect())
    found = _best(search(index, [first.get(q, 1) for q in range(len(queries))]), k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query int, item_id long")
    answers = durable(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    discard(index)
    return answers


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
f AS (SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS len FROM f),
q AS (SELECT qid, item_id, term, count(*)::BIGINT AS times FROM (
  SELECT qid, item_id, unnest(terms) AS term FROM (
    SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM f)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, total),
i AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // len))) AS impact
  FROM p JOIN w USING (term), s),
r AS (SELECT qid, item_id, doc_id, rid, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rid) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
