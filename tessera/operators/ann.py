"""An approximate vector index (B11): coarse centroids, product-quantised codes, probes chosen by calibration.

Centroids and code books are fitted on the driver to a sample of at most ``SAMPLE`` vectors, those of smallest
hash; every row is indexed: it gets the bucket of its nearest centroid and a code of one byte for each ``PART``
components. A query looks into the buckets nearest to it, estimates distances from the codes by tables of its own,
and measures the best of these exactly. How many buckets, and how many of the estimated best, comes from
:func:`calibrate`: held-out rows are searched exactly in one pass over all rows, and the smallest numbers are
taken by which ``TARGET`` of their neighbours are found. New rows are assigned to the fitted centroids
(:func:`build`); the index is fitted anew once its rows have doubled.

Written in order of ``bucket`` a query reads only the row groups of the probed buckets, and vectors only of the
rows to be measured. Exact search stays the default; :func:`wanted` says from how many rows on an index pays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sampling import smallest
from tessera.operators import search

SAMPLE = 20_000
THRESHOLD = 1_000
ROUNDS = 8
PROBES = 8
PART = 4  # components that share a byte of the code
CODES = 256
HELD_OUT = 200
TARGET = 0.95
GROWTH = 2  # times the rows of the last fit


def wanted(rows: int, threshold: int = THRESHOLD) -> bool:
    return rows > threshold


def n_buckets(rows: int) -> int:
    """About the square root of the rows, within what a driver holds."""
    return int(min(4_096, max(4, round(rows**0.5))))


def _sample(rows: DataFrame, vector: str, id_column: str) -> np.ndarray:
    usable = rows.where(F.col(vector).isNotNull())
    few = smallest(usable, F.xxhash64(id_column), SAMPLE, usable.count())
    found = few.orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE).select(vector).collect()
    whole = [r[0] for r in found if None not in r[0]]
    width = max(map(len, whole), default=0)
    return np.array([v for v in whole if len(v) == width], np.float64).reshape(-1, width)


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Centroids by k-means, deterministic."""
    if not len(x):
        return np.zeros((0, 0))
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def fit(rows: DataFrame, buckets: int, vector: str = "vector", id_column: str = "id") -> np.ndarray:
    """Centroids of the sample."""
    return _means(_sample(rows, vector, id_column), buckets)


@dataclass(frozen=True)
class Index:
    """What a driver keeps of an index: centroids, a book of codes for each part, how far a search looks."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int = PROBES
    measured: int = 1_000
    recall: float = 0.0
    rows: int = 0

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A byte for each part of each row."""
        return np.stack([_nearest(x[:, i * PART : (i + 1) * PART], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of the query's parts with the codes' vectors, and these vectors' squares."""
        products, squares = np.zeros((len(self.books), CODES)), np.zeros((len(self.books), CODES))
        for i, book in enumerate(self.books):
            products[i, : len(book)], squares[i, : len(book)] = book @ query[i * PART : (i + 1) * PART], (book * book).sum(axis=1)
        return products, squares

    def estimates(self, codes: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
        """Distances of the codes' vectors to the query."""
        products, squares = self.tables(query)
        at = np.arange(len(self.books))[None, :], codes
        dot, square = products[at].sum(axis=1), squares[at].sum(axis=1)
        if metric == "l2":
            return square - 2 * dot + float(query @ query)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(1 - dot / (np.sqrt(square) * np.sqrt(float(query @ query))), nan=np.inf)

    def nearest_buckets(self, query: np.ndarray) -> np.ndarray:
        return np.argsort(((self.centres - query) ** 2).sum(axis=1), kind="stable")


def train(rows: DataFrame, buckets: int, vector: str = "vector", id_column: str = "id") -> Index:
    """Centroids and code books of one sample; not yet calibrated."""
    x = _sample(rows, vector, id_column)
    centres = _means(x, buckets)
    books = [_means(x[:, i : i + PART], min(CODES, max(1, len(x) // 4))) for i in range(0, centres.shape[1], PART)]
    return Index(centres, books)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _fitting(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the index's length and no null, and those as rows."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    fit_ = np.array([n == width for n in pc.list_value_length(values).to_pylist()], bool)
    rows = np.zeros((0, width))
    if fit_.any():
        rows = values.filter(pa.array(fit_)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        whole = np.isfinite(rows).all(axis=1)
        fit_[np.flatnonzero(fit_)[~whole]] = False
        rows = rows[whole]
    return fit_, rows


def bucket(vector: Column, centres: np.ndarray) -> Column:
    """The number of the nearest centroid; null for null vectors and those of another length."""
    width = centres.shape[1]

    @F.arrow_udf("int")
    def over(values: pa.Array) -> pa.Array:
        fit_, rows = _fitting(values, width)
        out = np.zeros(len(values), np.int32)
        if len(rows):
            out[fit_] = _nearest(rows, centres)
        return pa.array(out, mask=~fit_)

    return over(vector)


def codes(vector: Column, index: Index) -> Column:
    """The bytes of a vector's codes; null where the bucket is."""

    @F.arrow_udf("binary")
    def over(values: pa.Array) -> pa.Array:
        fit_, rows = _fitting(values, index.width)
        out: list[bytes | None] = [None] * len(values)
        for at, code in zip(np.flatnonzero(fit_), index.codes(rows) if len(rows) else [], strict=True):
            out[at] = code.tobytes()
        return pa.array(out, pa.binary())

    return over(vector)


def build(rows: DataFrame, centres: np.ndarray | Index, vector: str = "vector") -> DataFrame:
    """``rows`` with their bucket and, by an :class:`Index`, their codes."""
    if isinstance(centres, Index):
        return rows.withColumn("bucket", bucket(F.col(vector), centres.centres)).withColumn("codes", codes(F.col(vector), centres))
    return rows.withColumn("bucket", bucket(F.col(vector), centres))


def probes(query: list[float], centres: np.ndarray, n: int) -> list[int]:
    q = np.array(query, np.float64)
    return [int(k) for k in np.argsort(((centres - q) ** 2).sum(axis=1), kind="stable")[:n]]


def topk(indexed: DataFrame, centres: np.ndarray, query: list[float], k: int = 10, n_probes: int = PROBES, metric: str = "l2", id_column: str = "id", vector: str = "vector") -> DataFrame:
    """The best rows of the probed buckets: a filter that prunes partitions, then the exact top-k."""
    chosen = indexed.where(F.col("bucket").isin(probes(query, centres, n_probes)))
    return search.vector_topk(chosen, query, k, metric, id_column, vector)


def estimated(indexed: DataFrame, index: Index, query: list[float], metric: str = "l2", id_column: str = "id") -> DataFrame:
    """The rows to be measured exactly: the best by their codes of the probed buckets; vectors of no others are read.

    The driver gets ``index.measured`` ids at most.
    """
    q = np.array(query, np.float64)

    @F.arrow_udf("double")
    def estimate(values: pa.Array) -> pa.Array:
        held = values.to_pylist()
        return pa.array(index.estimates(np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1), q, metric) if held else np.zeros(0))

    near = [int(b) for b in index.nearest_buckets(q)[: index.probes]]
    probed = indexed.where(F.col("bucket").isin(near) & F.col("codes").isNotNull())
    best = probed.select(id_column, estimate(F.col("codes")).alias("estimate")).orderBy("estimate", id_column).limit(index.measured)
    return indexed.where(F.col("bucket").isin(near) & F.col(id_column).isin([r[0] for r in best.select(id_column).collect()]))


def _exact(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum((rows * rows).sum(axis=1)[None, :] - 2 * queries @ rows.T + (queries * queries).sum(axis=1)[:, None], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(1 - (queries @ rows.T) / (np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None, :]), nan=np.inf)


def search_many(indexed: DataFrame, index: Index, queries: list[tuple[str, list[float]]], k: int = 10, metric: str = "l2", exact: bool = False, id_column: str = "id") -> DataFrame:
    """query, rank, id, distance, estimate and bucket for a block of queries (id and vector) in one pass over the rows.

    As :func:`estimated` and an exact ranking do it for one query; ``exact`` looks at all rows. A query's own row
    is left out. A task returns at most ``index.measured`` rows a query, or k.
    """
    names, points = [n for n, _ in queries], np.array([v for _, v in queries], np.float64)
    kept = k if exact else index.measured
    near = np.zeros((len(queries), len(index.centres)), bool)
    for i, q in enumerate(points):
        near[i, index.nearest_buckets(q)[: index.probes]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in names]
        for batch in batches:
            fit_, rows = _fitting(batch.column(1), index.width)
            if not len(rows):
                continue
            ids_, buckets = np.array(batch.column(0).to_pylist(), object)[fit_], batch.column(2).to_numpy(zero_copy_only=False)[fit_].astype(np.int64)
            own = index.codes(rows)
            distances = _exact(rows, points, metric)
            for i, q in enumerate(points):
                at = np.flatnonzero((ids_ != names[i]) & (exact | near[i, buckets]))
                estimates = index.estimates(own[at], q, metric)
                order = distances[i, at] if exact else estimates
                few = np.argsort(order, kind="stable")[:kept] if len(at) <= 4 * kept else np.argpartition(order, kept)[:kept]
                best[i] += [(float(order[j]), ids_[at[j]], float(distances[i, at[j]]), float(estimates[j]), int(buckets[at[j]])) for j in few]
                best[i] = sorted(best[i])[:kept]
        rows_ = [(n, *b) for n, found in zip(names, best, strict=True) for b in found]
        columns = list(zip(*rows_, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "score", "id", "distance", "estimate", "bucket"])

    slim = indexed.select(F.col(id_column).cast("string").alias("id"), "vector", "bucket")
    found = slim.mapInArrow(run, "query string, score double, id string, distance double, estimate double, bucket int")
    first = Window.partitionBy("query").orderBy("score", "id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= kept)
    last = Window.partitionBy("query").orderBy(F.round("distance", search.DIGITS), "id")
    found = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return found.select("query", "rank", "id", F.round("distance", search.DIGITS).alias("distance"), "estimate", "bucket")


def held_out(rows: DataFrame, n: int = HELD_OUT, vector: str = "vector", id_column: str = "id", seed: int = 2) -> list[tuple[str, list[float]]]:
    """Rows that stand for queries: those of smallest hash under a seed of their own, ``n`` at most."""
    usable = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    key = F.xxhash64(F.lit(seed), id_column)
    few = smallest(usable, key, n, usable.count()).orderBy(key, id_column).limit(n)
    return [(str(r[0]), list(r[1])) for r in few.select(id_column, vector).collect()]


def calibrate(indexed: DataFrame, index: Index, k: int = 10, target: float = TARGET, queries: list[tuple[str, list[float]]] | None = None, metric: str = "l2", id_column: str = "id") -> Index:
    """``index`` with the least probes, and then the least measured rows, that find ``target`` of the neighbours.

    Two passes over the rows for a bounded block of held-out queries; the driver gets k rows a query.
    """
    queries = held_out(indexed, id_column=id_column) if queries is None else queries
    queries = [(n, v) for n, v in queries if len(v) == index.width]
    if not queries:
        return index
    truth = search_many(indexed, index, queries, k, metric, True, id_column).collect()
    order = {n: index.nearest_buckets(np.array(v, np.float64)) for n, v in queries}
    depth = np.sort([int(np.flatnonzero(order[r["query"]] == r["bucket"])[0]) + 1 for r in truth])
    if not len(depth):
        return index
    # one half of the loss for the buckets, the other for the codes
    reach = 1 - (1 - target) / 2
    n_probes = int(depth[min(len(depth) - 1, int(np.ceil(reach * len(depth))) - 1)])
    limits = {n: np.sort([r["estimate"] for r in truth if r["query"] == n and np.flatnonzero(order[n] == r["bucket"])[0] < n_probes]) for n, _ in queries}
    ahead = np.sort(_ahead(indexed, index, queries, limits, order, n_probes, metric))
    lost = len(truth) - len(ahead)
    wanted_ = int(np.ceil(target * len(truth)))
    measured = int(ahead[min(len(ahead), max(1, wanted_)) - 1]) + 1 if len(ahead) else k
    found = int((ahead < max(measured, k)).sum())
    return Index(index.centres, index.books, n_probes, max(measured, k), found / (found + lost + int((ahead >= max(measured, k)).sum())), indexed.count())


def _ahead(indexed: DataFrame, index: Index, queries: list, limits: dict, order: dict, n_probes: int, metric: str) -> np.ndarray:
    """For each neighbour in the probed buckets, how many of their rows have a lower estimate."""
    points = [(np.array(v, np.float64), limits[n], set(order[n][:n_probes].tolist())) for n, v in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(limit), np.int64) for _, limit, _ in points]
        for batch in batches:
            fit_, rows = _fitting(batch.column(0), index.width)
            if not len(rows):
                continue
            buckets, own = batch.column(1).to_numpy(zero_copy_only=False)[fit_].astype(np.int64), index.codes(rows)
            for count, (q, limit, near) in zip(counts, points, strict=True):
                if len(limit):
                    estimates = np.sort(index.estimates(own[np.isin(buckets, list(near))], q, metric))
                    count += np.searchsorted(estimates, limit, "left")
        flat = [(i, j, int(c)) for i, count in enumerate(counts) for j, c in enumerate(count)]
        columns = list(zip(*flat, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["query", "place", "ahead"])

    counted = indexed.select("vector", "bucket").mapInArrow(run, "query int, place int, ahead long")
    return np.array([r[0] for r in counted.groupBy("query", "place").agg(F.sum("ahead")).select("sum(ahead)").collect()], np.int64)  # k rows a query

