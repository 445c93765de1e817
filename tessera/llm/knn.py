"""Exact top-k search by inner product as a Voronoi join (operator 3).

Method. Pivots divide the vectors into cells. Each cell is summed up by its size, its radius and the k nearest
vectors to its pivot. From these summaries every query gets a lower bound of its k-th best score (a vector at
distance d from pivot p scores at least q.p - |q| d), and, with q.x <= q.p + |q| d, a least distance from each
pivot that a vector must have to matter. Queries of neighbouring cells form groups of at most ``GROUP``; the
least of these distances over a group decides which vectors are replicated to it. The data is cut into slices
of at most ``SLICE`` vectors, by cell and by ring of distance to the pivot, small ones of neighbouring cells
together; a query goes only to slices that its own bound reaches. Each (group, slice) is solved locally, and
the slices' top k are merged.

Scores are integers and exact. Components are integers held in doubles, which loses nothing. Products run in
doubles; where a sum may pass 2^53, doubles with an error bound choose the candidates and Python integers
score them. Bounds are widened by ``SLACK`` of the products' size, so rounding prunes nothing that counts.

Scale. Pivots are a sample of the vectors of smallest hash, as many as the root of their number, between
``PIVOTS`` and ``MOST_PIVOTS``; the summaries are one row per cell and per ring, the bounds one per group and
cell. Bounds are broadcast when they are at most ``BROADCAST_BOUNDS`` rows, which is counted; beyond, they are
joined by (cell, salt). A task holds one slice and one group, whatever the sizes of cells, so that a hot vector
or cell is spread over slices and groups. For data without clusters no exact bound prunes much, and the work
is that of every query against every vector; a vector is then sent once for each ``GROUP`` queries.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
all other vectors do, of any size. Where lengths differ, the shorter one counts as ending in zeros (an empty
vector as zero). A double so large that 256 times it is infinite counts as non-finite. Scores beyond a long
are cut to its ends in the result, after ranking. Rows with the query's id are its own and no candidates;
repeated rows are candidates of their own, in ties by id and then as repeated; a query's id that occurs more
than once asks once for each row, and the best k of all answers count; with fewer than k candidates all are
returned; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, parallelism, smallest

K = 5
SCALE = 256.0
EVERY = 50
PIVOTS = 48
MOST_PIVOTS = 4_096
GROUP = 4_096
SLICE = 8_192
LEAST_SLICE = 256
RINGS = 64
BROADCAST_BOUNDS = 500_000
SLACK = 1e-9
SAFE = 2.0**53
END = (1 << 63) - 1
#: Numbers in a matrix that one step of a task makes.
STEP = 1 << 22


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and v (array of doubles without fractions, floor(scale * x)) of the rows that take part."""
    x = F.col(column)

    def scaled(c):
        return F.lit(scale) * c.cast("double")

    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < F.lit(float("inf"))))
    # from 2^53 on a double has no fraction; floor() would cut it to a long
    floor = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < SAFE, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), floor.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _steps(n: int, width: int) -> Iterator[slice]:
    step = max(1, STEP // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, cell and distance to the cell's pivot."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (pivots * pivots).sum(axis=1)
            for batch in batches:
                cell, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch))
                for part in _steps(len(batch), max(width, len(pivots))):
                    x = _matrix(batch.column(1)[part], width)
                    cell[part] = np.nan_to_num(squares[None, :] - 2 * x @ pivots.T, nan=np.inf).argmin(axis=1)
                    apart = np.sqrt(((x - pivots[cell[part]]) ** 2).sum(axis=1))
                    distance[part] = np.where(np.isnan(apart), np.inf, apart)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(distance)], names=["vec_id", "v", "cell", "distance"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, cell int, distance double")


class Bounds:
    """What the summaries say of a query: how far from each pivot a vector must lie to matter."""

    def __init__(self, pivots: np.ndarray, near: list[tuple[int, float, int]], radius: np.ndarray, k: int):
        """``near`` has (cell, distance, vec_id) of the vectors nearest to each pivot."""
        self.pivots, self.radius, self.k = pivots, radius, k
        self.cell = np.array([c for c, _, _ in near], np.int64)
        self.distance = np.array([d for _, d, _ in near], float)
        self.ids = np.array([i for _, _, i in near], np.int64)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((pivots * pivots).sum(axis=1))

    def needed(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            norm = np.sqrt((q * q).sum(axis=1))[:, None]
            dots = q @ self.pivots.T
            low = dots[:, self.cell] - norm * self.distance - SLACK * norm * (self.norm[self.cell] + self.distance)
            low = np.where(np.isnan(low) | (self.ids[None, :] == ids[:, None]), -np.inf, low)  # own rows are no candidates
            floor = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k, None] if low.shape[1] >= self.k else np.full((len(q), 1), -np.inf)
            out = (floor - dots) / norm - SLACK * (self.norm + self.radius)
            return np.where(np.isnan(out) | (norm == 0), -np.inf, out)


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by a near one that is still free."""
    order, free, at = [], np.ones(len(pivots), bool), 0
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (pivots * pivots).sum(axis=1)
        while True:
            order.append(at)
            free[at] = False
            if not free.any():
                return order
            away = np.nan_to_num(squares - 2 * pivots @ pivots[at], nan=np.inf)
            at = int(np.flatnonzero(free)[away[free].argmin()])


def _dealt(order: list, sizes: dict, limit: int) -> tuple[dict, int]:
    """For each item (number of the first bin, bins), filled in ``order`` up to ``limit``; how many bins there are."""
    out, bins, full = {}, 0, limit
    for item in order:
        n = sizes.get(item, 0)
        parts = -(-n // limit)
        if parts > 1:
            out[item], bins, full = (bins, parts), bins + parts, limit
        else:
            if full + n > limit:
                bins, full = bins + 1, 0
            out[item], full = (bins - 1, 1), full + n
    return out, bins


def best_of(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vec id, score) of each query's k best rows of ``data``, ties to smaller ids; own rows left out."""
    order = np.argsort(data_ids, kind="stable")
    data, data_ids = data[order], data_ids[order]
    width, found = queries.shape[1], []
    with np.errstate(over="ignore", invalid="ignore"):
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, width) < SAFE
        if not exact:
            distinct, which = np.unique(data, axis=0, return_inverse=True)
            which = which.reshape(-1)
            size = np.sqrt((data * data).sum(axis=1)) * (width + 4) * 2.0**-52
        for part in _steps(len(queries), len(data)):
            scores = queries[part] @ data.T
            own = query_ids[part][:, None] == data_ids[None, :]
            for q, me, mine, row in zip(queries[part], query_ids[part], own, scores, strict=True):
                at = np.flatnonzero(~mine)
                if exact:
                    value = row[at]
                    if len(at) > k:
                        edge = np.partition(value, len(at) - k)[-k]
                        above, level = at[value > edge], at[value == edge]
                        at = np.concatenate((above, level[: k - len(above)]))
                    scored = {j: int(row[j]) for j in at}
                else:
                    error = math.sqrt(q @ q) * size[at]
                    low, high = row[at] - error, row[at] + error
                    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
                    if len(at) > k:
                        at = at[high >= np.partition(low, len(at) - k)[-k]]
                    whole = [int(c) for c in q]
                    by_row = {d: sum(a * int(b) for a, b in zip(whole, distinct[d], strict=True)) for d in np.unique(which[at])}
                    scored = {j: by_row[which[j]] for j in at}
                best = sorted(scored, key=lambda j, scored=scored: (-scored[j], j))[:k]
                found += [(int(me), int(data_ids[j]), max(-END, min(END, scored[j]))) for j in best]
    return found


def join_sides(vectors: DataFrame, every: int, k: int, group: int, slice_rows: int, n_pivots: int | None, broadcast_bounds: int, **columns) -> tuple[DataFrame, DataFrame, int] | None:
    """The queries (grp, slice, query_id, q) and the data (grp, slice, vec_id, v) to solve, and the vectors' length."""
    rows = durable(quantised(vectors, **columns))
    total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(total)))
    slice_rows = max(1, min(slice_rows, STEP * 8 // width, max(LEAST_SLICE, total // parallelism(rows))))  # a slice for each core
    hashed = rows.select("v", F.xxhash64("vec_id").alias("h"))
    few = smallest(hashed, F.col("h"), 4 * n_pivots, total)
    drawn = few.groupBy("v").agg(F.min("h").alias("h")).orderBy("h", "v").limit(n_pivots).collect()
    if not drawn:
        return None
    pivots = np.zeros((len(drawn), width))
    for pivot, r in zip(pivots, drawn, strict=True):
        pivot[: len(r["v"])] = r["v"]
    # a number of its own for each row of the written table: what deals rows parts those that are equal, too
    cells = durable(_assign(rows, pivots).withColumn("row", F.monotonically_increasing_id()))
    is_query = F.col("vec_id") % every == 0
    # the k nearest of a cell: first by salt, with bounded windows, then of the salts
    first = Window.partitionBy("cell", "salt").orderBy("distance", "vec_id")
    ranked = cells.select("cell", "vec_id", "distance", F.pmod(F.xxhash64("row"), F.lit(256)).alias("salt")).withColumn("r", F.row_number().over(first))
    nearest = ranked.where(F.col("r") <= k).groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k).alias("nearest"))
    sums = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.count_if(is_query).alias("queries"))
    summary = sums.join(nearest, "cell").collect()  # a row per pivot
    radius, near = np.zeros(len(pivots)), []
    for r in summary:
        radius[r["cell"]] = r["radius"]
        near += [(r["cell"], x["distance"], x["vec_id"]) for x in r["nearest"]]
    bounds, chain = Bounds(pivots, near, radius, k), _chain(pivots)

    groups, n_groups = _dealt(chain, {r["cell"]: r["queries"] for r in summary}, group)
    per_cell = [(r["cell"], float(r["radius"]), min(RINGS, -(-r["n"] // slice_rows)), *groups[r["cell"]]) for r in summary]
    spark = vectors.sparkSession
    about = F.broadcast(spark.createDataFrame(per_cell, "cell int, radius double, rings int, first_group long, groups long"))  # a row per pivot
    ring = F.least(F.col("rings") - 1, F.floor(F.coalesce(F.try_divide("distance", "radius"), F.lit(0.0)) * F.col("rings"))).cast("int")
    ringed = cells.join(about, "cell").withColumn("ring", F.when(F.col("radius") < float("inf"), ring).otherwise(0))
    counted = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).collect()  # at most RINGS a cell
    place = {c: i for i, c in enumerate(chain)}
    pieces = {(r["cell"], r["ring"]): r["n"] for r in counted}
    slices, n_slices = _dealt(sorted(pieces, key=lambda p: (place[p[0]], p[1])), pieces, slice_rows)
    # for every slice, in order, the pieces that lie in it: their cells, how far they reach, where a slice begins
    pairs = sorted((begin + i, r["cell"], r["far"]) for r in counted for begin, n in [slices[r["cell"], r["ring"]]] for i in range(n))
    piece_cell, piece_far = np.array([c for _, c, _ in pairs], np.int64), np.array([far for *_, far in pairs])
    starts = np.searchsorted([s for s, *_ in pairs], np.arange(n_slices))
    cut = F.broadcast(spark.createDataFrame([(c, r, *slices[c, r]) for c, r in pieces], "cell int, ring int, first_slice long, slices long"))  # at most RINGS a cell
    data = ringed.join(cut, ["cell", "ring"]).select(
        "vec_id", "v", "cell", "distance", (F.col("first_slice") + F.pmod(F.xxhash64(F.lit(1), "row"), F.col("slices"))).alias("slice")
    )
    grouped = ringed.where(is_query).select((F.col("first_group") + F.pmod(F.xxhash64(F.lit(2), "row"), F.col("groups"))).alias("grp"), "vec_id", "v")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row per query and slice that its bound reaches
        for batch in batches:
            for part in _steps(len(batch), max(width, len(piece_cell), len(near))):
                own = batch[part]
                needed = bounds.needed(own.column(1).to_numpy(zero_copy_only=False), _matrix(own.column(2), width))
                met = np.logical_or.reduceat(needed[:, piece_cell] <= piece_far[None, :], starts, axis=1)
                at, to = np.nonzero(met)
                taken = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(to, pa.int64()), taken.column(1), taken.column(2)], names=["grp", "slice", "query_id", "q"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group_of = batch.column(0).to_numpy(zero_copy_only=False)
            lowest: dict[int, np.ndarray] = {}
            for part in _steps(len(batch), max(width, len(near))):
                needed = bounds.needed(batch.column(1)[part].to_numpy(zero_copy_only=False), _matrix(batch.column(2)[part], width))
                for g in np.unique(group_of[part]):
                    here = needed[group_of[part] == g].min(axis=0)
                    lowest[g] = np.minimum(lowest[g], here) if g in lowest else here
            for g, values in lowest.items():
                cell = np.flatnonzero(values <= radius)  # other cells have no vector that matters
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g), pa.int64()), pa.array(cell, pa.int32()), pa.array(values[cell])], names=["grp", "cell", "needed"])

    limits = durable(grouped.mapInArrow(least, "grp long, cell int, needed double").groupBy("grp", "cell").agg(F.min("needed").alias("needed")))
    if limits.limit(broadcast_bounds + 1).count() <= broadcast_bounds:
        met = data.join(F.broadcast(limits), "cell")
    else:
        salts = 64
        spread = limits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        met = data.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(salts))).join(spread.hint("merge"), ["cell", "salt"])
    sent = met.where(F.col("distance") >= F.col("needed")).select("grp", "slice", "vec_id", "v")
    return grouped.mapInArrow(asked, "grp long, slice long, query_id long, q array<double>"), sent, width


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, group: int = GROUP, slice_rows: int = SLICE, n_pivots: int | None = None, broadcast_bounds: int = BROADCAST_BOUNDS, **columns) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query (rows whose id is divisible by ``every``)."""
    sides = join_sides(vectors, every, k, group, slice_rows, n_pivots, broadcast_bounds, **columns)
    if sides is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, sent, width = sides

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            found = best_of(_matrix(left["q"], width), left["query_id"].to_numpy(), _matrix(right["v"], width), right["vec_id"].to_numpy(), k)
        frame = pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
        return pa.Table.from_pandas(frame, preserve_index=False)

    partial = asked.groupBy("grp", "slice").cogroup(sent.groupBy("grp", "slice")).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
