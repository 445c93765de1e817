"""SimHash near-dedup over vantage-point trees (operator 6).

Method. Fingerprints are taken per document. Two fingerprints that differ in at most ``RADIUS`` = 3 bits
differ in at most one bit of the lower or of the upper half, so there are two vantage-point trees, each over
the Hamming distance of one half, with radius 1. At a node, fingerprints within ``mu`` bits of the vantage
point go in, the rest out. By the triangle bound an outer one can have an inner partner only if its distance
is at most ``mu`` + 1; only such also visit the inner side, and all other branches are pruned. Every pair
therefore meets in a leaf of one of the trees, where it is checked over all 64 bits; leaves are solved by the
same cuts, down to bit counts. Leaves return spanning links, not pairs.

(With one tree over all 64 bits and radius 3, distances crowd so near 32 bits that a quarter of the points
cross at each level, and visits grow twice as fast as the input.)

The trees are fitted on the driver to a sample of at most ``SAMPLE`` fingerprints (those of smallest hash),
which decides only where fingerprints meet, never which ones; ``mu`` minimises the work of both sides.
Leaves that hold more than ``LEAF_CAP`` fingerprints grow trees of their own, in the tasks and on their own
samples, round by round, so that leaves stay small however many fingerprints there are. A leaf that no cut
helps, such as a dense cluster, is cut into blocks, and each pair of blocks is a task of its own; so it stays
exact and bounded in memory at any size.

Cases: no words: fingerprint zero, linked like any other; null text counts as empty; rows with a null id take
part and get the smallest non-null id reachable, or null if there is none; repeated rows have equal results;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, bounded, durable, parallelism, row_hash, smallest
from tessera.llm.graph import star_components

RADIUS = 3
HALVES = ((1 << 32) - 1, ((1 << 32) - 1) << 32)
REACH = RADIUS // len(HALVES)
SHINGLE = 3
SEED = 42
SAMPLE = 1 << 14
LEAF_TARGET = 6_000
LEAF_CAP = 40_000
BRUTE = 1_500
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _word_runs(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of the text, about ``size`` bytes at a time, so that a very long text is never a list of words."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    total, n, last = np.zeros(64, np.int64), 0, []
    for words in _word_runs((text or b"").lower()):  # bytes: A-Z and the ASCII white space only
        words = last + words
        if len(words) >= shingle:
            h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in zip(*(words[k:] for k in range(shingle)), strict=False)), "<u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
        last = words[1 - shingle :] if shingle > 1 else []
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint_bits`` (long) in place of the text."""
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text_column]
    packed = docs.select(F.col(f"`{text_column}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch.column(0).cast(pa.binary()).to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays([pa.array(bits.view("<i8")), batch.column(1)], names=["bits", "row"])

    out = packed.mapInArrow(run, f"bits long, row {packed.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("bits").alias("fingerprint_bits"))


@dataclass
class Node:
    leaf: int = -1
    point: int = 0
    mu: int = 0
    inner: Node | None = field(default=None)
    outer: Node | None = field(default=None)


def _distance(points: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)


def _best_cut(points: np.ndarray, mask: int, reach: int, tries: int = 6) -> tuple[int, int, float]:
    """(vantage point, mu, share of the pair work that is left) of the best of some evenly spaced candidates."""
    best = (0, -1, 1.0)
    seen = points if len(points) <= 4096 else points[:: len(points) // 4096]
    n = len(seen)
    for point in np.unique(seen[:: max(1, n // tries)])[:tries]:
        below = np.cumsum(np.bincount(_distance(seen, int(point), mask), minlength=65))  # below[d]: within d bits
        for mu in range(64 - reach):
            inside, outside = below[mu + reach], n - below[mu]
            work = (float(inside) ** 2 + float(outside) ** 2) / float(n) ** 2
            if work < best[2] and inside < n and outside < n:
                best = (int(point), mu, work)
    return best


class VantageTree:
    """A tree over the distance of the bits in ``mask``; ``route`` gives each point its leaf and those it reaches."""

    def __init__(self, sample: np.ndarray, mask: int, reach: int, scale: float, target: int, first_leaf: int = 0):
        self.mask, self.reach, self.leaves = mask, reach, first_leaf
        self.root = self._grow(np.unique(sample), scale, target)

    def _grow(self, points: np.ndarray, scale: float, target: int) -> Node:
        cut = _best_cut(points, self.mask, self.reach) if len(points) * scale > target and len(points) >= 8 else None
        if cut is None or cut[2] > 0.9:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        d = _distance(points, cut[0], self.mask)
        inner = self._grow(points[d <= cut[1] + self.reach], scale, target)
        return Node(-1, cut[0], cut[1], inner, self._grow(points[d > cut[1]], scale, target))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, leaf) for every visit."""
        found: list[tuple[np.ndarray, int]] = []
        open_nodes = [(self.root, np.arange(len(points)))]
        while open_nodes:
            node, at = open_nodes.pop()
            if node.leaf >= 0:
                found.append((at, node.leaf))
            elif len(at):
                d = _distance(points[at], node.point, self.mask)
                open_nodes += [(node.inner, at[d <= node.mu + self.reach]), (node.outer, at[d > node.mu])]
        return np.concatenate([x for x, _ in found]), np.concatenate([np.full(len(x), k, np.int64) for x, k in found])


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the pairs; labels end as the smallest index reachable."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def _solve(points: np.ndarray, at: np.ndarray, labels: np.ndarray, mask: int, reach: int) -> None:
    """Join all of ``points[at]`` within ``RADIUS`` bits that are also within ``reach`` bits of ``mask``."""
    if len(at) > BRUTE:
        point, mu, work = _best_cut(points[at], mask, reach)
        if work <= 0.9:
            d = _distance(points[at], point, mask)
            _solve(points, at[d <= mu + reach], labels, mask, reach)
            _solve(points, at[d > mu], labels, mask, reach)
            return
    own, step = points[at], max(1, (1 << 20) // max(1, len(at)))
    for k in range(0, len(at), step):
        close = np.bitwise_count(own[k : k + step, None] ^ own[None, k:]) <= RADIUS
        i, j = np.nonzero(close)
        apart = i < j
        if apart.any():
            _hook(labels, at[i[apart] + k], at[j[apart] + k])


def spanning_links(points: np.ndarray, mask: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, root of its component among ``points``) found over ``mask`` with ``reach``."""
    points = np.unique(points)
    labels = np.arange(len(points))
    _solve(points, np.arange(len(points)), labels, mask, reach)
    moved = np.flatnonzero(labels != np.arange(len(points)))
    return points[moved], points[labels[moved]]


def _leaf_links(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_links(pdf["fp"].to_numpy("<i8").view("<u8"), HALVES[int(pdf["tree"].iloc[0])], REACH)
    return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})


def _visits(trees: list[VantageTree], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, tree, leaf) over all trees."""
    ways = [tree.route(points) for tree in trees]
    tree = [np.full(len(at), t, np.int32) for t, (at, _) in enumerate(ways)]
    return np.concatenate([x for x, _ in ways]), np.concatenate(tree), np.concatenate([x for _, x in ways])


VISIT = "tree int, leaf long, fp long"


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype("<i8").view("<u8")


def _sizes(visits: DataFrame, above: int) -> DataFrame:
    """tree, leaf and n of the leaves with more than ``above`` fingerprints."""
    return visits.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above)


def _subtrees(visits: DataFrame, large: DataFrame, leaf_target: int, sample: int) -> DataFrame:
    """A tree for each large leaf, grown in the tasks on the leaf's fingerprints of smallest hash, about ``sample``."""
    share = F.col("n") / sample
    few = visits.join(large, ["tree", "leaf"]).where(F.pmod(F.xxhash64("fp", F.lit(7)), F.ceil(share).cast("long")) == 0)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf["fp"].to_numpy("<i8").view("<u8")
        tree, n = int(pdf["tree"].iloc[0]), int(pdf["n"].iloc[0])
        grown = VantageTree(points, HALVES[tree], REACH, max(1.0, n / max(1, len(points))), leaf_target)
        return pd.DataFrame({"tree": pd.Series([tree], dtype="int32"), "leaf": [int(pdf["leaf"].iloc[0])], "grown": [pickle.dumps(grown)], "leaves": pd.Series([grown.leaves], dtype="int32")})

    return few.groupBy("tree", "leaf").applyInPandas(grow, "tree int, leaf long, grown binary, leaves int")


def _routed(visits: DataFrame, subtrees: DataFrame, n_parts: int, salts: int = 16) -> DataFrame:
    """Visits of large leaves to the leaves of their subtrees. A subtree is sorted before its visits, in each of the
    ``salts`` deals of a leaf, and a task holds one at a time."""
    spread = subtrees.select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("fp"), "grown")
    asked = visits.join(subtrees.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    asked = asked.select("tree", "leaf", F.pmod(F.xxhash64("fp", F.lit(8)), F.lit(salts)).cast("int").alias("salt"), "fp", F.lit(None).cast("binary").alias("grown"))
    sorted_ = spread.unionByName(asked).repartition(n_parts, "tree", "leaf", "salt").sortWithinPartitions("tree", "leaf", "salt", F.col("fp").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, tree, leaf = None, 0, 0
        for batch in batches:
            heads = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for begin, end in zip([0, *(k + 1 for k in heads)], [*heads, len(batch)], strict=True):
                if begin and begin - 1 in heads:
                    grown, tree, leaf = pickle.loads(batch.column(4)[begin - 1].as_py()), batch.column(0)[begin - 1].as_py(), batch.column(1)[begin - 1].as_py()
                part = batch.slice(begin, end - begin)
                if len(part):
                    points = _unsigned(part.column(3))
                    at, below = grown.route(points)
                    # a number of its own for each leaf below; two that met by chance would be solved together, no harm
                    names = _mixed(np.uint64(leaf & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + below.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(names.view("<i8")), pa.array(points[at].view("<i8"))], names=["tree", "leaf", "fp"])

    return sorted_.mapInArrow(run, VISIT)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def links(distinct: DataFrame, leaf_target: int = LEAF_TARGET, leaf_cap: int = LEAF_CAP, sample: int = SAMPLE) -> DataFrame:
    """Spanning links (a, b) over the distinct fingerprints in column ``fp``."""
    count = distinct.count()
    few = smallest(distinct, F.xxhash64("fp"), sample, count)
    points = np.array([r[0] for r in few.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], "<i8").view("<u8")
    scale, trees = max(1.0, count / max(1, len(points))), []
    for mask in HALVES:
        trees.append(VantageTree(points, mask, REACH, scale, leaf_target, trees[-1].leaves if trees else 0))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _unsigned(batch.column(0))
            at, tree, leaf = _visits(trees, own)
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int64()), pa.array(own[at].view("<i8"))], names=["tree", "leaf", "fp"])

    visits = distinct.select("fp").mapInArrow(dealt, VISIT)
    large = durable(_sizes(visits, leaf_cap))
    parts = []
    while not large.isEmpty():
        # leaves above the cap: cut by trees of their own, or, where no cut would help, into blocks of pairs
        visits = durable(visits)
        subtrees = durable(_subtrees(visits, large, leaf_target, sample))
        whole = durable(large.join(subtrees.where("leaves = 1").select("tree", "leaf"), ["tree", "leaf"], "left_semi"))
        parts.append(_in_blocks(visits.join(whole, ["tree", "leaf"]), leaf_cap))
        small = visits.join(large.select("tree", "leaf"), ["tree", "leaf"], "left_anti")
        parts.append(small.withColumn("part", F.lit(0).cast("long")))
        visits = _routed(visits, subtrees.where("leaves > 1"), parallelism(distinct))
        large = durable(_sizes(visits, leaf_cap))
    parts.append(visits.withColumn("part", F.lit(0).cast("long")))
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy("tree", "leaf", "part").applyInPandas(_leaf_links, "a long, b long")


def _in_blocks(visits: DataFrame, leaf_cap: int) -> DataFrame:
    """``visits`` (with n, the leaf's size) dealt into blocks: block x of a leaf meets block y in the part of (x, y)."""
    blocks = F.ceil(2 * F.col("n") / leaf_cap).cast("long")
    x = F.pmod(F.xxhash64("fp", F.lit(9)), blocks)
    each = visits.select("tree", "leaf", "fp", blocks.alias("blocks"), x.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("y"))
    return each.select("tree", "leaf", "fp", (F.least("x", "y") * F.col("blocks") + F.greatest("x", "y")).alias("part"))


def components(marked: DataFrame, fp: str = "fingerprint_bits", **sizes) -> DataFrame:
    """Per distinct fingerprint: fp, root (the component's smallest fingerprint)."""
    distinct = durable(marked.select(F.col(fp).alias("fp")).distinct())
    stars = star_components(links(distinct, **sizes))
    return distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **sizes) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    marked = durable(fingerprints(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))))
    groups = marked.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = durable(components(marked, **sizes).join(groups, "fp"))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = roots.join(names, "root").select(F.col("fp").alias("fingerprint_bits"), "component_id")
    return marked.join(labelled, "fingerprint_bits").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **sizes) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id (null last), columns unchanged.

    Of rows with that id the one with the least hash of its text stays, then the one with the least hash of all
    its columns; rows equal in all of these are the same, and one of them stays. Winners are chosen among slim
    rows (id, hashes, fingerprint), so that only these pass through Python and are sorted. Whole rows are then
    filtered by the slim rows that go; where these are more than ``common.BROADCAST_ROWS``, that is one
    exchange. Rows that have equals are brought together by a grouping with map-side partial results.
    """
    order = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit((1 << 63) - 1))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), order.alias("o"), F.xxhash64(text).alias("print"), row_hash(docs).alias("tie")
    )
    key = ["o", "print", "tie"]
    marked = durable(fingerprints(keyed.select(*key, F.col(f"whole.`{text_column}`").alias("text"))))
    rows = durable(marked.groupBy("fingerprint_bits", *key).agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min(F.struct(*key, "n")).alias("best"))
    winners = components(rows, **sizes).join(best, "fp").groupBy("root").agg(F.min("best").alias("best"))
    winners = durable(winners.select("best.*"))
    gone = durable(rows.select(*key).join(winners.where("n = 1").select(*key), key, "left_anti"))
    kept = keyed.join(bounded(gone), key, "left_anti").select("whole")
    several = winners.where("n > 1").select(*key)
    if not several.isEmpty():
        kept = kept.unionByName(keyed.join(bounded(several), key, "left_semi").groupBy(*key).agg(F.first("whole").alias("whole")).select("whole"))
    return kept.select("whole.*")
