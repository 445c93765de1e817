"""Line dedup over sharded minimal perfect hashes (operator 4).

Method. One pass hashes the lines of every document (128 bits). Lines found in at least ``MIN_DOCS``
documents are grouped, map side first, to a count and a largest document id. Their hashes are dealt into
shards; each shard becomes a minimal perfect hash (levels of bit arrays with ranks) over the first 64 bits,
indexing compact arrays of fingerprints (the other 64 bits), counts and owners. A second pass over the
documents probes the arrays; no line is joined or shuffled with a document. A line that is not in the arrays
hits a slot of another line, and the fingerprint tells them apart (128 bits in all must agree).
Lines below ``MIN_DOCS`` can never be dropped, so the arrays leave them out and stay small.

Size. The arrays' bytes are summed before anything is sent. Up to ``SENT_BYTES`` they are broadcast and the
probing pass writes the result. Beyond, the arrays stay in the shuffle: hashes of lines (some tens of bytes,
no text) are dealt to their shard, in ``SALTS`` deals so that a hot line is spread, and sorted behind its
arrays; each task streams past one shard's arrays at a time and returns verdicts by row, that is by id and
text hash, which the documents then meet in one join. That takes one pass for the probes and one to cut the
texts, however many shards there are.

Cases: null or empty text is one empty line, which is never dropped (shorter than 20 code points); a line
repeated inside a document counts once, and all its copies go or stay together; repeated rows count as
documents, rows that share the largest id all keep the line; a null id is smaller than any other; empty
tables give empty results; invalid UTF-8 is treated as bytes. Other columns pass through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, bounded, durable, parallelism

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_LINES = 1 << 16
SENT_BYTES = 96 << 20
SALTS = 16
NO_ID = -(1 << 63)
STRIP = b" \t\n\x0b\x0c\r"
SHARDS = "shard long, n long, levels binary, fingerprints binary, counts binary, owners binary, others binary"


def line_key(line: bytes) -> bytes | None:
    """The line's key, or None where it is too short to be dropped."""
    key = line.strip(STRIP).lower()
    n = len(key)
    if n < MIN_CHARS or (n < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1: each level keeps the keys that are alone in their slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, total = levels, [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.concatenate(([0], np.cumsum(counts)[:-1])))
            total += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            slots = max(64, -(-2 * len(rest) // 64) * 64)
            place = _mixed(rest, len(levels)) % np.uint64(slots)
            alone = np.bincount(place.astype(np.int64), minlength=slots) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[place.astype(np.int64)]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_at = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_at):
                break
            place = _mixed(keys[open_at], level) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[open_at[here]] = ranks[word[here]] + np.bitwise_count(below)
            open_at = open_at[~here]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", int(size), at))
            at += 8 * int(size)
        return cls(levels)


class LineIndex:
    """Arrays of some shards: (hash, fingerprint) to count and owner."""

    def __init__(self, n_shards: int, rows: list[tuple]):
        self.n_shards = n_shards
        self.shards = {
            int(r[0]): (PerfectHash.from_bytes(r[2]), np.frombuffer(r[3], "<u8"), np.frombuffer(r[5], "<i8")) for r in rows
        }
        self.others = [tuple(x) for r in rows for x in np.frombuffer(r[6], "<i8").reshape(-1, 3)]

    def owners(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of (hash, fingerprint): whether the line is in these shards, and its owner."""
        known, owner = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        shard = (hashes[:, 0] >> np.uint64(1)).astype(np.int64) % self.n_shards
        for s in np.unique(shard):
            if int(s) not in self.shards:
                continue
            table, prints, ids = self.shards[int(s)]
            at = np.flatnonzero(shard == s)
            slot = table.lookup(hashes[at, 0])
            hit = (slot >= 0) & (prints[slot] == hashes[at, 1])
            known[at[hit]], owner[at[hit]] = True, ids[slot[hit]]
        for h, f, who in self.others:
            at = (hashes.view("<i8") == (h, f)).all(axis=1)
            known[at], owner[at] = True, who
        return known, owner


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
            keys = {k for line in text.split(b"\n") if (k := line_key(line)) is not None}
            digests += map(xxhash.xxh3_128_digest, keys)
            ids += [doc_id] * len(keys)
        pairs = _hashes(digests).view("<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(ids, pa.int64())],
            names=["h", "f", "doc_id"])


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["h"].to_numpy("<i8").view("<u8")
    distinct, at = np.unique(keys, return_index=True)
    rest = np.setdiff1d(np.arange(len(keys)), at)  # lines that share all 64 bits with another: a plain list
    others = np.column_stack([pdf[c].to_numpy("<i8")[rest] for c in ("h", "f", "owner")]).tobytes()
    table = PerfectHash.build(distinct)
    slot = table.lookup(distinct)
    prints, counts, owners = np.empty(len(at), "<u8"), np.empty(len(at), "<u4"), np.empty(len(at), "<i8")
    prints[slot] = pdf["f"].to_numpy("<i8").view("<u8")[at]
    counts[slot] = np.minimum(pdf["n_docs"].to_numpy()[at], 0xFFFFFFFF)
    owners[slot] = pdf["owner"].to_numpy()[at]
    return pd.DataFrame(
        [(int(pdf["shard"].iloc[0]), len(at), table.to_bytes(), prints.tobytes(), counts.tobytes(), owners.tobytes(), others)],
        columns=["shard", "n", "levels", "fingerprints", "counts", "owners", "others"])


def line_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[int, DataFrame]:
    """Number of shards, and one row of arrays per shard. ``docs`` has doc_id (no nulls) and text."""
    lines = docs.select("doc_id", "text").mapInArrow(_distinct_lines, "h long, f long, doc_id long")
    common = durable(
        lines.groupBy("h", "f")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner"))
        .where(F.col("n_docs") >= min_docs)
    )
    n_shards = max(1, -(-common.count() // SHARD_LINES))
    dealt = common.withColumn("shard", F.shiftrightunsigned("h", 1) % F.lit(n_shards))
    return n_shards, durable(dealt.groupBy("shard").applyInPandas(_build_shard, SHARDS))


def _sent(shards: DataFrame, n_shards: int):
    """A broadcast of all arrays, whose size has been checked."""
    return shards.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, n_shards, [tuple(r) for r in shards.collect()]))


_OPEN: dict[str, LineIndex] = {}


def _opened(sent) -> LineIndex:
    """The worker's index for a broadcast, built once."""
    token, n_shards, rows = sent.value
    if token not in _OPEN:
        _OPEN.clear()
        _OPEN[token] = LineIndex(n_shards, rows)
    return _OPEN[token]


def _verdicts(texts: list[bytes], ids: list[int], index: LineIndex):
    """Lines of each text, and for the keyed lines: (document, line, digest), known in the index, owned elsewhere."""
    lines, place, digests = [], [], []
    for d, text in enumerate(texts):
        lines.append(split := text.split(b"\n"))
        for k, line in enumerate(split):
            if (key := line_key(line)) is not None:
                place.append((d, k))
                digests.append(xxhash.xxh3_128_digest(key))
    if not digests:
        return lines, place, digests, np.zeros(0, bool)
    known, owner = index.owners(_hashes(digests))
    mine = np.array(ids, np.int64)[np.array(place, np.int64).reshape(-1, 2)[:, 0]]
    return lines, place, digests, known & (owner != mine)


def _probed(keyed: DataFrame, n_shards: int, shards: DataFrame) -> DataFrame:
    """doc_id, print, tie and line (digest) of every line that is owned elsewhere; ``keyed`` has these and text."""
    arrays = ["levels", "fingerprints", "counts", "owners", "others"]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, at = [], []
            for d, text in enumerate(_texts(batch.column(1))):
                keys = {k for line in text.split(b"\n") if (k := line_key(line)) is not None}
                digests += map(xxhash.xxh3_128_digest, keys)
                at += [d] * len(keys)
            rows = batch.take(pa.array(at, pa.int64()))
            shard = (_hashes(digests)[:, 0] >> np.uint64(1)).astype(np.int64) % n_shards
            salt = np.arange(len(at), dtype=np.int32) % SALTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(salt), rows.column(0), rows.column(2), rows.column(3), pa.array(digests, pa.binary())],
                names=["shard", "salt", "doc_id", "print", "tie", "line"])

    asked = keyed.mapInArrow(probes, "shard long, salt int, doc_id long, print long, tie long, line binary")
    spread = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "n", *arrays)
    both = spread.unionByName(asked, allowMissingColumns=True)
    # the arrays of a shard come before the lines that probe them
    sorted_ = both.repartition(parallelism(keyed), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("line").isNotNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for batch in batches:
            names = batch.schema.names
            column = {name: batch.column(k) for k, name in enumerate(names)}
            heads = np.flatnonzero(~column["line"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            for begin, end in zip([0, *(k + 1 for k in heads)], [*heads, len(batch)], strict=True):
                if begin and begin - 1 in heads:
                    of = column["shard"][begin - 1].as_py()
                    index = LineIndex(n_shards, [tuple(column[c][begin - 1].as_py() for c in ("shard", "n", *arrays))])
                part = batch.slice(begin, end - begin)
                if len(part) and of is not None:
                    # a shard that holds no common line has no arrays: its probes follow those of another
                    own = part.column(names.index("shard")).to_numpy() == of
                    known, owner = index.owners(_hashes(part.column(names.index("line")).to_pylist()))
                    hit = own & known & (owner != part.column(names.index("doc_id")).to_numpy())
                    found = part.take(pa.array(np.flatnonzero(hit)))
                    yield pa.RecordBatch.from_arrays([found.column(names.index(c)) for c in ("doc_id", "print", "tie", "line")], names=["doc_id", "print", "tie", "line"])

    return sorted_.mapInArrow(probe, "doc_id long, print long, tie long, line binary")


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_docs: int = MIN_DOCS,
    sent_bytes: int = SENT_BYTES,
    report: str | None = "line_dedup",
) -> DataFrame:
    """``docs`` with repeated lines gone from the text, and n_lines and n_dropped in a struct column ``report``."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    other = [c for c in names if c != text_column]
    packed = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col(f"`{text_column}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"),
    )
    n_shards, shards = line_index(packed, min_docs)
    size = sum((F.length(c) for c in ("levels", "fingerprints", "counts", "owners", "others")), F.lit(0)).cast("long")
    total = shards.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    row_type = packed.schema["row"].dataType.simpleString()
    schema = f"text string, row {row_type}, n_lines long, n_dropped long"

    def finished(batch, lines, gone) -> pa.RecordBatch:
        kept = [b"\n".join(x for k, x in enumerate(split) if k not in drop) if drop else b"\n".join(split) for split, drop in zip(lines, gone, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.binary()).view(pa.string()), batch.column(2), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in gone], pa.int64())],
            names=["text", "row", "n_lines", "n_dropped"])

    if total <= sent_bytes:
        sent = _sent(shards, n_shards)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _opened(sent)
            for batch in batches:
                lines, place, _, drop = _verdicts(_texts(batch.column(1)), batch.column(0).to_pylist(), index)
                gone: list[set[int]] = [set() for _ in lines]
                for i in np.flatnonzero(drop):
                    d, k = place[i]
                    gone[d].add(k)
                yield finished(batch, lines, gone)

        out = packed.mapInArrow(run, schema)
    else:
        keyed = packed.withColumn("print", F.xxhash64(F.col("text"))).withColumn("tie", F.xxhash64(F.lit(1), F.col("text")))
        hits = _probed(keyed.select("doc_id", "text", "print", "tie"), n_shards, shards)
        gathered = hits.groupBy("doc_id", "print", "tie").agg(F.collect_set("line").alias("gone"))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines, gone = [], []
                for text, drop in zip(_texts(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                    drop = set(drop or ())
                    lines.append(text.split(b"\n"))
                    gone.append({k for k, x in enumerate(lines[-1]) if drop and (key := line_key(x)) is not None and xxhash.xxh3_128_digest(key) in drop})
                yield finished(batch, lines, gone)

        joined = keyed.join(bounded(durable(gathered)), ["doc_id", "print", "tie"], "left")
        out = joined.select("doc_id", "text", "row", "gone").mapInArrow(apply, schema)
    back = [F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*back, *([F.struct("n_lines", "n_dropped").alias(report)] if report else []))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, n, line,
    translate(regexp_replace(regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d)),
k AS (SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE owner IS NULL OR owner = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.key = k.key GROUP BY rid
"""
