"""Mixing sources to target weights (operator 10).

Method. A source's documents, in a fixed order, form one stream of words, packed into blocks of one length;
blocks run over document borders and only a source's last block is shorter. Targets come from the weights. A
target is met by whole passes over the source and one partial pass of some blocks. The slots of all passes are
dealt to the output shards by multinomial draws (each shard draws from what is left, so that the sums are
exact); slot t of a source is block ``perm(t)`` of its pass, a pseudorandom permutation of the source's block
numbers by a keyed Feistel network with cycle walking, so nothing is shuffled to be permuted; slots and blocks
are then joined by (source, block). A block has a ``BLOCKS``-th of the source's target or size, whichever is
less, at least one word and at most ``BLOCK_WORDS``, so that a small source or a small target is met as well.

Scale. Equal rows are counted, not numbered: they are one entry of the stream with a number of copies. Places
in a stream are prefix sums: by (source, bucket) over buckets of ids, then inside the bucket, so a source with a
third of all rows is spread over as many groups. Sources are numbered by range partitions, targets found by
rounds of two sums over them, and the multinomial draws made for ``DRAWN`` sources at a time, each such group's
share of a shard being drawn first; so the driver reads two numbers a round and a row per ``DRAWN`` sources,
and sources may be as many as documents. Slots are generated in chunks where they are used. Whole texts are
exchanged once, to meet the spans that the mix takes of them.

Cases: a null or empty text has size 0 and nothing taken; null sources form one source, the last; repeated
rows and equal ids are rows of their own, each with its place in the stream; an empty table gives an empty
result; reruns agree, as places and draws depend on the rows' values and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_PATTERN, bounded, durable, parallelism, row_hash, text_or_empty

BLOCK_WORDS = 1_024
BLOCKS = 4_096
OUTPUT_SHARDS = 16
MAX_PASSES = 3
BUCKETS = 1_024
BUCKET_ROWS = 50_000
CHUNK = 4_096
DRAWN = 1 << 16
COPIES = 1_024
SEED = 20_26
KEY = ["print", "tie"]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Place of ``index`` in the permutation of 0..size-1 that ``key`` names; arrays of one length."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_at = index.astype(np.uint64), np.arange(len(index))
    while len(open_at):
        m, h, k = mask[open_at], half[open_at], key[open_at].astype(np.uint64)
        left, right = out[open_at] >> h, out[open_at] & m
        for r in range(rounds):
            f = _mix64(right + _mix64(k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
            left, right = right, left ^ (f & m)
        out[open_at] = (left << h) | right
        open_at = open_at[out[open_at] >= size[open_at].astype(np.uint64)]
    return out.astype(np.int64)


def draw_slots(quotas: list[int] | np.ndarray, shares: list[int] | np.ndarray, seed: int | list[int] = SEED) -> np.ndarray:
    """Slots of each (shard, source): a shard draws its share from the slots still left, the last one takes them all."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, np.int64)
    out = np.zeros((len(shares), len(left)), np.int64)
    for s, share in enumerate(shares):
        rest = int(left.sum())
        if s == len(shares) - 1:
            out[s] = left
        elif rest and share:
            out[s] = np.minimum(rng.multinomial(min(int(share), rest), left / rest), left)  # a source that has run out gives what it has
        left = left - out[s]
    return out


def even_shares(total: int, shards: int) -> list[int]:
    return [total * (s + 1) // shards - total * s // shards for s in range(shards)]


def source_key(source: Column) -> Column:
    """A value that null has too, and no string, so that null takes part in joins and groups."""
    name = source.cast("string")
    return F.struct(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"))


def row_key(docs: DataFrame, text_column: str) -> list[Column]:
    """``print`` and ``tie``, 128 bits that name a row by its values."""
    return [F.xxhash64(text_or_empty(f"`{text_column}`")).alias("print"), row_hash(docs).alias("tie")]


def placed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source_key, print, tie, size, n and start of every distinct row.

    ``n`` rows are equal; they lie side by side in the source's stream, ``start`` words before the first of them.
    """
    slim = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        source_key(F.col(f"`{source_column}`")).alias("source_key"),
        *row_key(docs, text_column),
        F.regexp_count(text_or_empty(f"`{text_column}`"), F.lit(WORD_PATTERN)).cast("long").alias("size"),
    )
    rows = durable(slim.groupBy("doc_id", "source_key", *KEY).agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    n_buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(n_buckets)))
    words = F.col("size") * F.col("n")
    buckets = rows.groupBy("source_key", "bucket").agg(F.sum(words).alias("words"))
    over = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source_key", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("doc_id", *KEY).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return own.join(buckets.hint("merge"), ["source_key", "bucket"]).select(
        "doc_id", "source_key", *KEY, "size", "n", (F.col("before") + F.col("own")).alias("start")
    )


def numbered_sources(rows: DataFrame) -> DataFrame:
    """source_key, source_size and source, the number by code points, null last."""
    totals = rows.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranged = durable(totals.repartitionByRange(parallelism(rows), "source_key").withColumn("part", F.spark_partition_id()))
    first: list[tuple[int, int]] = []
    before = 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # a row per partition
        first.append((part, before))
        before += n
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source_key"))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(first, "part int, before long"))
    return durable(ranged.withColumn("rank", rank).join(offsets, "part").select("source_key", "source_size", (F.col("before") + F.col("rank") - 1).alias("source")))


def source_plan(rows: DataFrame, weights: list[float], block_words: int = BLOCK_WORDS, blocks: int = BLOCKS, cap: int = MAX_PASSES) -> DataFrame:
    """Per source: source_key, source, source_size, target, block_words, blocks, whole passes, blocks of the partial pass.

    All sizes are shared by weight. What exceeds ``cap`` times a source's size is shared again, round by round:
    ``level`` is the share of weight 1 among sources below their cap, and only grows.
    """
    sources = numbered_sources(rows)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source") % len(weights) + 1).cast("int"))
    most = F.col("source_size") * cap
    level, n_full = 0.0, -1
    while True:
        full = weight * level > most
        left, share, now = sources.agg(
            F.coalesce(F.sum("source_size") - F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0)), F.count_if(full)
        ).first()
        if now == n_full or share == 0:
            break
        level, n_full = left / share, now
    size, target = F.col("source_size"), F.col("target")
    plan = sources.withColumn("target", F.when(weight * level > most, most.cast("double")).otherwise(weight * level))
    plan = plan.withColumn("block_words", F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.least(size, target) / blocks))).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(size / F.col("block_words")).cast("long"))
    plan = plan.withColumn("whole", F.when(size > 0, F.least(F.lit(cap), F.floor(target / size))).otherwise(0).cast("long"))
    part = F.least(F.col("blocks"), F.round((target - F.col("whole") * size) / (size / F.col("blocks"))))
    return durable(plan.withColumn("part", F.when((size > 0) & (F.col("whole") < cap), part).otherwise(0).cast("long")))


def taken_blocks(plan: DataFrame, shards: int = OUTPUT_SHARDS, seed: int = SEED, drawn: int = DRAWN) -> DataFrame:
    """The mix: shard, source (number), slot, pass, block - one row per block that an output shard holds."""
    quotas = plan.select("source", "blocks", (F.col("blocks") * F.col("whole") + F.col("part")).alias("quota"), F.floor(F.col("source") / drawn).alias("grp")).where("quota > 0")
    groups = sorted(map(tuple, quotas.groupBy("grp").agg(F.sum("quota")).collect()))  # a row per ``drawn`` sources
    shares = draw_slots([n for _, n in groups], even_shares(sum(n for _, n in groups), shards), seed)
    share_of = {g: [int(x) for x in shares[:, i]] for i, (g, _) in enumerate(groups)}

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        group = int(pdf["grp"].iloc[0])
        counts = draw_slots(pdf["quota"].to_numpy(), share_of[group], [seed, group])
        first = np.cumsum(counts, axis=0) - counts
        shard, at = np.nonzero(counts)
        return pd.DataFrame({"shard": shard.astype("int32"), "source": pdf["source"].to_numpy()[at], "first": first[shard, at], "n": counts[shard, at], "blocks": pdf["blocks"].to_numpy()[at]})

    spread = quotas.groupBy("grp").applyInPandas(draw, "shard int, source long, first long, n long, blocks long")
    chunks = spread.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    # by a number of its own: the chunks are few bytes, and AQE would bring them into one task
    chunks = chunks.repartition(parallelism(plan), F.col("source"), F.col("shard"), F.col("at"))
    slots = chunks.select(
        "shard", "source", "blocks",
        F.explode(F.sequence(F.col("first") + F.col("at") * CHUNK, F.col("first") + F.least((F.col("at") + 1) * CHUNK, F.col("n")) - 1)).alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, blocks, slot = (batch.column(k).to_numpy() for k in (1, 2, 3))
            turn = slot // np.maximum(blocks, 1)
            key = _mix64((source.astype(np.uint64) << np.uint64(2)) + turn.astype(np.uint64) + np.uint64(seed << 40))
            block = permute(slot % np.maximum(blocks, 1), blocks, key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(turn, pa.int64()), pa.array(block, pa.int64())], names=["shard", "source", "slot", "pass", "block"])

    return slots.mapInArrow(run, "shard int, source long, slot long, pass long, block long")


def _each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` equal ones, with its number ``copy``; many copies are dealt out in chunks."""
    n, some = F.col("n"), rows.where(f"n <= {COPIES}").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = rows.where(f"n > {COPIES}").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES))))
    many = many.repartition(parallelism(rows), *KEY, "at").withColumn("copy", F.explode(F.sequence(F.col("at") * COPIES, F.least((F.col("at") + 1) * COPIES, n) - 1)))
    return some.unionByName(many.drop("at"))


def _numbered(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row with its source's number, size, target and block length, and its own start."""
    sources = plan.select("source_key", "source", "source_size", "target", "block_words")
    return _each_copy(rows.join(bounded(sources, 10_000), "source_key")).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def _held(numbered: DataFrame) -> DataFrame:
    """One row per document and block that it lies in, with its words inside; documents of size 0 lie in none."""
    length, end = F.col("block_words"), F.col("start") + F.col("size")
    found = numbered.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))))
    return found.withColumn("lo", F.greatest(F.col("block") * length, F.col("start")) - F.col("start")).withColumn("hi", F.least((F.col("block") + 1) * length, end) - F.col("start"))


def mix_counts(
    docs: DataFrame, weights: list[float] = (1, 2, 3), block_words: int = BLOCK_WORDS, blocks: int = BLOCKS, shards: int = OUTPUT_SHARDS, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = durable(placed(docs, id_column, text_column, source_column))
    plan = source_plan(rows, list(weights), block_words, blocks)
    numbered = _numbered(rows, plan)
    times = taken_blocks(plan, shards, seed).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    used = _held(numbered).join(times.hint("merge"), ["source", "block"], "left")
    # (source, start) names a document with words
    big = used.groupBy("source", "start").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum(F.coalesce("times", F.lit(0)) * (F.col("hi") - F.col("lo"))).alias("taken")
    )
    names = ["doc_id", "size", "source_size", "target", "taken"]
    empty = numbered.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*names)
    return big.select(*names).unionByName(empty)


def mix_documents(
    docs: DataFrame, weights: list[float] = (1, 2, 3), block_words: int = BLOCK_WORDS, blocks: int = BLOCKS, shards: int = OUTPUT_SHARDS, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The mix as rows of ``docs``: one row per document and pass that takes words of it, with those words.

    A whole pass returns the text unchanged; a partial pass joins the runs of words that its blocks cover. Rows
    equal in all columns are interchangeable: one of them, found by a grouping with map-side partial results,
    stands for all, and is dealt out for each ``COPIES`` of them.
    """
    rows = durable(placed(docs, id_column, text_column, source_column))
    plan = source_plan(rows, list(weights), block_words, blocks)
    slots = taken_blocks(plan, shards, seed).select("source", "block", F.col("pass").alias("turn"))
    used = _held(_numbered(rows, plan)).join(slots.hint("merge"), ["source", "block"])
    used = used.select(*KEY, "copy", "size", "turn", F.struct("lo", "hi").alias("span"))
    turns = used.groupBy(*KEY, "copy", "turn").agg(F.sum(F.col("span.hi") - F.col("span.lo")).alias("words"), F.first("size").alias("size"), F.array_sort(F.collect_list("span")).alias("spans"))
    turns = turns.select(*KEY, F.floor(F.col("copy") / COPIES).alias("salt"), F.when(F.col("words") < F.col("size"), F.col("spans")).alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs, text_column))
    several = rows.where("n > 1").select(*KEY, "n")
    single = whole.withColumn("salt", F.lit(0).cast("long"))
    if not several.isEmpty():
        named = bounded(several.select(*KEY))
        shared = whole.join(named, KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row")).join(bounded(several), KEY)
        shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
        single = single.join(named, KEY, "left_anti").unionByName(shared.select(*single.columns))
    joined = single.join(turns, [*KEY, "salt"])
    words = F.regexp_extract_all(F.col(f"row.`{text_column}`"), F.lit(WORD_PATTERN), F.lit(0))
    part = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.transform(F.col("spans"), lambda s: F.array_join(F.slice(w, s["lo"].cast("int") + 1, (s["hi"] - s["lo"]).cast("int")), " ")), " ")), 1)
    text = F.when(F.col("spans").isNull(), F.col(f"row.`{text_column}`")).otherwise(part)
    return joined.select(*[text.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
