"""Conversation prefix trie (operator 12).

Method: every conversation is rebuilt from its base's first turns and its own later ones, and gets a digest for
each of its prefixes. A node of the trie is a distinct digest; its owner is the smallest conversation that has it,
the digest's minimum. A conversation that owns a node owns all its deeper ones, so its first owned depth is found
by binary search: in each round every conversation probes one depth, by a join to the prefix digests and one to
the minima. The owned ends of the conversations are chains; a chain hangs below the last node that its
conversation does not own. Chains' savings and leaves are summed bottom-up along that forest by doubling: after
round i a chain holds the sums of all chains less than 2 ** i levels below, and hands them to the chain 2 ** i
levels above. Within a chain, a node's sums are running sums from the chain's end.

Scale: texts are read once and reduced to a digest and a word count where they lie. A depth d is only ever probed
in the round of its lowest set bit, so that all rounds together exchange every prefix row once at most. A prefix
digest is a sum of hashes of (depth, turn), 128 bits in four counters, so it can be summed in pieces: turns are
ranged by (conversation, turn), a conversation of a third of all rows is cut over many ranges, and each range
needs the totals of the ranges before, one row a range. Running sums of long chains are cut in the same way, by
``CHUNK`` depths. Joins have one side with unique keys, so Spark may split the other side of a hot key. The ids
of the conversations that end at a node are hashed as one stream, in order, as SHA-256 must: a node's ids pass one
task, 8 bytes each and never held together. Rounds are logarithmic in the longest conversation and in the forest's
height, and each is written to the shared folder.

Cases: null roles and texts are empty, null turns come first; turns of equal number are ordered by the SHA-256 of
their role and text, repeated rows are turns of their own; rows without a conversation's id belong to none and are
left out; a conversation that is rebuilt without turns is a member of the root alone; an empty table has no nodes.
Only the columns named are read, so clashing names in other columns are of no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_PATTERN, bounded, durable, parallelism, stored

FAMILY = 20  # conversations that share a base
HEADS = 4  # a conversation takes fewer than so many turns of its base
CHUNK = 4096
SUMS = ("s0", "s1", "s2", "s3")
NODES = "conv_id long, depth long, ends_sha256 string"
NO_ENDS = hashlib.sha256().hexdigest()


def _hashes(depth: Column, digest: Column) -> list[Column]:
    """Four counters of 32 bits of a turn at its depth; 2 ** 31 of them add up without an overflow."""
    both = [F.xxhash64(F.lit(i), depth, digest) for i in (12, 21)]
    low = F.lit(0xFFFFFFFF).cast("long")
    return [x for h in both for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[x.cast("string") for x in (depth, *sums)])))


def _before(rows: DataFrame, sums: list[str]) -> DataFrame:
    """range, conv_id and the sums of a conversation's ranges before; only conversations that were cut have rows."""
    totals = rows.groupBy("range", "conv_id").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.select("range", "conv_id", *[F.sum(s).over(earlier).alias(f"{s}_before") for s in sums])
    return bounded(durable(summed.where(F.col(f"{sums[0]}_before").isNotNull())))  # a row a range at most


def _running(rows: DataFrame, sums: list[str], order: list[str]) -> DataFrame:
    """``rows`` (range, conv_id, ...) with running sums along each conversation, in pieces by range."""
    here = Window.partitionBy("range", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({s: F.sum(s).over(here) for s in sums})
    whole = local.join(_before(rows, sums), ["range", "conv_id"], "left")
    return whole.withColumns({s: F.col(s) + F.coalesce(f"{s}_before", F.lit(0)) for s in sums}).drop(*[f"{s}_before" for s in sums])


def numbered_turns(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """range, conv_id, place (from 1), digest and words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    slim = conversations.select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.col(turn_column).cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"),
    ).where("conv_id is not null")
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()))  # parts rows that are equal
    order = ["conv_id", "turn", "digest", "row"]
    ranged = stored(slim.repartitionByRange(parallelism(slim), *order).withColumns({"range": F.spark_partition_id(), "place": F.lit(1).cast("long")}))
    return stored(_running(ranged, ["place"], ["turn", "digest", "row"]).select("range", "conv_id", "place", "digest", "words"))


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their prefixes (conv_id, depth, low, key, words, end) as rebuilt."""
    heads = turns.where(F.col("place") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"taken": taken, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("taken").cast("int")), F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>"))
    whole = own.join(heads, "base", "left").withColumn("head", head).withColumn("from", F.size("head").cast("long"))
    whole = whole.withColumn("length", F.col("from") + F.greatest(F.col("n") - F.col("taken"), F.lit(0)))
    first = F.transform("head", lambda x: F.struct(*[v.alias(s) for v, s in zip(_hashes(x["place"], x["digest"]), SUMS, strict=True)]))
    whole = durable(whole.withColumn("first", first).drop("base"))

    shared = whole.select("conv_id", "length", "first", F.posexplode("head").alias("at", "turn")).withColumn("depth", (F.col("at") + 1).cast("long"))
    shared = shared.select("conv_id", "length", "depth", F.col("turn.words").alias("words"), *_summed("depth"))
    # written, so that the window below deals by (range, conv_id) and not by the join's key alone
    later = turns.join(whole.select("conv_id", "length", "taken", "from", *_summed("from")), "conv_id").where("place > taken")
    later = later.withColumn("depth", F.col("place") - F.col("taken") + F.col("from"))
    turn = dict(zip((f"{s}_turn" for s in SUMS), _hashes(F.col("depth"), F.col("digest")), strict=True))
    later = stored(later.withColumns(turn).drop("digest", "place", "taken", "from"))
    later = _running(later, list(turn), ["depth"]).withColumns({s: F.col(s) + F.col(f"{s}_turn") for s in SUMS}).select(shared.columns)
    rows = shared.unionByName(later).select(
        "conv_id",
        "depth",
        F.col("depth").bitwiseAND(-F.col("depth")).alias("low"),
        _key(F.col("depth"), [F.col(s) for s in SUMS]).alias("key"),
        "words",
        (F.col("depth") == F.col("length")).alias("end"),
    )
    return whole.select("conv_id", "length"), stored(rows)


def _summed(n: str) -> list[Column]:
    """The counters of the first ``n`` turns of a head."""

    def of(s: str) -> Column:
        return F.aggregate(F.slice("first", F.lit(1), F.col(n).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x[s])

    return [of(s).alias(s) for s in SUMS]


def first_owned(convs: DataFrame, rows: DataFrame, minima: DataFrame, root: int, longest: int) -> DataFrame:
    """conv_id, length, foreign (deepest depth that another conversation owns, 0: the root) and its owner.

    Binary search: ``foreign`` is built from its highest bit down; a conversation moves on by 2 ** i if the node
    there is another's.
    """
    state = convs.withColumns({"foreign": F.lit(0).cast("long"), "owner": F.lit(root).cast("long")})
    for i in range(longest.bit_length() - 1, -1, -1):
        step = 1 << i
        asked = state.where(F.col("foreign") + step <= F.col("length")).select("conv_id", (F.col("foreign") + step).alias("depth"))
        keys = asked.join(rows.where(F.col("low") == step).select("conv_id", "depth", "key"), ["conv_id", "depth"])
        met = keys.join(minima.where(F.col("low") == step).select("key", F.col("conv_id").alias("holder")), "key")
        met = met.where("holder <> conv_id").select("conv_id", F.col("depth").alias("deeper"), "holder")
        state = state.join(met, "conv_id", "left").select(
            "conv_id", "length", F.coalesce("deeper", "foreign").alias("foreign"), F.coalesce("holder", "owner").alias("owner")
        )
        state = durable(state)
    return state


def chain_totals(chains: DataFrame) -> DataFrame:
    """``chains`` (conv_id, above, saved, leaves) to conv_id and the sums over each chain and all below it."""
    held = durable(chains)
    while held.where("above is not null").limit(1).count():
        given = held.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("ends"))
        higher = held.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        held = held.join(given, "conv_id", "left").join(higher, "above", "left")
        held = durable(
            held.select(
                "conv_id",
                F.col("next").alias("above"),
                (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("ends", F.lit(0))).alias("leaves"),
            )
        )
    return held.drop("above")


def _end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth (a node) and the hash of the ids (``member``) that end there, streamed in ascending order."""
    by = ends.repartition(parallelism(ends), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for *at, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(str(member).encode())
                else:
                    digest.update(b",%d" % member)
            yield _nodes(done)
        yield _nodes([(*node, digest.hexdigest())] if node else [])

    return by.select("conv_id", "depth", "member").mapInArrow(hashed, NODES)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs, rows = prefixes(numbered_turns(conversations, id_column, turn_column, role_column, text_column))
    root, total, longest = convs.agg(F.min("conv_id"), F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(0))).first()
    root_id = F.lit(root).cast("long")
    minima = rows.groupBy("key").agg(
        F.min(F.struct("conv_id", "end")).alias("least"), F.min("depth").alias("depth"), F.min("low").alias("low"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs")
    )
    minima = stored(minima.select("key", "depth", "low", "words", "n_convs", "least.*"))
    held = first_owned(convs, rows, minima, root or 0, longest)
    alone = F.col("conv_id") == root_id  # owns the root, hangs below nothing
    chains = held.where(~alone & (F.col("foreign") < F.col("length")))

    top = spark.range(1).select(root_id.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
    top = top.join(convs.where(alone).select("conv_id", (F.col("length") == 0).alias("end")), "conv_id")
    nodes = minima.select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "end").unionByName(top)
    node = ["conv_id", "depth"]
    below = chains.select(F.col("owner").alias("conv_id"), F.col("foreign").alias("depth"), F.col("conv_id").alias("chain"))
    firsts = chains.select("conv_id", (F.col("foreign") + 1).alias("depth"), "owner")
    nodes = nodes.join(below.groupBy(*node).agg(F.count(F.lit(1)).alias("hanging")), node, "left").join(firsts, node, "left")
    nodes = nodes.select(
        *node,
        F.when(F.col("depth") > 0, F.coalesce("owner", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("hanging", F.lit(0)) + (~F.col("end")).cast("long")).alias("n_children"),
        "saved",
    )
    nodes = stored(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")))

    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    above = chains.select("conv_id", F.col("owner").alias("above"))
    totals = chain_totals(own.join(above, "conv_id", "left").select("conv_id", "above", "saved", "leaves"))
    totals = totals.select(F.col("conv_id").alias("chain"), F.col("saved").alias("more"), F.col("leaves").alias("ends"))
    hung = below.join(totals, "chain").groupBy(*node).agg(F.sum("more").alias("more"), F.sum("ends").alias("ends"))

    gained = nodes.join(hung, node, "left").withColumns({"saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("ends", F.lit(0))})
    gained = stored(gained.drop("more", "ends").withColumns({"range": -F.floor(F.col("depth") / CHUNK), "up": -F.col("depth")}))
    summed = _running(gained, ["saved", "leaves"], ["up"])

    own_end = F.col("foreign") < F.col("length")
    ends = held.select(
        F.when(own_end, F.col("conv_id")).otherwise(F.col("owner")).alias("conv_id"), F.when(own_end, F.col("length")).otherwise(F.col("foreign")).alias("depth"), F.col("conv_id").alias("member")
    )
    return summed.join(_end_digests(ends), node, "left").select(
        *node, "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END))"""
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(concat(length(role)::VARCHAR, ':', role, text))) AS own
  FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, {_CRC} % 4 AS h FROM l),
c AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq
  FROM h LEFT JOIN l AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (
  SELECT conv_id, d::BIGINT AS d, len(seq)::BIGINT AS len, md5(to_json(seq[1:d])::VARCHAR) AS key,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(seq[d].t, '[^ \\t\\n\\x0B\\f\\r]+')) END::BIGINT AS words
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM c)),
n AS (
  SELECT key, d, min(conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved, max(len) = d AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends FROM p GROUP BY key, d),
u AS (SELECT n.owner, n.d, up.key AS parent FROM n JOIN p AS up ON up.conv_id = n.owner AND up.d = n.d - 1),
k AS (SELECT parent AS key, count(*) AS n_children FROM u GROUP BY parent),
s AS (
  SELECT p.key, sum(n.saved) AS saved_tokens, sum(n.leaf::BIGINT) AS n_leaves
  FROM n JOIN p ON p.conv_id = n.owner AND p.d <= n.d GROUP BY p.key)
SELECT n.owner AS conv_id, n.d AS depth, q.owner AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN u ON u.owner = n.owner AND u.d = n.d LEFT JOIN n AS q ON q.key = u.parent LEFT JOIN k ON k.key = n.key JOIN s ON s.key = n.key
"""
