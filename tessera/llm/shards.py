"""Sharding by histogram sort (operator 2), DataFrame functions only.

Method. Rows are ordered by a 63-bit key whose upper 40 bits hash the text and whose lower bits hash the id,
so equal texts are neighbours and yet a group of any size can be cut. Rows that are equal in id and text share
that key; a second key, a hash of the row's place in the written table, tells them apart, and cells of one key
are divided by it. The shards' boundaries (splitters) are
found by rounds: exact bytes and rows are counted in the cells of a grid between the open boundaries, then
only the cells that hold a boundary are divided again, until each splitter's byte count lies within
``TOLERANCE`` of its target or the cell is down to one row. Then the rows are exchanged once, by
cells of the final grid; a row's slot is its rank in its cell plus the cell's offset, which the histogram
has given.

Law: ``bytes``. A shard is off by at most ``TOLERANCE`` of a mean shard at each end, or by one document.

Scale: texts are read once, the rounds run over (id, size, checksum, key). The window that ranks rows has one
group per cell. A cell with more than a 1024th of all rows (though not below ``CELL_ROWS``) is divided like one
that holds a boundary, so no group of copies ends in one task. There are fewer than 1024 such cells at a time,
so a round returns at most ``CELLS`` + (15 + 1024) * ``FANOUT`` counts, at any size of input.

Cases: a null text has no bytes, size 1 and the checksum of the empty text; an empty table has no shards;
rows that are equal in id and text are dealt out like others, in no set order among themselves; null ids sort
by the key of a null; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, stored, text_or_empty

SHARDS = 16
KEY_BITS = 63
GRID_BITS = 12
CELLS = 1 << GRID_BITS
FAN_BITS = 8
FANOUT = 1 << FAN_BITS
TOLERANCE = 0.0005
CELL_ROWS = 256
ROW_SHARE = 1024
LOW = (1 << 23) - 1


def sort_key(text: Column, row_id: Column) -> Column:
    spread = F.shiftrightunsigned(F.xxhash64(text), 1)
    return spread.bitwiseAND(F.lit(~LOW)).bitwiseOR(F.xxhash64(row_id, text).bitwiseAND(F.lit(LOW)))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sub``, a hash of each row's place, which tells equal rows apart; to be written before use."""
    return rows.withColumn("sub", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1))


def _floor(column: str, width: int) -> Column:
    return F.shiftleft(F.shiftright(column, width), width)


class Cell(NamedTuple):
    """Keys from ``key`` on, 2**``width`` of them; where that is one key, its rows with ``sub`` from ``sub`` on."""

    key: int = 0
    width: int = KEY_BITS
    sub: int = 0
    sub_width: int = KEY_BITS

    @property
    def divisible(self) -> bool:
        return self.width + self.sub_width > 0

    @property
    def start(self) -> tuple[int, int]:
        return self.key, self.sub

    @property
    def end(self) -> tuple[int, int]:
        return (self.key + (1 << self.width), 0) if self.width else (self.key, self.sub + (1 << self.sub_width))


def _histogram(rows: DataFrame, cells: list[Cell], bits: int) -> dict[Cell, tuple[int, int]]:
    """(bytes, rows) of the sub-cells that have rows, 2**``bits`` to a cell at most."""
    parts = []
    wide = [c for c in cells if c.width]
    if wide:
        which = part = F.lit(None).cast("long")
        for width in {c.width for c in wide}:
            fine = max(0, width - bits)
            within = _floor("key", width).isin([c.key for c in wide if c.width == width])
            which = F.when(within, _floor("key", fine)).otherwise(which)
            part = F.when(within, F.lit(fine)).otherwise(part)
        cell = [which.alias("cell"), part.cast("int").alias("width"), F.lit(0).cast("long").alias("at"), F.lit(KEY_BITS).alias("sub_width")]
        parts.append(rows.select(*cell, "size").where(F.col("cell").isNotNull()))
    for width in {c.sub_width for c in cells if not c.width}:
        fine = max(0, width - bits)
        own = [(c.key, c.sub) for c in cells if not c.width and c.sub_width == width]
        hot = rows.where(F.col("key").isin([k for k, _ in own])).withColumn("floor", _floor("sub", width))
        named = F.broadcast(rows.sparkSession.createDataFrame(own, "key long, floor long"))  # the open cells: bounded
        parts.append(hot.join(named, ["key", "floor"]).select(F.col("key").alias("cell"), F.lit(0).alias("width"), _floor("sub", fine).alias("at"), F.lit(fine).alias("sub_width"), "size"))
    counted = reduce(DataFrame.unionByName, parts).groupBy("cell", "width", "at", "sub_width").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {Cell(*r[:4]): (r["bytes"], r["n"]) for r in counted.collect()}  # at most a grid of cells


def find_grid(
    rows: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS
) -> tuple[list[tuple[Cell, int, int]], list[tuple[int, int]]]:
    """The final grid as (cell, bytes, rows) in order, and the splitters: where shards 1, 2, ... start.

    ``rows`` has key, sub and size. Every splitter is the start of a grid cell (or beyond the last).
    """
    grid = _histogram(rows, [Cell()], GRID_BITS)
    total = sum(size for size, _ in grid.values())
    cell_rows = max(cell_rows, sum(n for _, n in grid.values()) // ROW_SHARE)
    targets = [total * k / n_shards for k in range(1, n_shards)]
    slack = tolerance * total / n_shards
    while True:
        ordered = sorted(((c, *x) for c, x in grid.items()), key=lambda g: g[0].start)
        below, splitters, again = 0, [], {c for c, _, n in ordered if n > cell_rows and c.divisible}
        ends = []
        for _, size, _ in ordered:
            ends.append(below)
            below += size
        for target in targets if ordered else []:
            k = max(0, bisect_right(ends, target) - 1)
            cell, size, n = ordered[k]
            before, after = target - ends[k], ends[k] + size - target
            if min(before, after) > slack and n > 1 and cell.divisible:
                again.add(cell)
            splitters.append(cell.start if before <= after else cell.end)
        if not again:
            return ordered, splitters
        for cell in again:
            del grid[cell]
        grid |= _histogram(rows, sorted(again), FAN_BITS)


def assign(rows: DataFrame, n_shards: int = SHARDS, **limits) -> DataFrame:
    """``rows`` (key, sub, size and any others) with shard and slot: one exchange, by grid cell."""
    grid, splitters = find_grid(rows, n_shards, **limits)
    spark, places, filled = rows.sparkSession, [], [0] * n_shards
    for k, (cell, _, n) in enumerate(grid):
        shard = bisect_right(splitters, cell.start)
        places.append((*cell, k, shard, filled[shard]))
        filled[shard] += n
    # a cell's starts and widths name it; the widths that occur are few, and each row lies in one cell only
    cells = spark.createDataFrame(places, "cell long, width int, at long, sub_width int, number long, shard int, first_slot long")
    widths = sorted({(c.width, c.sub_width) for c, _, _ in grid}, reverse=True) or [(KEY_BITS, KEY_BITS)]
    place = F.array(*[F.struct(_floor("key", w).alias("cell"), F.lit(w).alias("width"), _floor("sub", v).alias("at"), F.lit(v).alias("sub_width")) for w, v in widths])
    marked = rows.withColumn("place", F.explode(place) if len(widths) > 1 else F.element_at(place, 1))
    same = [F.col(f"place.{c}") == cells[c] for c in ("cell", "width", "at", "sub_width")]
    placed = marked.join(F.broadcast(cells), same)  # the grid's cells are bounded whatever the input (see the module's text)
    rank = F.row_number().over(Window.partitionBy("number").orderBy("key", "doc_id", "sub"))
    return placed.withColumn("slot", F.col("first_slot") + rank - 1).select(*rows.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    row_id, text = F.col(id_column).cast("long"), text_or_empty(text_column)
    slim = docs.select(
        row_id.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        sort_key(text, row_id).alias("key"),
    )
    return assign(durable(numbered(slim)), n_shards, **limits).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", **limits) -> None:
    """Write whole documents as Parquet, one folder ``shard=k`` each, with their slots.

    The documents are written once with their keys, so that the rounds read the keys alone.
    """
    names = docs.columns
    row_id, text = F.col(f"`{id_column}`").cast("long"), text_or_empty(f"`{text_column}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), row_id.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), sort_key(text, row_id).alias("key"))
    placed = assign(stored(numbered(rows)), n_shards, **limits)
    placed.select("row", "slot", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
