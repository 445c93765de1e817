"""Change streams: debounce, last event wins, and their application to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import languages

EVENT_TYPES = ("created", "modified", "deleted")


def relevant(events: DataFrame) -> DataFrame:
    """Watched suffixes only; deletions pass whatever the name."""
    return events.where((F.col("event_type") == "deleted") | languages.is_watched(F.col("file_path")))


def debounced(events: DataFrame, key: str, time: str = "ts", gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """I4: one row per burst of a key: when it began, when its trailing edge falls, its size and last event.

    ``events`` has event_type and, for a total order in a burst, event_id. The same plan serves batches and
    streams; a stream names its watermark.
    """
    rows = events if watermark is None else events.withWatermark(time, watermark)
    window = F.session_window(time, gap)
    return rows.groupBy(key, window.alias("burst")).agg(
        F.count(F.lit(1)).alias("events"), F.max_by("event_type", F.struct(time, "event_id")).alias("last_event")
    ).select(key, F.col("burst.start").alias("first_ts"), F.col("burst.end").alias("edge_ts"), "events", "last_event")


def last_per_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest event of each key, all columns: an aggregate, so bursts combine before they are shuffled."""
    others = [c for c in events.columns if c != key]
    newest = events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("e"))
    return newest.select(key, *[F.col(f"e.{c}").alias(c) for c in others])


def apply_changes(target: DataFrame, events: DataFrame, key: str, order: list[str], is_delete: Column, columns: list[str]) -> DataFrame:
    """The table after a batch: keys of the batch retracted, those not deleted inserted anew."""
    last = last_per_key(events, key, order)
    kept = last.where(~is_delete).select(key, *columns)
    return target.select(key, *columns).join(last.select(key), key, "left_anti").unionByName(kept)


def apply_to_store(
    store, make_chunks: Callable[[DataFrame], DataFrame], now: Callable[[], float], on_change: Callable[[DataFrame, DataFrame], None] | None = None,
    repo: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: changed files are cut anew, deleted ones leave the chunk table.

    ``make_chunks`` turns changed files (repo, file_path, content, file_hash) into chunk rows. Chunk ids follow
    from path and place, so a batch that is replayed after a failure ends in the same table. ``on_change`` gets
    the new chunks (repo, id, content) and the keys of all that came or went, for indexes that follow the table.
    ``repo`` is the project of all batches, if there is one: then only its folders are read.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        last = last_per_key(relevant(batch), "file_path", ["ts"]).cache()
        try:
            if last.isEmpty():
                return
            base = store.version("chunks")
            touched = last.select("repo", "file_path")
            changed = last.where("event_type <> 'deleted' AND content IS NOT NULL")
            changed = changed.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256))
            fresh = make_chunks(changed).withColumn("indexed_at", F.lit(now()))
            for name in ("vector", "token_count"):
                if name not in fresh.columns:
                    fresh = fresh.withColumn(name, F.lit(None))
            fresh = fresh.withColumn("vector", F.col("vector").cast("array<float>"))
            fresh = fresh.cache()
            old = store.read("chunks", version=base, repo=repo).join(touched, ["repo", "file_path"], "left_semi").select("repo", "id")
            store.replace("chunks", fresh, touched, expected=base)
            if on_change is not None:
                on_change(fresh.select("repo", "id", "content"), old.unionByName(fresh.select("repo", "id")))
            fresh.unpersist()
        finally:
            last.unpersist()

    return run


HEADS = (12, 32, 96, 256, 1024)
HEAD_ROWS = 50_000


def _by_head(files: DataFrame, most: int) -> DataFrame:
    """``files`` with ``head``, a beginning of the path that few others share.

    A head is the shortest of ``HEADS`` that at most ``most`` files of the project begin with, or the longest. So
    heads follow the order of paths, and no deep common folder puts a corpus into one group.
    """
    found = files.withColumn("head", F.lit(None).cast("string"))
    for k, length in enumerate(HEADS):
        cut = F.substring("file_path", 1, length)
        if k + 1 == len(HEADS):
            return found.withColumn("head", F.coalesce("head", cut))
        small = found.where("head IS NULL").groupBy("repo", cut.alias("cut")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
        met = found.withColumn("cut", cut).join(small.drop("n").withColumn("small", F.lit(True)), ["repo", "cut"], "left")
        found = met.withColumn("head", F.coalesce("head", F.when(F.col("small"), F.col("cut")))).drop("cut", "small")
        if found.where("head IS NULL").isEmpty():
            return found
    return found


def windows(files: DataFrame, per_window: int, head_rows: int = HEAD_ROWS) -> DataFrame:
    """``files`` with the number of the bounded window that takes them, in order of path.

    Each window holds at least one file; what a run has not reached is what the later windows hold. Numbers
    come from a prefix sum of counts by the path's beginning, so that no task ranks the whole corpus.
    """
    keyed = _by_head(files, head_rows)
    counts = keyed.groupBy("repo", "head").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("repo").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("repo", "head").orderBy("file_path")) - 1
    placed = keyed.withColumn("own", own).join(counts.drop("n"), ["repo", "head"])
    return placed.withColumn("window", F.floor((F.col("before") + F.col("own")) / max(1, per_window))).drop("head", "own", "before")
