import os
import time

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import chunking
from tessera.sources.snapshots import SnapshotReader, SnapshotSource
from tessera.sources.store import Store
from tessera.streaming import changes


def test_snapshots_see_new_changed_and_deleted_files(tmp_path):
    root, state = tmp_path / "root", tmp_path / "state"
    (root / "d").mkdir(parents=True)
    (root / "a.py").write_text("1")
    (root / "d/b.py").write_text("2")
    reader = SnapshotReader(str(root), str(state))

    def events(start, end):
        return sorted((p, k) for part in reader.partitions(start, end) for p, k, _, _ in reader.read(part))

    first = reader.latestOffset()
    assert events(reader.initialOffset(), first) == [("a.py", "created"), ("d/b.py", "created")]
    assert reader.latestOffset() == first
    (root / "a.py").write_text("changed")
    os.remove(root / "d/b.py")
    second = reader.latestOffset()
    assert events(first, second) == [("a.py", "modified"), ("d/b.py", "deleted")]
    reader.commit(second)
    assert SnapshotReader(str(root), str(state)).latestOffset() == second


def test_a_file_counts_once_it_is_quiet(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.py").write_text("1")
    os.utime(root / "a.py", (1, 1))
    reader = SnapshotReader(str(root), str(tmp_path / "s"), 0.4)
    first = reader.latestOffset()
    now = 100.0
    held, busy = {"a.py": [1.0, 1], "b.py": [2.0, 1]}, {"a.py": [99.9, 5], "c.py": [99.8, 1]}
    assert reader._quiet(held, busy, now)[0] == held  # written and gone too lately: all as before
    quiet, wait = reader._quiet(held, busy, now + 1)
    assert quiet == busy and wait == 0
    (root / "a.py").write_text("22")
    began = time.time()
    second = reader.latestOffset()  # waits for the trailing edge
    assert second != first and time.time() - began > 0.2
    assert [(p, k) for part in reader.partitions(first, second) for p, k, _, _ in reader.read(part)] == [("a.py", "modified")]


def test_stream_keeps_the_chunk_table(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n" * 10)
    store = Store(spark, str(tmp_path / "store"))
    spark.dataSource.register(SnapshotSource)

    def apply(batch, epoch):
        rows = [("r", n, bytearray((root / n).read_bytes())) for n in os.listdir(root)]
        now = spark.createDataFrame(rows, "repo string, file_path string, content binary")
        texts = batch.withColumn("repo", F.lit("r")).withColumn("ts", F.timestamp_seconds("mtime")).join(now.select("file_path", F.col("content").cast("string").alias("content")), "file_path", "left")
        changes.apply_to_store(store, lambda f: chunking.chunk_files(f, 10, by_syntax=False), lambda: 1.0)(texts, epoch)

    def step():
        source = spark.readStream.format("file_changes").option("path", str(root)).option("state", str(tmp_path / "s")).load()
        query = source.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return {(r["file_path"], r["content"][:5]) for r in store.read("chunks").collect()}

    assert step() == {("a.py", "x = 1")}
    (root / "a.py").write_text("y = 22222\n")
    (root / "b.md").write_text("note")
    assert step() == {("a.py", "y = 2"), ("b.md", "note")}
    os.remove(root / "b.md")
    assert step() == {("a.py", "y = 2")}


def test_debounce_keeps_the_last_event_of_a_burst(spark):
    rows = [(1, "a", "created", "2024-01-01 00:00:00.000"), (2, "a", "modified", "2024-01-01 00:00:00.300"), (3, "a", "deleted", "2024-01-01 00:00:02"), (4, "b", "created", "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "event_id long, file_path string, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r["file_path"], r["events"], r["last_event"]) for r in changes.debounced(events, "file_path").collect())
    assert got == [("a", 1, "deleted"), ("a", 2, "modified"), ("b", 1, "created")]
    assert changes.relevant(spark.createDataFrame([("x.bin", "created"), ("x.bin", "deleted"), ("x.py", "created")], "file_path string, event_type string")).count() == 2


def test_windows_hold_every_file_once(spark):
    files = spark.createDataFrame([("r", f"dir{i % 3}/sub/file_{i:03}.py") for i in range(50)], "repo string, file_path string")
    got = changes.windows(files, 7).orderBy("file_path").collect()
    assert [r["window"] for r in got] == [i // 7 for i in range(50)]
    deep = spark.createDataFrame([("r", p) for p in [*(f"a/very/long/common/folder/of/many/levels/f{i:03}.py" for i in range(40)), "a/v", "a/very/long", "b", "a/very/long/common.py"]], "repo string, file_path string")
    for head_rows in (1, 3, 100):  # heads of different lengths keep the order of paths
        rows = changes.windows(deep, 3, head_rows).collect()
        assert [r["window"] for r in sorted(rows, key=lambda r: r["file_path"])] == [i // 3 for i in range(44)]


def test_schemas_are_complete():
    assert schemas.CHUNKS.fieldNames()[0] == "id" and "vector" in schemas.CHUNKS.fieldNames()
