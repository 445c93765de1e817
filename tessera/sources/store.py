"""Versioned, bucketed Parquet tables, merged on read.

A table is a set of folders, one for each write and bucket. A bucket is named by its project (a slot of the hash
of ``repo``) and, inside it, by a hash of the file; so a read of one project lists that project's folders alone.
A project begins with ``WIDTH`` bucket and gets more as its bytes grow.

Writes add and never rewrite: new rows are new folders, and keys that were in the table before are added to the
bucket's folders of gone keys, each with the version from which it holds. A read drops the rows of older folders
that have such a key (:func:`tessera.operators.merge.merge_on_read`); folders that no gone key can concern are read
without a join. So what a write costs follows from its own rows. :meth:`Store.compact` merges folders by size
tiers, ``FANOUT`` of about one size into one, and a whole bucket once a quarter of its rows are gone: a row is
rewritten a logarithmic number of times.

A version is a manifest that names, for each slot, a file with the slot's folders, and holds rows, files, bytes
and times of each project; a commit writes the slots that it touched and the manifest, and listings of projects
read the manifest alone. Publishing is one conditional create through Spark's CheckpointFileManager, the
interface by which streaming queries commit on any store: of two writers of a version one fails with
:class:`Conflict`, and a job that dies leaves folders that no manifest names, which :meth:`Store.vacuum` removes.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.functions import ids
from tessera.operators import merge

TABLES = {
    "chunks": schemas.CHUNKS, "symbols": schemas.SYMBOLS, "occurrences": schemas.OCCURRENCES, "files": schemas.FILES,
    "index_meta": schemas.INDEX_META, "project_meta": schemas.PROJECT_META, "zero_chunk_files": schemas.ZERO_CHUNK_FILES,
    "postings": schemas.POSTINGS, "doc_lengths": schemas.DOC_LENGTHS, "posting_blocks": schemas.POSTING_BLOCKS, "pending_files": schemas.PENDING_FILES,
    "vector_buckets": schemas.VECTOR_BUCKETS, "vector_centres": schemas.VECTOR_CENTRES, "vector_books": schemas.VECTOR_BOOKS,
    "vector_settings": schemas.VECTOR_SETTINGS, "file_stats": schemas.FILE_STATS, "trigrams": schemas.TRIGRAMS,
}
#: The project column and what a project's buckets are made of; other tables are bucketed by repo and file.
BUCKET_KEYS = {
    "index_meta": ("repo",), "project_meta": ("cache_key",), "postings": ("repo", "id"), "doc_lengths": ("repo", "id"), "posting_blocks": ("repo", "term"),
    "vector_buckets": ("repo", "bucket"), "vector_centres": ("repo",), "vector_books": ("repo",), "vector_settings": ("repo",),
}
#: Order inside a file, so that a filter skips row groups: a query reads the postings of its own terms.
SORTED_BY = {"chunks": ("id",), "postings": ("term", "shard", "id"), "posting_blocks": ("term", "shard"), "trigrams": ("gram", "file_path"), "occurrences": ("name", "file_path", "start_byte"), "vector_buckets": ("bucket", "id"), "symbols": ("file_path", "start_byte")}
#: A column that the others say, as rows have it that are made here: such a value is not stored but made again by a read, other values are stored as they are. A row has one, so rows may come without the column.
SAID = {"occurrences": ("id", lambda: ids.occurrence_id(F.col("file_path"), F.col("name"), F.col("start_byte")))}
#: A column whose sum by project the manifest keeps instead of a number of files: a writer's deltas, published with its rows.
MEASURES = {"doc_lengths": "dl"}
FILE_KEY = ("repo", "file_path")
SLOTS = 1 << 14
WIDTH = 1
MOST_WIDTH = 1 << 12
BUCKET_BYTES = 256 << 20
FANOUT = 4
LEAST_BYTES = 1 << 16  # of the first size tier
GONE_SHARE = 4  # a bucket is rewritten once one row in so many is gone
ORPHAN_S = 86_400.0
#: While a table is written: a job's shuffle files go with the job, not when the driver's memory is next cleared.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: And for rows made of dealt sources: so small a part of these to a task that its rows are sorted in memory.
DEALT = WRITING | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
CODEC = "zstd"  # ids repeat the paths and names beside them


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Manifest:
    """A version: of each slot the file that holds its folders, and of each project its rows, files, bytes and time."""

    def __init__(self, store: Store, name: str, version: int):
        self.store, self.name, self.version = store, name, version
        body = json.loads(store._text(store._path(name, f"manifest-{version}.json"))) if version else {}
        self.width: int = body.get("width", store.width)
        self.widths: dict[str, int] = body.get("widths", {})
        self.files: dict[str, str] = body.get("slots", {})
        self.projects: dict[str, dict] = body.get("projects", {})
        self.dropped: list[str] = []  # what this version no longer names
        self.before: list[str] = body.get("dropped", [])
        self._held: dict[str, dict] = {}
        self._changed: set[str] = set()

    def slot(self, slot: int | str, change: bool = False) -> dict:
        """{"parts": {bucket: [folders]}, "gone": {key: {bucket: [folders]}}, "stats": {folder: ...}, "removed": {bucket: {project: [rows, files]}}}"""
        slot = str(slot)
        if slot not in self._held:
            file = self.files.get(slot)
            self._held[slot] = json.loads(self.store._text(self.store._path(self.name, file))) if file else {"parts": {}, "gone": {}, "stats": {}, "removed": {}}
        if change:
            self._changed.add(slot)
        return self._held[slot]

    def slots(self) -> list[str]:
        return sorted({*self.files, *self._held}, key=int)

    def drop(self, slot: int | str) -> None:
        held = self.slot(slot, True)
        self.dropped += [f for parts in held["parts"].values() for f in parts]
        self.dropped += [f for by in held["gone"].values() for parts in by.values() for f in parts]
        self._held[str(slot)] = {"parts": {}, "gone": {}, "stats": {}, "removed": {}}

    def text(self, version: int, token: str) -> str:
        """Write the changed slots' files; the manifest's own text."""
        for slot in self._changed:
            held = self._held[slot]
            if slot in self.files:
                self.dropped.append(self.files.pop(slot))
            self.projects.pop(slot, None)
            if held["parts"]:
                self.files[slot] = f"slot-{slot}-{version}-{token}.json"
                self.store._put(self.store._path(self.name, self.files[slot]), json.dumps(held))
                self.projects[slot] = self._counted(held)
        return json.dumps({"width": self.width, "widths": self.widths, "slots": self.files, "projects": self.projects, "dropped": self.dropped})

    @staticmethod
    def _counted(held: dict) -> dict[str, list]:
        """{project: [rows, files, bytes, latest time, whether rows are gone]}; a folder's bytes go by its rows."""
        out: dict[str, list] = {}
        for stat in held["stats"].values():
            total = sum(n for n, *_ in stat["projects"].values())
            for project, (rows, files, last) in stat["projects"].items():
                own = out.setdefault(project, [0, 0, 0, 0.0, False])
                own[:] = [own[0] + rows, own[1] + files, own[2] + stat["bytes"] * rows // max(1, total), max(own[3], last or 0.0), own[4]]
        for removed in held["removed"].values():
            for project, (rows, files) in removed.items():
                if project in out:
                    own = out[project]
                    own[:] = [own[0] - rows, own[1] - files, own[2], own[3], own[4] or rows > 0]
        return out


class Store:
    def __init__(self, spark: SparkSession, root: str, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.width, self.bucket_bytes, self.fanout = spark, root.rstrip("/"), width, bucket_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._slots: dict[str, int] = {}
        # each step of a name is a call to the JVM
        self._paths, self._bytes_of = self._jvm.org.apache.hadoop.fs.Path, self._jvm.org.apache.commons.io.IOUtils.toByteArray
        self._files = self._paths(self.root).getFileSystem(self._conf)

    # --- files ----------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self._paths("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = self._files
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _text(self, path) -> str:
        stream = self._files.open(path)
        try:
            return bytes(self._bytes_of(stream)).decode("utf-8")
        finally:
            stream.close()

    def _put(self, path, text: str) -> None:
        stream = self._files.create(path, True)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()

    def _publish(self, path, text: str, overwrite: bool = False) -> bool:
        """Create a file whole or not at all; without ``overwrite``, only where there is none."""
        fs = self._files
        fs.mkdirs(path.getParent())
        if fs.getScheme() == "file" and not overwrite:  # its rename is not atomic; a link is made by one writer alone
            target = path.toUri().getPath()
            staged = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}.tmp"
            with open(staged, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(staged, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(staged)
        manager = getattr(getattr(self._jvm.org.apache.spark.sql.execution.streaming.checkpointing, "CheckpointFileManager$"), "MODULE$")
        stream = manager.create(path.getParent(), self._conf).createAtomic(path, overwrite)
        try:
            stream.write(text.encode("utf-8"))
            stream.close()
        except Py4JJavaError as e:
            stream.cancel()
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def read_json(self, name: str) -> dict | None:
        """A small document beside the tables; None where there is none or it does not parse."""
        path = self._path(f"{name}.json")
        try:
            return json.loads(self._text(path)) if self._files.exists(path) else None
        except ValueError:
            return None

    def write_json(self, name: str, value: dict) -> None:
        self._publish(self._path(f"{name}.json"), json.dumps(value), overwrite=True)

    def _commit(self, name: str, manifest: Manifest) -> int:
        """Publish the version after the manifest's own, and delete what the version before it had dropped."""
        version, token = manifest.version + 1, uuid.uuid4().hex[:8]
        if self.version(name) != manifest.version or not self._publish(self._path(name, f"manifest-{version}.json"), manifest.text(version, token)):
            raise Conflict(f"{name}: version {version} is another writer's")
        fs = self._files
        for folder in manifest.before:
            fs.delete(self._path(name, folder), True)
        fs.delete(self._path(name, f"manifest-{version - 2}.json"), False)
        return version

    def vacuum(self, name: str, older_s: float = ORPHAN_S) -> int:
        """Delete folders and slot files that no kept version names and that are older than ``older_s``: of dead writers."""
        current = self.version(name)
        kept = [Manifest(self, name, v) for v in (current - 1, current) if v > 0 and self._files.exists(self._path(name, f"manifest-{v}.json"))]
        live = {f for m in kept for f in (*m.files.values(), *m.dropped, *m.before)}
        for m in kept:
            for slot in m.files:
                held = m.slot(slot)
                live |= {f for parts in held["parts"].values() for f in parts} | {f for by in held["gone"].values() for parts in by.values() for f in parts}
        found = [n for n in self._names(name) if n.startswith("slot-")] + [f"{n}/{f}" for n in self._names(name) if n.startswith("v=") for f in self._names(name, n) if f.startswith("_bucket=")]
        fs, gone = self._files, 0
        for f in found:
            path = self._path(name, f)
            if f not in live and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 >= older_s:
                gone += bool(fs.delete(path, True))
        return gone

    # --- versions -------------------------------------------------------------------------------------------

    def version(self, name: str) -> int:
        found = [n for n in self._names(name) if n.startswith("manifest-") and n.endswith(".json")]
        return max((int(n[9:-5]) for n in found), default=0)

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        return Manifest(self, name, self.version(name) if version is None else version)

    def _begun(self, name: str, expected: int | None) -> Manifest:
        """The present manifest, which must be the one that a writer began from."""
        version = self.version(name)
        if expected is not None and expected != version:
            raise Conflict(f"{name}: version {version} has followed version {expected}")
        return self.manifest(name, version)

    def exists(self, name: str) -> bool:
        """The table has a version."""
        return self.version(name) > 0

    def slot(self, project: str) -> int:
        """The slot of a project's key, as :meth:`bucket` counts it."""
        if project not in self._slots:
            self._slots[project] = self.spark.sql("SELECT pmod(xxhash64(:p), :n)", args={"p": project, "n": SLOTS}).first()[0]
        return self._slots[project]

    def bucket(self, name: str, manifest: Manifest) -> Column:
        keys = BUCKET_KEYS.get(name, FILE_KEY)
        slot, width = F.pmod(F.xxhash64(keys[0]), F.lit(SLOTS)), F.lit(manifest.width)
        if manifest.widths:
            own = F.create_map(*[F.lit(int(x)) for kv in manifest.widths.items() for x in kv])
            width = F.coalesce(F.element_at(own, slot.cast("int")), width)
        return (slot * MOST_WIDTH + F.pmod(F.xxhash64(*keys), width)).cast("long")

    def projects(self, name: str) -> dict[str, list]:
        """{project: [rows, files, bytes, latest time, whether rows are gone]} from the manifest, without a job.

        For a table of ``MEASURES`` the sum stands in the place of the files. Files are exact where a file's rows come and go together; the time is the latest that was ever written.
        """
        out: dict[str, list] = {}
        for own in self.manifest(name).projects.values():
            out |= {p: x for p, x in own.items() if x[0] > 0}
        return out

    def _read_parts(self, name: str, folders: list[str], gone: dict[str, list[str]]) -> DataFrame:
        """The rows of ``folders`` without those of gone keys; folders newer than all gone keys need no join."""
        newest = max((_version(f) for parts in gone.values() for f in parts), default=0)
        out = None
        for part in ([f for f in folders if _version(f) >= newest], [f for f in folders if _version(f) < newest]):
            if not part:
                continue
            rows = self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{name}/{f}" for f in part])
            if name in SAID:
                column, made = SAID[name]
                rows = rows.withColumn(column, F.coalesce(column, made()))
            if _version(part[0]) < newest:
                rows = rows.withColumn("_at", F.regexp_extract("_metadata.file_path", r"/v=(\d+)-[^/]*/_bucket=", 1).cast("long"))
                for key, parts in gone.items():
                    if parts:
                        names = key.split(",")
                        kinds = T.StructType([TABLES[name][n] for n in names] + [T.StructField("_at", T.LongType())])
                        doomed = self.spark.read.schema(kinds).parquet(*[f"{self.root}/{name}/{f}" for f in parts])
                        rows = merge.merge_on_read(rows, doomed, names, "_at")
                rows = rows.drop("_at")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out

    def _read(self, name: str, manifest: Manifest, slots: Iterable[int | str], only: set[int] | None = None) -> DataFrame:
        folders: list[str] = []
        gone: dict[str, list[str]] = {}
        for slot in slots:
            held = manifest.slot(slot)
            folders += [f for b, parts in held["parts"].items() if only is None or int(b) in only for f in parts]
            for key, by in held["gone"].items():
                gone.setdefault(key, []).extend(f for b, parts in by.items() if only is None or int(b) in only for f in parts)
        return self._read_parts(name, folders, gone)

    def read(self, name: str, version: int | None = None, repo: str | None = None) -> DataFrame:
        """The present version, or that of one project; an empty frame where there is none."""
        manifest = self.manifest(name, version)
        if repo is None:
            return self._read(name, manifest, manifest.slots())
        # a slot may hold several projects
        return self._read(name, manifest, [self.slot(repo)]).where(F.col(BUCKET_KEYS.get(name, FILE_KEY)[0]) == repo)

    @contextmanager
    def _writing(self, settings: dict[str, str]) -> Iterator[None]:
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def dealt(self, name: str, sources: DataFrame, size: Column | None = None) -> DataFrame:
        """``sources``, which have the columns that make the buckets of a table, dealt by bucket: what is then made of them
        row by row can be written with ``dealt=True``, and a text passes the exchange instead of a row for each of its words.

        ``size`` is about the bytes that a source's rows will take, as :meth:`expect` takes it.
        """
        if size is not None:
            self.expect(name, sources, size)
        return sources.withColumn("_bucket", self.bucket(name, self.manifest(name))).hint("rebalance", "_bucket").drop("_bucket")

    def expect(self, name: str, sources: DataFrame, size: Column) -> int:
        """Slots that hold nothing yet get buckets for what is to come, by the sum of ``size`` of a project's ``sources``.

        A project that outgrows its buckets is dealt anew, which for a while takes its rows twice and their exchange.
        """
        manifest = self.manifest(name)
        slot = F.pmod(F.xxhash64(BUCKET_KEYS.get(name, FILE_KEY)[0]), F.lit(SLOTS))
        sizes = sources.groupBy(slot.cast("string").alias("slot")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).collect()  # a row for each slot
        wider = {r["slot"]: self._width(r["bytes"], manifest.width) for r in sizes if r["slot"] not in manifest.files}
        wider = {s: w for s, w in wider.items() if w > manifest.widths.get(s, manifest.width)}
        if not wider:
            return manifest.version
        manifest.widths |= wider
        return self._commit(name, manifest)

    def _width(self, size: int, width: int) -> int:
        """The buckets of a slot of ``size`` bytes, which has ``width`` of them."""
        while width * self.bucket_bytes < size and width < MOST_WIDTH:
            width *= 2
        return width

    def _stage(self, name: str, rows: DataFrame, manifest: Manifest, kinds: T.StructType | None = None, dealt: bool = False) -> dict[str, list[str]]:
        """Write ``rows`` below the next version's folder; the folder of each bucket. Large buckets are split by AQE.

        ``dealt`` rows stay in their tasks: those of a bucket are in few already, or there are few buckets.
        """
        schema: T.StructType = kinds or TABLES[name]
        if name in SAID and kinds is None:
            column, made = SAID[name]
            said = F.lit(None).cast(schema[column].dataType)
            rows = rows.withColumn(column, F.nullif(F.col(column), made()) if column in rows.columns else said)
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn("_bucket", self.bucket(name, manifest))
        target = f"v={manifest.version + 1}-{uuid.uuid4().hex[:8]}"  # of this writer alone
        placed = shaped if dealt else shaped.hint("rebalance", "_bucket")
        ordered = placed.sortWithinPartitions("_bucket", *(() if kinds else SORTED_BY.get(name, ())))
        with self._writing(DEALT if dealt else WRITING):
            ordered.write.mode("overwrite").option("compression", CODEC).partitionBy("_bucket").parquet(f"{self.root}/{name}/{target}")
        found = [n for n in self._names(name, target) if n.startswith("_bucket=")]
        return {n.removeprefix("_bucket="): f"{target}/{n}" for n in found}

    def _add(self, name: str, manifest: Manifest, fresh: dict[str, str]) -> None:
        """Name new folders, with what each holds of each project, as its footers and key columns say."""
        if not fresh:
            return
        project = BUCKET_KEYS.get(name, FILE_KEY)[0]
        fields = TABLES[name].fieldNames()
        top = next(iter(fresh.values())).split("/")[0]
        held = self.spark.read.schema(T.StructType([*TABLES[name].fields, T.StructField("_bucket", T.LongType())])).parquet(f"{self.root}/{name}/{top}")
        time_ = next((c for c in ("indexed_at", "updated_at") if c in fields), None)
        counted = held.groupBy("_bucket", F.col(project).alias("project")).agg(
            F.count(F.lit(1)).alias("rows"), (F.sum(MEASURES[name]) if name in MEASURES else F.countDistinct("file_path") if "file_path" in fields else F.lit(0)).alias("files"),
            (F.max(time_) if time_ else F.lit(None).cast("double")).alias("last"))
        stats: dict[str, dict] = {b: {"bytes": self._bytes(name, f), "projects": {}} for b, f in fresh.items()}
        for r in counted.collect():  # a row for each bucket and project of this write
            stats[str(r["_bucket"])]["projects"][r["project"]] = [r["rows"], r["files"], r["last"]]
        for bucket, folder in fresh.items():
            slot = manifest.slot(int(bucket) // MOST_WIDTH, True)
            slot["parts"].setdefault(bucket, []).append(folder)
            slot["stats"][folder] = stats[bucket]

    def _bytes(self, name: str, folder: str) -> int:
        path = self._path(name, folder)
        return self._files.getContentSummary(path).getLength()

    def _remove(self, name: str, manifest: Manifest, touched: DataFrame, key: tuple[str, ...]) -> int:
        """Add the touched keys that the table holds to the gone ones; the number of rows that go."""
        own = {r["b"] for r in touched.select(self.bucket(name, manifest).alias("b")).distinct().collect()}  # bucket numbers
        slots = {b // MOST_WIDTH for b in own}
        hit = {b for b in own if str(b) in manifest.slot(b // MOST_WIDTH)["parts"]}
        if not hit:
            return 0
        names = list(dict.fromkeys([*key, *BUCKET_KEYS.get(name, FILE_KEY), *[c for c in TABLES[name].fieldNames() if c in ("file_path", MEASURES.get(name))]]))
        rows = self._read(name, manifest, slots, hit).select(*names)
        doomed = rows.join(touched.select(*key).distinct(), list(key), "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        kinds = T.StructType([*[TABLES[name][n] for n in names], T.StructField("_at", T.LongType()), T.StructField("_n", T.LongType())])
        staged = self._stage(name, doomed.withColumn("_at", F.lit(manifest.version + 1)), manifest, kinds)
        if not staged:
            return 0
        top = next(iter(staged.values())).split("/")[0]
        held = self.spark.read.schema(T.StructType([*kinds.fields, T.StructField("_bucket", T.LongType())])).parquet(f"{self.root}/{name}/{top}")
        files = F.sum(F.col(MEASURES[name]) * F.col("_n")) if name in MEASURES else F.countDistinct("file_path") if "file_path" in names else F.lit(0)
        total = 0
        for r in held.groupBy("_bucket", F.col(BUCKET_KEYS.get(name, FILE_KEY)[0]).alias("project")).agg(F.sum("_n").alias("rows"), files.alias("files")).collect():
            slot = manifest.slot(r["_bucket"] // MOST_WIDTH, True)
            removed = slot["removed"].setdefault(str(r["_bucket"]), {}).setdefault(r["project"], [0, 0])
            removed[:] = [removed[0] + r["rows"], removed[1] + r["files"]]
            total += r["rows"]
        for bucket, folder in staged.items():
            manifest.slot(int(bucket) // MOST_WIDTH, True)["gone"].setdefault(",".join(key), {}).setdefault(bucket, []).append(folder)
        return total

    def write(self, name: str, rows: DataFrame, expected: int | None = None, dealt: bool = False) -> int:
        """Replace the table; ``expected`` is the version that ``rows`` were made from, ``dealt`` as in :meth:`dealt`."""
        manifest = self._begun(name, expected)
        for slot in manifest.slots():
            manifest.drop(slot)
        manifest.width, manifest.widths = self.width, {}
        self._add(name, manifest, self._stage(name, rows, manifest, dealt=dealt))
        return self._commit(name, manifest)

    def append(self, name: str, rows: DataFrame, dealt: bool = False) -> int:
        """B1: new folders beside the old; nothing is written for no rows."""
        manifest = self.manifest(name)
        fresh = self._stage(name, rows, manifest, dealt=dealt)
        if not fresh:
            return manifest.version
        self._add(name, manifest, fresh)
        return self._committed(name, manifest)

    def replace(self, name: str, rows: DataFrame | None, touched: DataFrame, key: tuple[str, ...] = FILE_KEY, expected: int | None = None, known: DataFrame | None = None) -> int:
        """Rows of the ``touched`` keys give way to ``rows`` (or to none); only these and the keys are written.

        ``touched`` has the key and the columns that make buckets; ``rows`` belong to touched keys. ``known`` are
        the touched keys that the table may hold, where the caller knows; without it the buckets' keys are read.
        """
        manifest = self._begun(name, expected)
        had = touched if known is None else known
        gone = self._remove(name, manifest, had, key) if manifest.files else 0
        fresh = {} if rows is None else self._stage(name, rows, manifest)
        if not fresh and not gone:
            return manifest.version
        self._add(name, manifest, fresh)
        return self._committed(name, manifest)

    def _committed(self, name: str, manifest: Manifest) -> int:
        changed, version = set(manifest._changed), self._commit(name, manifest)
        try:
            self.compact(name, changed)
        except Conflict:
            pass  # another writer went first, and compacts in turn
        return version

    def compact(self, name: str, slots: Iterable[str] | None = None) -> int:
        """Merge folders by size tiers, buckets of which a quarter is gone, and projects that have outgrown their buckets."""
        manifest = self.manifest(name)
        merged: list[tuple[str, str, list[str]]] = []  # slot, bucket, folders that become one
        gone: dict[str, list[str]] = {}
        small: list[tuple[str, str, str]] = []  # slot, key, bucket whose folders of gone keys become one
        for slot in manifest.slots() if slots is None else sorted(slots):
            held = manifest.slot(slot)
            size = sum(s["bytes"] for s in held["stats"].values())
            now = manifest.widths.get(slot, manifest.width)
            wanted = self._width(size, now)
            if wanted > now:
                manifest.widths[slot] = wanted
            for bucket, folders in held["parts"].items():
                tiers: dict[int, list[str]] = {}
                for f in folders:
                    tiers.setdefault(int(math.log(max(1.0, held["stats"][f]["bytes"] / LEAST_BYTES), self.fanout)), []).append(f)
                rows = sum(n for f in folders for n, *_ in held["stats"][f]["projects"].values())
                lost = sum(n for n, _ in held["removed"].get(bucket, {}).values())
                whole = wanted > now or lost * GONE_SHARE > rows
                chosen = folders if whole else [f for parts in tiers.values() if len(parts) >= self.fanout for f in parts]
                if chosen:
                    merged.append((slot, bucket, list(chosen)))
                    for key, by in held["gone"].items():
                        gone.setdefault(key, []).extend(by.get(bucket, []))
                if not whole:
                    small += [(slot, key, bucket) for key, by in held["gone"].items() if len(by.get(bucket, [])) >= self.fanout]
        if not merged and not small:
            return manifest.version
        fresh = self._stage(name, self._read_parts(name, [f for *_, parts in merged for f in parts], gone), manifest) if merged else {}
        before = {slot: Manifest._counted(manifest.slot(slot)) for slot, *_ in merged}
        for slot, bucket, folders in merged:
            held = manifest.slot(slot, True)
            left = [f for f in held["parts"].pop(bucket) if f not in folders]
            for f in folders:
                held["stats"].pop(f)
            manifest.dropped += folders
            if left:
                held["parts"][bucket] = left
            else:  # nothing older is left for the gone keys to concern
                for by in held["gone"].values():
                    manifest.dropped += by.pop(bucket, [])
                held["removed"].pop(bucket, None)
        self._add(name, manifest, fresh)
        for slot in before:
            held = manifest.slot(slot, True)
            counted = Manifest._counted(held)
            for removed in held["removed"].values():
                for project in [p for p in removed if p not in counted]:  # nothing is left to take them off from
                    removed.pop(project)
            for project, (rows, files, *_) in counted.items():
                # rows that were gone have left some folder: what is still to be taken off is less by as many
                over = [before[slot].get(project, [0, 0])[0] - rows, before[slot].get(project, [0, 0])[1] - files]
                for removed in held["removed"].values():
                    if project in removed:
                        taken = [min(a, b) for a, b in zip(removed[project], over, strict=True)]
                        removed[project] = [a - b for a, b in zip(removed[project], taken, strict=True)]
                        over = [a - b for a, b in zip(over, taken, strict=True)]
        for slot, key, bucket in small:
            held = manifest.slot(slot, True)
            parts = held["gone"].get(key, {}).get(bucket)
            if parts and len(parts) >= self.fanout:
                joined = self.spark.read.parquet(*[f"{self.root}/{name}/{f}" for f in parts])
                kinds = T.StructType(joined.schema.fields)
                held["gone"][key][bucket] = list(self._stage(name, joined, manifest, kinds).values())
                manifest.dropped += parts
        return self._commit(name, manifest)

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> int:
        """B2. A row's key and its bucket go together: ids are made from projects and paths."""
        return self.replace(name, rows, rows, (key,))

    def delete_files(self, name: str, repo: str, file_paths: list[str]) -> int:
        """Files of one project leave a table; the number of rows that are gone."""
        if not file_paths:
            return 0
        manifest = self.manifest(name)
        gone = self._remove(name, manifest, self.spark.createDataFrame([(repo, p) for p in file_paths], "repo string, file_path string"), FILE_KEY) if manifest.files else 0
        if gone:
            self._committed(name, manifest)
        return gone

    def clear(self, name: str) -> int:
        """B4."""
        manifest = self.manifest(name)
        for slot in manifest.slots():
            manifest.drop(slot)
        manifest.width, manifest.widths = self.width, {}
        return self._commit(name, manifest)

    def delete_rows(self, name: str, repos: list[str]) -> int:
        """The projects' rows leave a table; the number of rows that are gone.

        A slot that holds no other project is dropped from the manifest without a look at its files.
        """
        total = 0
        for repo in repos:
            manifest = self.manifest(name)
            slot = str(self.slot(repo))
            held = Manifest._counted(manifest.slot(slot)) if slot in manifest.files else {}
            if not held.get(repo, [0])[0]:
                continue
            if held.keys() == {repo}:
                total += held[repo][0]
                manifest.drop(slot)
                self._commit(name, manifest)
            else:
                keys = BUCKET_KEYS.get(name, FILE_KEY)
                mine = self._read(name, manifest, [slot]).where(F.col(keys[0]) == repo).select(*keys)
                total += self._remove(name, manifest, mine, keys)
                self._committed(name, manifest)
        return total

    def delete_repo(self, repo: str) -> str:
        """Drop a repository's rows from the index tables; 'deleted' or 'not_found'."""
        if repo not in self.projects("files"):
            return "not_found"
        for name in ("files", "symbols", "occurrences", "index_meta"):
            self.delete_rows(name, [repo])
        return "deleted"

    def write_index_meta(self, now: float, repo: str) -> int:
        """A project's counts from its index tables, never the other way round."""
        counted = self.read("files", repo=repo).groupBy("repo").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("files"))
        for name in ("symbols", "occurrences"):
            own = self.read(name, repo=repo).groupBy("repo").agg(F.count(F.lit(1)).alias(name))
            counted = counted.join(own, "repo", "left").fillna(0, [name])
        named = self.spark.createDataFrame([(repo,)], "repo string")
        return self.replace("index_meta", counted.withColumn("updated_at", F.lit(now)), named, ("repo",))

    def merge_project_meta(self, project_path: str, aliases: list[str], now: float) -> int:
        """The project's path, time and aliases; aliases known before stay, in order of first sight."""
        new = self.spark.createDataFrame([(project_path, now, aliases)], "project_path string, updated_at double, alias_paths array<string>")
        new = new.withColumn("cache_key", ids.cache_key(F.col("project_path")))
        base = self.version("project_meta")
        held = self.read("project_meta", version=base).join(new.select("cache_key"), "cache_key", "left_semi")
        merged = merge.merge_aliases(held.select("cache_key", "alias_paths"), new.select("cache_key", "alias_paths"))
        rows = new.drop("alias_paths").join(merged, "cache_key")
        return self.replace("project_meta", rows, new, ("cache_key",), expected=base)

    # --- inventories ----------------------------------------------------------------------------------------

    def semantic_inventory(self, exists: Callable[[str], bool | None]) -> DataFrame:
        """A row per project of the chunk table or of the project meta, as ``maintenance.orphan_caches`` takes it.

        Sizes and times are the manifest's, so no chunk is read.

        ``exists`` is asked on the driver, once a project; None: could not be seen.
        """
        held = [(p, x[2], x[3]) for p, x in self.projects("chunks").items()]
        chunks = self.spark.createDataFrame(held, "repo string, bytes long, mtime double").withColumn("name", ids.cache_key(F.col("repo")))
        meta = self.read("project_meta").select(F.col("cache_key").alias("name"), "project_path", "updated_at", F.lit(True).alias("meta"))
        both = chunks.join(meta, "name", "full_outer")
        paths = [r[0] for r in both.select("project_path").where("project_path IS NOT NULL").distinct().toLocalIterator()]
        seen = self.spark.createDataFrame([(p, exists(p)) for p in paths], "project_path string, project_exists boolean")
        return both.join(seen, "project_path", "left").select(
            "name", "repo", F.lit(True).alias("is_dir"), F.lit(False).alias("is_symlink"), F.col("meta").isNotNull().alias("has_meta"),
            F.col("project_path").isNotNull().alias("meta_ok"), F.col("bytes").isNotNull().alias("has_chunks"), "project_path", "project_exists",
            F.coalesce("mtime", "updated_at").alias("mtime"), F.coalesce("bytes", F.lit(0)).alias("bytes"))

    def symbol_inventory(self, exists: Callable[[str], bool | None]) -> DataFrame:
        """A row per symbol index, per row of index_meta (its sidecar) and per file that a dead writer left."""
        key = ids.index_key(F.col("repo"))
        files = self.read("files").groupBy("repo").agg(F.max("version").alias("version"), F.sum(F.octet_length("file_path")).cast("long").alias("bytes"))
        meta = self.read("index_meta")
        both = files.join(meta.select("repo", F.col("updated_at").alias("mtime")), "repo", "full_outer")
        local = [r[0] for r in both.select("repo").where("repo IS NOT NULL AND NOT startswith(repo, 'github:')").distinct().toLocalIterator()]
        seen = self.spark.createDataFrame([(p, exists(p)) for p in local], "repo string, repo_exists boolean")
        indexes = files.join(meta.select("repo", F.col("updated_at").alias("mtime")), "repo", "left").select(
            F.concat(F.lit("index_"), key, F.lit(".json")).alias("name"), "repo", F.col("version").isNotNull().alias("json_ok"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), "bytes"
        )
        sidecars = meta.select(F.concat(F.lit("index_"), key, F.lit(".meta.json")).alias("name"), "repo", F.lit(True).alias("json_ok"), F.col("updated_at").alias("mtime"), F.lit(0).cast("long").alias("bytes"))
        rows = indexes.unionByName(sidecars).join(seen, "repo", "left")
        return rows.select("name", "repo", F.lit(True).alias("is_file"), F.lit(False).alias("is_symlink"), "json_ok", F.col("repo").alias("repo_path"), "repo_exists", "mtime", "bytes")


def list_repos(files: DataFrame) -> DataFrame:
    """Repo, its index key and number of files."""
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("files")).withColumn("index_key", ids.index_key(F.col("repo")))


def recent_projects(meta: DataFrame, existing: DataFrame, k: int = 20) -> DataFrame:
    """Projects that still exist, latest first. ``existing`` has project_path."""
    alive = meta.join(existing.select("project_path").distinct(), "project_path", "left_semi")
    return alive.orderBy(F.desc("updated_at"), "project_path").limit(max(0, k))


def parse_meta(rows: DataFrame, column: str = "body") -> DataFrame:
    """A project's meta as a JSON document to columns; nulls where it is missing or does not parse."""
    parsed = F.from_json(F.col(column), "project_path string, updated_at double, alias_paths array<string>", {"mode": "PERMISSIVE"})
    return rows.withColumn("meta", parsed).select(*[c for c in rows.columns if c != column], "meta.*")


def verified_sidecars(sidecars: DataFrame) -> DataFrame:
    """Sidecars (file_name, repo_path) whose name holds the key of the path that they state."""
    return sidecars.where(ids.index_key(F.col("repo_path")) == F.regexp_extract("file_name", r"^index_([0-9a-f]{16})\.", 1))


def counts(chunks: DataFrame) -> DataFrame:
    """E1, E2, E5, E16 per repository: chunks, files, latest indexed_at (0.0 for none)."""
    return chunks.groupBy("repo").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files"),
        F.coalesce(F.max("indexed_at"), F.lit(0.0)).alias("latest_indexed_at"))


def latest_indexed_at(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.max("indexed_at"), F.lit(0.0)).alias("latest_indexed_at"))


def indexed_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("repo", "file_path").distinct()


def file_hashes(chunks: DataFrame) -> DataFrame:
    """One hash a file; it is the same in all rows of the file."""
    return chunks.groupBy("repo", "file_path").agg(F.min("file_hash").alias("file_hash"))


def _version(folder: str) -> int:
    """The version that wrote a folder."""
    return int(folder[2:].split("-", 1)[0])
