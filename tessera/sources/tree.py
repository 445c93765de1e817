"""A batch source of source trees (A1): ``spark.read.format("source_tree").option("path", root).load()``.

Spark's own file listing leaves out names that begin with "_" or ".", such as ``__init__.py``. This source walks
the tree itself: the driver looks at the upper folders only, each of which a task then walks, pruning skipped
folders before it descends. The options ``paths`` (a JSON list) and ``beginning`` say which paths are
asked for, and so which folders are looked at. They are options and no pushed filters, as Spark 4.1 keeps what a
source has taken from one query for the next query of the same frame. It lists and opens nothing; :func:`contents` reads the files that a plan still wants
once names and sizes have been judged. It is for file systems that are mounted where the tasks run; other stores
take the built-in binary reader.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.predicates import MAX_FILE_BYTES, SKIP_DIRS

SCHEMA = "repo string, file_path string, ext string, size long, mtime double"
#: Folders that the driver opens at most to find work for the tasks.
OPENED = 256
WANTED = 64
BATCH_BYTES = 8 << 20


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))


def _kept(names: list[str]) -> list[str]:
    return sorted(d for d in names if d not in SKIP_DIRS and not d.endswith(".egg-info"))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.repo = options.get("repo", self.root)
        self.paths: set[str] | None = set(json.loads(options["paths"])) if "paths" in options else None
        self.beginning = options.get("beginning", "")

    def _reached(self, folder: str) -> bool:
        """Whether a walk from the root would come to the folder: no part of it is skipped or a link."""
        parts = [p for p in folder.split("/") if p]
        if _kept(parts) != sorted(parts) or any(p in (".", "..") for p in parts):
            return False
        return not any(os.path.islink(os.path.join(self.root, *parts[: i + 1])) for i in range(len(parts)))

    def partitions(self) -> list[InputPartition]:
        """Folders to walk: from the root on, the shallowest are opened until there is work for many tasks.

        Of asked paths only their own folders; of a beginning of paths, only the folder that it lies in.
        """
        if self.paths is not None:
            return [_Folder(f, False) for f in sorted({os.path.dirname(p) for p in self.paths if p and not p.startswith("/")}) if self._reached(f)]
        top = self.beginning.rpartition("/")[0]
        if not self._reached(top):
            return []
        closed, parts = [top], []
        for _ in range(OPENED):
            if not closed or len(closed) + len(parts) >= WANTED:
                break
            folder = closed.pop(0)
            try:
                entries = [e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False)]
            except OSError:
                entries = []
            parts.append(_Folder(folder, False))
            closed += [os.path.join(folder, d) for d in _kept(entries)]
        return parts + [_Folder(f, True) for f in closed]

    def read(self, partition: InputPartition):
        folder, deep = partition.value
        real_root = os.path.realpath(self.root)
        for top, dirs, names in os.walk(os.path.join(self.root, folder) if folder else self.root, followlinks=False):
            dirs[:] = _kept(dirs) if deep else []
            for name in sorted(names):
                full = os.path.join(top, name)
                path = os.path.relpath(full, self.root)
                if not path.startswith(self.beginning) or (self.paths is not None and path not in self.paths):
                    continue
                try:
                    info = os.stat(full)
                except OSError:
                    continue
                if os.path.islink(full) and not os.path.realpath(full).startswith(real_root + os.sep):
                    continue
                ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
                yield self.repo, path, ext, info.st_size, info.st_mtime


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def contents(files: DataFrame, root: str, head: int | None = None) -> DataFrame:
    """``files`` (with file_path) with content and file_hash, read in the tasks; files that are gone are left out.

    With ``head`` only so many bytes are read, and the hash is null. Batches close by bytes.
    """
    root = root.removeprefix("file://").rstrip("/") or "/"
    limit = MAX_FILE_BYTES
    names = [c for c in files.columns if c not in ("content", "file_hash")]
    packed = files.select("file_path", F.struct(*names).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bodies, held = [], [], 0
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    if ".." in path.split("/"):
                        continue
                    with open(os.path.join(root, path), "rb") as f:
                        body = f.read(limit + 1 if head is None else head)
                except (OSError, ValueError, AttributeError):
                    continue
                at.append(k)
                bodies.append(body if len(body) <= limit else None)
                held += len(body)
                if held >= BATCH_BYTES:
                    yield _batch(batch, at, bodies, head)
                    at, bodies, held = [], [], 0
            yield _batch(batch, at, bodies, head)

    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"row {kind}, content binary, file_hash string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "content", "file_hash")


def _batch(batch: pa.RecordBatch, at: list[int], bodies: list[bytes | None], head: int | None) -> pa.RecordBatch:
    hashes = [None if b is None or head is not None else hashlib.sha256(b).hexdigest() for b in bodies]
    return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array(bodies, pa.binary()), pa.array(hashes, pa.string())], names=["row", "content", "file_hash"])
