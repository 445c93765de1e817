"""A streaming source of file changes.

A plain file stream knows files by path and delivers each once: rewritten and deleted files never appear. This
source lists the tree at each trigger and compares (path, time, size) with the listing of the offset before;
the listings lie in a folder of their own, one file per offset, so a restart continues where it stopped.

Changes are debounced at their trailing edge (I4): a file written, or a deletion first seen, less than
``debounceMs`` ago keeps its former state in the listing until it has been quiet for so long. A trigger waits for
that once, so that a single run also sees the last change.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file_path string, event_type string, mtime double, size long"
FILES_PER_PARTITION = 10_000


class _Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(rows)


class SnapshotReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, debounce_s: float = 0.0):
        self.root, self.state, self.debounce_s = root.rstrip("/"), state, debounce_s
        self._missing: dict[str, float] = {}
        os.makedirs(state, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.state, f"listing-{number}.json")

    def _held(self, number: int) -> dict[str, list]:
        try:
            with open(self._file(number), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _listing(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for folder, dirs, names in os.walk(self.root, followlinks=False):
            dirs[:] = sorted(d for d in dirs if d != ".git")
            for name in sorted(names):
                full = os.path.join(folder, name)
                try:
                    info = os.lstat(full)
                except OSError:
                    continue
                out[os.path.relpath(full, self.root)] = [info.st_mtime, info.st_size]
        return out

    def _quiet(self, old: dict[str, list], new: dict[str, list], now: float) -> tuple[dict[str, list], float]:
        """``new`` with the files that changed too lately as they were, and the seconds until the last is quiet."""
        out, wait = {}, 0.0
        for path, state in new.items():
            left = state[0] + self.debounce_s - now if old.get(path) != state else 0.0
            if 0 < left <= self.debounce_s:
                wait = max(wait, left)
                if path in old:
                    out[path] = old[path]
            else:
                out[path] = state
        gone = {p for p in old if p not in new}
        self._missing = {p: self._missing.get(p, now) for p in gone}
        for path in gone:
            left = self._missing[path] + self.debounce_s - now
            if left > 0:
                wait = max(wait, left)
                out[path] = old[path]
        return out, wait

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        numbers = [int(x[8:-5]) for x in os.listdir(self.state) if x.startswith("listing-") and x.endswith(".json")]
        last = max(numbers, default=0)
        held = self._held(last)
        now, wait = self._quiet(held, self._listing(), time.time())
        if wait > 0:
            time.sleep(wait)
            now, _ = self._quiet(held, self._listing(), time.time())
        if now == held:
            return {"n": last}
        staged = self._file(last + 1) + ".tmp"
        with open(staged, "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(staged, self._file(last + 1))
        return {"n": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._held(start["n"]), self._held(end["n"])
        rows = [(p, "created" if p not in old else "modified", *v) for p, v in sorted(new.items()) if old.get(p) != v]
        rows += [(p, "deleted", old[p][0], 0) for p in sorted(old) if p not in new]
        return [_Changes(rows[i : i + FILES_PER_PARTITION]) for i in range(0, len(rows), FILES_PER_PARTITION)] or [_Changes([])]

    def read(self, partition: InputPartition):
        for path, kind, mtime, size in partition.value:
            yield path, kind, float(mtime), int(size)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):
            if name.startswith("listing-") and name.endswith(".json") and int(name[8:-5]) < end["n"] - 1:
                os.remove(os.path.join(self.state, name))


class SnapshotSource(DataSource):
    """``spark.readStream.format("file_changes").option("path", root).option("state", folder).load()``"""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SnapshotReader(self.options["path"], self.options["state"], float(self.options.get("debounceMs", "0")) / 1000)
