"""The engine: the tool surface as methods that return DataFrames, with thin envelopes for callers that want dicts.

Tables lie in a :class:`tessera.sources.store.Store`; every method builds one plan. Errors of input are
returned by :meth:`Engine.call` as ``{"error": ...}``; the methods themselves raise ``ValueError``.
"""

from __future__ import annotations

import logging
import os
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import ids
from tessera.operators import ann, chunking, diff, digests, discovery, embedding, extract, grams, ignore, maintenance, search, symbols
from tessera.operators import predicates as P
from tessera.sources import corpus, remote, store
from tessera.streaming import changes

MAX_PROJECTS = 20
WARN_SHARE = 0.8
SWEEP_DELAY_S = 300.0
JOB_HISTORY = 100


log = logging.getLogger("tessera")


def common_rows(report: DataFrame) -> DataFrame:
    """A report as rows of its own, so that it stays what it was when the tables it came from change."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)  # names and numbers of what is to go


@dataclass
class Settings:
    """What the environment configures elsewhere is a parameter here."""

    warehouse_dir: str
    chunk_size: int = chunking.CHUNK_SIZE
    metric: str = "l2"
    max_files: int = 500
    max_files_per_window: int = 10_000
    max_wall_s: float = 60.0
    debounce_ms: int = 500
    vector_index_rows: int = ann.THRESHOLD
    staleness_deadline_s: float = 4.0
    query_timeout_s: float = 45.0
    grace_s: int = maintenance.GRACE_S
    allow_destructive: bool = False
    keep_missing: bool = False
    worker_threads: int = 4
    repo_key: Callable[[str], str] = os.path.abspath


@dataclass
class Job:
    tool: str
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "queued"
    created_at: float = field(default_factory=time.time)
    started_at: float | None = None
    finished_at: float | None = None
    error: str | None = None


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, embedder: embedding.Embedder | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.settings, self.clock = spark, settings, clock
        self.embedder = embedder or embedding.HashEmbedder()
        self.store = store.Store(spark, settings.warehouse_dir)
        self.ledger = maintenance.Ledger(lambda: (self.store.read_json("ledger") or {}).get("total"), lambda total: self.store.write_json("ledger", {"total": total}))
        self._projects: OrderedDict[str, set[str]] = OrderedDict()
        self._watchers: dict[str, object] = {}
        self._refreshing: set[str] = set()
        self._last_error: str | None = None
        self._jobs: list[Job] = []
        self._lock = threading.Lock()
        self._sweep: threading.Timer | None = None
        self._remotes: dict[str, Callable[[str], bytes | None]] = {}

    # --- corpus ---------------------------------------------------------------------------------------------

    def listing(self, path: str, only: list[str] | None = None, beginning: str = "") -> DataFrame:
        """Files of a project that no rule on names or sizes rejects; none is opened.

        Of the paths in ``only``, or those with a ``beginning``, only the folders are walked.
        """
        found = corpus.listing(self.spark, path, self._register(path), only, beginning)
        return discovery.named(found, path, corpus.root_rules(self.spark, path))

    def files(self, path: str) -> DataFrame:
        """Discovered files of a project with their contents, which are read once names and sizes are judged."""
        return corpus.contents(self.listing(path), path).where(~P.is_binary(F.col("content")))

    def _unseen(self, listed: DataFrame, repo: str) -> DataFrame:
        """Listed files that were not seen with this size and time when the project was indexed."""
        seen = self.store.read("file_stats", repo=repo)
        return digests.suspects(listed, seen, digests.changed_folders(digests.folder_digests(listed), digests.folder_digests(seen)))

    def _opened(self, files: DataFrame, path: str) -> DataFrame:
        """``files`` with their contents; binary ones have neither content nor hash."""
        found, binary = corpus.contents(files, path), P.is_binary(F.col("content"))
        return found.withColumns({"content": F.when(~binary, F.col("content")), "file_hash": F.when(~binary, F.col("file_hash"))})

    def current(self, path: str, listed: DataFrame | None = None) -> DataFrame:
        """repo, file_path, size, mtime, file_hash of a project's present files; only those unseen so far are opened."""
        repo = self._register(path)
        listed = self.listing(path) if listed is None else listed
        opened = self._opened(self._unseen(listed, repo), path)
        return digests.current(listed, self.store.read("file_stats", repo=repo), opened).where("file_hash IS NOT NULL")

    def _register(self, path: str) -> str:
        """The canonical key of a project, remembered with the path as its alias."""
        key = self.settings.repo_key(path)
        if key not in self._projects:
            if len(self._projects) >= MAX_PROJECTS:
                raise ValueError(f"at most {MAX_PROJECTS} projects can be loaded")
            if len(self._projects) + 1 >= WARN_SHARE * MAX_PROJECTS:
                log.warning("%d of %d projects are loaded", len(self._projects) + 1, MAX_PROJECTS)
        self._projects.setdefault(key, set()).add(path)
        return key

    def _note(self, repo: str) -> None:
        """The project's meta, with the aliases under which it is loaded."""
        self.store.merge_project_meta(repo, sorted(self._projects.get(repo, {repo}) - {repo}), self.clock())

    def project_meta(self, path: str) -> DataFrame:
        """A10: no row where nothing is known of the project."""
        key = ids.cache_key(F.lit(self.settings.repo_key(path)))
        return self.store.read("project_meta").where(F.col("cache_key") == key)

    # --- semantic tools -------------------------------------------------------------------------------------

    def pending(self, path: str, files: DataFrame | None = None) -> DataFrame:
        """Files to index, in order."""
        now, (indexed, zero) = self.current(path) if files is None else files, self._known(self._register(path))
        return diff.in_order(diff.pending_files(now.select("repo", "file_path", "file_hash"), indexed, zero))

    def zero_chunk_files(self, path: str) -> DataFrame:
        """S5."""
        return diff.in_order(self.store.read("zero_chunk_files", repo=self._register(path)))

    def _known(self, repo: str) -> tuple[DataFrame, DataFrame]:
        return store.file_hashes(self.store.read("chunks", repo=repo)), self.store.read("zero_chunk_files", repo=repo)

    def index_semantic(self, path: str, files: DataFrame | None = None) -> DataFrame:
        """Bring the chunk table up to date; one row of counts, with the files that remain.

        Files are taken in bounded windows in order of path (I7). A run does at least one window and begins no
        other after ``max_wall_s``; what it has not reached lies in the table of pending files, where the next
        run goes on without looking at the tree again (I8).
        """
        repo, began = self._register(path), self.clock()
        waiting = self.store.read("pending_files", repo=repo) if files is None else None
        if waiting is None or waiting.isEmpty():
            waiting = self._begin_index(repo, path, files)
        numbers = sorted(r[0] for r in waiting.select("window").distinct().collect())  # a row per window
        done = 0
        for number in numbers:
            if done and self.clock() - began > self.settings.max_wall_s:
                break
            self._index_window(repo, path, waiting.where(F.col("window") == number), files)
            done += 1
        rest = waiting.where(F.col("window") > numbers[done - 1]) if done else waiting
        held = self.store.read("pending_files", repo=repo)
        if done < len(numbers) or not held.isEmpty():
            self.store.replace("pending_files", rest, held.select(*store.FILE_KEY).unionByName(rest.select(*store.FILE_KEY)))
        left = self.store.read("pending_files", repo=repo).count()
        if not left:
            self._update_vector_index(repo)
            self._note(repo)
        return self.status(path).withColumn("remaining", F.lit(left))

    def _begin_index(self, repo: str, path: str, files: DataFrame | None) -> DataFrame:
        """The windows of pending files; files that are gone leave the tables at once.

        Of a tree only files that were not seen before are opened; what was seen of them, and their trigrams, is kept.
        """
        now = (self._look(repo, path) if files is None else files).select("repo", "file_path", "file_hash").cache()
        try:
            indexed, zero = self._known(repo)
            if not self.settings.keep_missing:
                gone, without = diff.stale_indexed(indexed, now), diff.stale_indexed(zero, now)
                if not gone.isEmpty():
                    lost = self.store.read("chunks", repo=repo).join(gone, ["repo", "file_path"], "left_semi").select("repo", "id")
                    for name in ("postings", "doc_lengths"):
                        self.store.replace(name, None, lost, ("repo", "id"))
                    self.store.replace("chunks", None, gone)
                if not without.isEmpty():
                    self.store.replace("zero_chunk_files", None, without)
            todo = changes.windows(diff.pending_files(now, indexed, zero), self.settings.max_files_per_window)
            before = indexed.select(*store.FILE_KEY).unionByName(zero.select(*store.FILE_KEY)).distinct().withColumn("known", F.lit(True))
            todo = todo.join(before, list(store.FILE_KEY), "left").fillna(False, ["known"])
            self.store.replace("pending_files", todo, todo.select(*store.FILE_KEY))
            return self.store.read("pending_files", repo=repo)
        finally:
            now.unpersist()

    def _look(self, repo: str, path: str) -> DataFrame:
        """The project's files and hashes; the tables of what was seen, and of trigrams, follow the tree."""
        listed = self.listing(path).persist(StorageLevel.DISK_ONLY)
        opened = self._opened(self._unseen(listed, repo), path).persist(StorageLevel.DISK_ONLY)
        try:
            seen = self.store.read("file_stats", repo=repo)
            key = list(store.FILE_KEY)
            gone = seen.select(*key).join(listed.select(*key), key, "left_anti")
            touched = opened.select(*key).unionByName(gone)
            if not touched.isEmpty():
                stats = opened.select(*key, "size", "mtime", "file_hash")
                posted = grams.trigrams(corpus.with_text(opened.where("content IS NOT NULL")))
                self.store.replace("trigrams", posted, touched)  # first: what is seen is posted
                self.store.replace("file_stats", stats, touched)
            return self.store.read("file_stats", repo=repo).where("file_hash IS NOT NULL")
        finally:
            opened.unpersist()
            listed.unpersist()

    def _index_window(self, repo: str, path: str, todo: DataFrame, files: DataFrame | None) -> None:
        """The files of one window: cut, embedded, stored; only they are opened, and new files write only their rows."""
        keys, known = todo.select(*store.FILE_KEY), todo.where("known").select(*store.FILE_KEY)
        found = corpus.contents(keys, path) if files is None else files.join(keys, list(store.FILE_KEY), "left_semi")
        cut = chunking.chunk_files(corpus.with_text(found), self.settings.chunk_size)
        rows = embedding.embed_chunks(cut, self.embedder).withColumn("indexed_at", F.lit(self.clock()))
        # embedded once: the rows are held until the tables and indexes have them
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            base = self.store.version("chunks")
            old = self.store.read("chunks", repo=repo, version=base).join(known, list(store.FILE_KEY), "left_semi").select("repo", "id")
            gone = common_rows(old) if known.limit(1).count() else old.limit(0)  # ids of one window's chunks
            self.store.replace("chunks", rows, keys, expected=base, known=known)
            without = found.select("repo", "file_path", "file_hash").join(rows.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
            self.store.replace("zero_chunk_files", without, keys, known=known)
            self._update_text_index(rows.select("repo", "id", "content"), gone.unionByName(rows.select("repo", "id")), gone)
        finally:
            rows.unpersist()

    def _update_text_index(self, texts: DataFrame, touched: DataFrame, gone: DataFrame | None = None) -> None:
        """Postings and lengths of the chunks that came or went (``gone``, where the caller knows them)."""
        named = texts.select("repo", "id")
        found = search.sharded_postings(texts).join(named, "id")
        self.store.append("posting_blocks", search.posting_blocks(found, "repo"))  # bounds first: they may be ahead of their postings
        for name, rows in (("postings", found), ("doc_lengths", search.document_lengths(texts).join(named, "id"))):
            self.store.replace(name, rows, touched, ("repo", "id"), known=gone)

    def _update_vector_index(self, repo: str) -> None:
        """The vector index of a project with many vectors. Rows that came since the last time are assigned to
        the stored centroids; the index is fitted and calibrated anew once its rows have doubled."""
        n = self.store.projects("chunks").get(repo, [0])[0]
        if not ann.wanted(n, self.settings.vector_index_rows):
            return
        rows = self.store.read("chunks", repo=repo).select("repo", "id", "vector", "indexed_at").where("vector IS NOT NULL")
        index = self._vector_index(repo)
        if index is None or n > ann.GROWTH * index.rows:
            index = ann.train(rows, ann.n_buckets(n))
            built = ann.build(rows, index).where("bucket IS NOT NULL")
            self.store.delete_rows("vector_buckets", [repo])
            self.store.append("vector_buckets", built)
            index = ann.calibrate(self.store.read("vector_buckets", repo=repo), index, metric=self.settings.metric)
            centres = [(repo, k, [float(x) for x in c]) for k, c in enumerate(index.centres)]
            books = [(repo, p, k, [float(x) for x in c]) for p, book in enumerate(index.books) for k, c in enumerate(book)]
            settings = [(repo, index.probes, index.measured, index.recall, n, self.settings.metric)]
            for name, found in (("vector_centres", centres), ("vector_books", books), ("vector_settings", settings)):
                held = self.spark.createDataFrame(found, store.TABLES[name])
                self.store.replace(name, held, held.select("repo").distinct(), ("repo",))
            return
        last = self.store.projects("vector_buckets").get(repo, [0, 0, 0, 0.0])[3]
        held = self.store.read("vector_buckets", repo=repo).select("repo", "bucket", "id", "indexed_at")
        gone = held.join(rows.select("id", "indexed_at"), ["id", "indexed_at"], "left_anti")
        new = rows.where(F.col("indexed_at") >= last).join(held.select("id", "indexed_at"), ["id", "indexed_at"], "left_anti")
        built = ann.build(new, index).where("bucket IS NOT NULL")
        key = ("repo", "bucket", "id")
        self.store.replace("vector_buckets", built, gone.select(*key), key, known=gone.select(*key))

    def _vector_index(self, repo: str) -> ann.Index | None:
        """What is stored of a project's index: as much as the number of buckets and codes allows, whatever the rows."""
        found = self.store.read("vector_settings", repo=repo).first()
        if found is None or found["metric"] != self.settings.metric:
            return None
        centres = self.store.read("vector_centres", repo=repo).orderBy("bucket").collect()
        books: dict[int, list] = {}
        for r in self.store.read("vector_books", repo=repo).orderBy("part", "code").collect():
            books.setdefault(r["part"], []).append(r["centre"])
        return ann.Index(np.array([r["centre"] for r in centres], float), [np.array(books[p], float) for p in sorted(books)], found["probes"], found["measured"], found["recall"], found["rows"])

    def search_semantic(self, query: str, path: str, limit: int = 10, hybrid: bool = True, q: str | None = None, m: int | None = None, approximate: bool = False) -> DataFrame:
        """The best chunks of a project; ``q`` and ``m`` are other names of query and limit, and ``m`` wins.

        Words are looked up in the stored postings of the project. ``approximate`` looks for vectors in as many of
        the nearest buckets, by their codes, and measures as many of the best exactly as the calibration says, where
        the project has a vector index; else the vector search is exact.
        """
        query, limit = P.require_query(query or q), max(1, int(limit if m is None else m))
        repo = self._register(path)
        chunks = self.store.read("chunks", repo=repo)
        vector = embedding.embed_query(self.embedder, query)
        vectors = chunks.select("id", "vector")
        if approximate and (index := self._vector_index(repo)) is not None:
            vectors = ann.estimated(self.store.read("vector_buckets", repo=repo), index, vector, self.settings.metric).select("id", "vector")
        ready = hybrid and self.store.exists("postings")
        scored = None
        if ready:  # the corpus's counts are the manifest's
            n, tokens, *_ = self.store.projects("doc_lengths").get(repo, [0, 0])
            scored = search.pruned_topk(self.store.read("postings", repo=repo), self.store.read("posting_blocks", repo=repo), n, tokens, query, search.candidates_per_list(limit)).rows
        found = search.hybrid_topk(vectors, vector, query, limit, self.settings.metric, fts_ready=ready, scored=scored)
        found = common_rows(found)  # at most ``limit`` ids; tables are sorted by id, so that few row groups are read for them
        return search.response_rows(found, chunks.where(F.col("id").isin([r["id"] for r in found.collect()]))).orderBy("rank")

    def status(self, path: str = "") -> DataFrame:
        """Chunks, files and latest indexed_at by repository, from the manifest.

        Only of a project with gone rows the times are read, as the latest may be among them.
        """
        wanted = self._register(path) if path else None
        held = {p: x for p, x in self.store.projects("chunks").items() if wanted in (None, p)}
        exact = self.spark.createDataFrame([(p, x[0], x[1], x[3]) for p, x in held.items() if not x[4]], "repo string, chunks long, files long, latest_indexed_at double")
        for project in [p for p, x in held.items() if x[4]]:
            exact = exact.unionByName(store.counts(self.store.read("chunks", repo=project)))
        return exact

    def staleness(self, path: str) -> DataFrame:
        """Reasons to refresh, counted. Only files not seen before with their size and time are opened."""
        repo = self._register(path)
        indexed, zero = self._known(repo)
        last = store.latest_indexed_at(self.store.read("chunks", repo=repo)).first()[0]
        listed = self.listing(path).persist(StorageLevel.DISK_ONLY)
        try:
            return common_rows(diff.staleness(self.current(path, listed), indexed, zero, last))  # three reasons
        finally:
            listed.unpersist()

    def ensure_fresh(self, path: str, background: bool = True) -> str:
        """I9-I11: 'fresh', 'refreshing' or 'busy'. The check has a deadline, after which the index counts as fresh;
        a refresh runs once per project at a time, and searches never wait for it."""
        repo = self._register(path)
        tag = f"tessera-stale-{uuid.uuid4().hex}"
        timer = threading.Timer(self.settings.staleness_deadline_s, lambda: self.spark.interruptTag(tag))
        self.spark.addTag(tag)
        timer.start()
        try:
            if self.staleness(path).isEmpty():
                return "fresh"
        except Exception as e:  # noqa: BLE001 - whatever stops the check, the search goes on with what there is
            self._last_error = str(e)
            return "fresh"
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
        with self._lock:
            if repo in self._refreshing:
                return "busy"
            self._refreshing.add(repo)

        def refresh() -> None:
            try:
                while (row := self.index_semantic(path).first()) is not None and row["remaining"]:
                    pass
            finally:
                with self._lock:
                    self._refreshing.discard(repo)

        worker = threading.Thread(target=refresh, daemon=True)
        worker.start()
        if not background:
            worker.join()
        return "refreshing"

    def cancel(self, job_id: str) -> bool:
        """Ask a running job to stop; its Spark work is interrupted by tag."""
        job = next((j for j in self._jobs if j.job_id == job_id and j.status == "running"), None)
        if job is None:
            return False
        job.status = "cancel_requested"
        self.spark.interruptTag(f"tessera-{job_id}")
        return True

    def warm(self, paths: list[str] | None = None) -> list[str]:
        """Load projects ahead: those named, else the latest indexed; only folders with an index, up to the limit."""
        known = set(self.store.projects("chunks"))
        if paths is None:
            alive = self.spark.createDataFrame([(p,) for p in known if os.path.isdir(p)], "project_path string")
            paths = [r["project_path"] for r in store.recent_projects(self.store.read("project_meta"), alive, MAX_PROJECTS).collect()]
        loaded = []
        for path in dict.fromkeys(os.path.abspath(p.strip()) for p in paths if p.strip()):
            if len(self._projects) >= MAX_PROJECTS:
                break
            if os.path.isdir(path) and self.settings.repo_key(path) in known:
                loaded.append(self._register(path))
        return loaded

    def watch_start(self, path: str, state: str, trigger: dict | None = None):
        """T4: a streaming query of the project's file changes; started once. A file counts once it has been quiet."""
        from tessera.sources.snapshots import SnapshotSource

        repo = self._register(path)
        if repo in self._watchers:
            return self._watchers[repo]
        self.spark.dataSource.register(SnapshotSource)
        source = self.spark.readStream.format("file_changes").option("path", path).option("state", state)
        events = source.option("debounceMs", str(self.settings.debounce_ms)).load()
        rules = corpus.root_rules(self.spark, path)

        def apply(batch: DataFrame, epoch: int) -> None:
            rows = changes.relevant(batch).withColumn("repo", F.lit(repo)).withColumn("ts", F.timestamp_seconds("mtime"))
            # only the files of the batch are judged and opened
            wanted = discovery.named(rows.where("event_type <> 'deleted'").select("file_path", "size").distinct(), path, rules)
            now = corpus.contents(wanted, path).where(~P.is_binary(F.col("content"))).select("file_path", "content")
            texts = rows.join(corpus.with_text(now), "file_path", "left")
            make = lambda files: embedding.embed_chunks(chunking.chunk_files(files, self.settings.chunk_size), self.embedder)
            changes.apply_to_store(self.store, make, self.clock, self._update_text_index, repo)(texts, epoch)

        writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", os.path.join(state, "checkpoint"))
        self._watchers[repo] = writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
        return self._watchers[repo]

    def watch_stop(self, path: str = "") -> int:
        """T5: the number of watchers stopped."""
        stopped = [self.settings.repo_key(path)] if path else list(self._watchers)
        for repo in stopped:
            if (query := self._watchers.pop(repo, None)) is not None:
                query.stop()
        return len(stopped)

    # --- symbol tools ---------------------------------------------------------------------------------------

    def index_symbols(self, path: str, max_files: int | None = None, incremental: bool = True, files: DataFrame | None = None) -> DataFrame:
        """Bring files, symbols and occurrences up to date; files of an older format are parsed anew."""
        repo = self._register(path)
        found = self.files(path) if files is None else files
        now = discovery.supported(found, max_files or self.settings.max_files).cache()
        try:
            base = self.store.version("files")
            mine = self.store.read("files", repo=repo).where((F.col("version") == schemas.INDEX_VERSION) & F.lit(incremental))
            status = diff.detect_changes(now.select("repo", "file_path", "file_hash"), mine.select("repo", "file_path", "file_hash"))
            # the cap leaves out files that are there: what is gone shows in the whole list
            gone = diff.stale_indexed(mine, discovery.supported(found)).withColumn("status", F.lit("deleted"))
            touched = status.where(F.col("status").isin("new", "changed")).select("repo", "file_path", "status").unionByName(gone)
            todo = now.join(touched.where("status <> 'deleted'").select("repo", "file_path"), ["repo", "file_path"], "left_semi")
            rows = extract.extract_files(todo).cache()
            version = schemas.INDEX_VERSION
            self.store.replace("symbols", extract.symbols_of(rows), touched)
            self.store.replace("occurrences", extract.occurrences_of(rows), touched)
            self.store.replace("files", corpus.files_of(todo, version), touched, expected=base)
            self.store.write_index_meta(self.clock(), repo)
            rows.unpersist()
            return self.store.read("index_meta", repo=repo)
        finally:
            now.unpersist()

    def index_symbols_repo(self, repo: str, listing: list[str] | None = None, fetch: Callable[[str], bytes | None] | None = None, max_files: int = 500, ref: str = "HEAD", token: str | None = None) -> DataFrame:
        """Symbols of a remote tree, without occurrences. ``repo`` is owner/name, listed and fetched from its public
        host; a caller that brings ``listing`` and ``fetch`` names any key."""
        if listing is None or fetch is None:
            tree = remote.RemoteTree(repo, ref, token)
            repo, listing, fetch = tree.key, tree.listing(), tree.fetch
        self._remotes[repo] = fetch
        files = discovery.supported(corpus.fetched(self.spark, repo, listing, fetch, max_files), max_files).cache()
        try:
            touched = files.select("repo", "file_path")
            old = self.store.read("files", repo=repo).select("repo", "file_path")
            rows = extract.symbols_of(extract.extract_files(files))
            self.store.replace("symbols", rows, touched.unionByName(old))
            self.store.replace("files", corpus.files_of(files, schemas.UNVERSIONED), touched.unionByName(old))
            self.store.write_index_meta(self.clock(), repo)
            return self.store.read("index_meta", repo=repo)
        finally:
            files.unpersist()

    def list_repos(self) -> DataFrame:
        """T8."""
        return store.list_repos(self.store.read("files"))

    def file_tree(self, path: str, max_files: int = 500) -> DataFrame:
        """Names alone; of the files that the rules leave, the first bytes are looked at for the binary ones."""
        named = self.listing(path)
        return discovery.file_tree(corpus.contents(named, path, head=P.SNIFF_BYTES).where(~P.is_binary(F.col("content"))), max_files)

    def file_outline(self, path: str, file_path: str) -> DataFrame:
        """Outline of one file, the only one that is opened; no index is needed."""
        one = corpus.contents(self.listing(path, [file_path]), path).where(~P.is_binary(F.col("content")))
        return symbols.file_outline(extract.symbols_of(extract.extract_files(one)))

    def repo_outline(self, path: str, max_files: int = 500) -> DataFrame:
        """The outlines of the files with symbols, each with the totals of the project."""
        files = discovery.supported(self.files(path), max_files).cache()
        found = extract.symbols_of(extract.extract_files(files))
        totals = symbols.repo_outline(files, found).select("repo", "total_files", "total_symbols")
        return symbols.file_outline(found).join(totals, "repo").orderBy("file_path")

    def _of(self, name: str, path: str) -> DataFrame:
        return self.store.read(name, repo=self._key(path))

    def _key(self, path: str) -> str:
        """The key of a local project, or a remote one's as it is."""
        return path if path.startswith(remote.PREFIX) else self.settings.repo_key(path)

    def search_symbols(self, query: str, path: str, limit: int = 20, kind: str | None = None) -> DataFrame:
        """T12."""
        return symbols.search_symbols(self._of("symbols", path), query, limit, kind)

    def search_text(self, query: str, path: str, max_results: int = 50, case_sensitive: bool = False) -> DataFrame:
        """T13. Of an indexed project only the files are opened that hold all trigrams of the query, and those unseen so far."""
        P.require_query(query)
        repo = self._register(path)
        posted = grams.candidates(self.store.read("trigrams", repo=repo), query) if repo in self.store.projects("file_stats") else None
        if posted is None:
            return search.line_search(corpus.with_text(self.files(path)), query, max_results, case_sensitive)
        listed, key = self.listing(path), list(store.FILE_KEY)
        wanted = listed.join(posted.unionByName(self._unseen(listed, repo).select(*key)).distinct(), key, "left_semi")
        files = corpus.contents(wanted, path).where(~P.is_binary(F.col("content")))
        return search.line_search(corpus.with_text(files), query, max_results, case_sensitive)

    def search_references(self, query: str, path: str, limit: int = 20, usage_filter: str = "production_first", kind: str | None = None) -> DataFrame:
        """With is_stale by the files' present hashes, which are taken of the returned files alone."""
        hits = symbols.search_references(self._of("occurrences", path), query, limit, usage_filter, kind).cache()
        now = corpus.contents(hits.select("repo", "file_path").distinct(), path)
        flagged = diff.flag_stale(hits, self._of("files", path), now.select("repo", "file_path", "file_hash"))
        return flagged.orderBy("is_test_file", "repo", "file_path", "line_number", "name", "start_byte")

    def get_symbol(self, symbol_id: str, path: str) -> DataFrame:
        """T15."""
        return self.get_symbols([symbol_id], path)

    def get_symbols(self, symbol_ids: list[str], path: str) -> DataFrame:
        """In the order asked for, with the source text; only the files of these symbols are opened, those of a
        remote project fetched (A14)."""
        held, key = self._of("symbols", path), self._key(path)
        wanted = held.where(F.col("id").isin(list(symbol_ids))).select("repo", "file_path").distinct()
        if key.startswith(remote.PREFIX):
            tree = remote.RemoteTree.of_key(key)
            fetch = self._remotes.get(key) or (tree.fetch if tree else lambda path: None)
            names = [r["file_path"] for r in wanted.collect()]  # at most one for each id of the request
            return symbols.get_symbols(held, symbol_ids, corpus.fetched(self.spark, key, names, fetch, len(names)))
        return symbols.get_symbols(held, symbol_ids, corpus.contents(wanted, path))

    # --- maintenance ----------------------------------------------------------------------------------------

    def _require_grant(self) -> None:
        if not self.settings.allow_destructive:
            raise ValueError("destructive tools are not allowed by the settings")

    def invalidate_cache(self, path: str) -> str:
        """T17."""
        self._require_grant()
        return self.store.delete_repo(self.settings.repo_key(path))

    def _exists(self, path: str) -> bool | None:
        """Whether a project's folder is there; None where that cannot be seen."""
        try:
            os.stat(path)
            return os.path.isdir(path)
        except (FileNotFoundError, NotADirectoryError):
            return False
        except OSError:
            return None

    def prune_orphans(self, dry_run: bool = True, inventory: DataFrame | None = None, delete: Callable[[str], None] | None = None) -> DataFrame:
        """Name, reason, bytes, project_path of what the chunk tables hold of nobody's project.

        Without a dry run, and with a grant, the rows of each go, if the project is still gone and not loaded by
        then. A caller may bring another store's ``inventory`` and its own ``delete``.
        """
        active = self.spark.createDataFrame([(k,) for k in self._projects], "path string").select(ids.cache_key(F.col("path")).alias("name"))
        held = self.store.semantic_inventory(self._exists) if inventory is None else inventory
        report = maintenance.orphan_caches(held, active, self.clock(), self.settings.grace_s)
        if inventory is None:
            repos = {r["name"]: r["repo"] for r in held.select("name", "repo").join(report.select("name"), "name", "left_semi").toLocalIterator()}
            delete = lambda name: self._drop_semantic(name, repos.get(name))
        return self._pruned(report, None if dry_run else delete)

    def _drop_semantic(self, name: str, repo: str | None) -> None:
        if repo is not None:
            if repo in self._projects or (self._exists(repo) is not False and self.project_meta(repo).count()):
                return
            for table in ("chunks", "zero_chunk_files", "postings", "posting_blocks", "doc_lengths", "pending_files", "vector_buckets", "vector_centres", "vector_books", "vector_settings", "file_stats", "trigrams"):
                self.store.delete_rows(table, [repo])
        doomed = self.store.read("project_meta").where(F.col("cache_key") == name)
        self.store.replace("project_meta", doomed.limit(0), doomed.select("cache_key"), ("cache_key",))

    def prune_symbols(self, dry_run: bool = True, inventory: DataFrame | None = None, delete: Callable[[str], None] | None = None) -> DataFrame:
        """Name, reason, bytes, repo_path of symbol indexes whose project is gone, and of what belongs to none."""
        active = self.spark.createDataFrame([(k,) for k in self._projects], "repo_path string")
        held = self.store.symbol_inventory(self._exists) if inventory is None else inventory
        report = maintenance.stale_indexes(held, active, self.clock(), self.settings.grace_s)
        if inventory is None:
            repos = {r["name"]: r["repo"] for r in held.select("name", "repo").join(report.select("name"), "name", "left_semi").toLocalIterator()}
            delete = lambda name: self._drop_symbols(repos[name])
        return self._pruned(report, None if dry_run else delete)

    def _drop_symbols(self, repo: str) -> None:
        if repo not in self._projects and self._exists(repo) is False:
            self.store.delete_repo(repo)
            self.store.delete_rows("index_meta", [repo])

    def _pruned(self, report: DataFrame, delete: Callable[[str], None] | None) -> DataFrame:
        """The report; what fails to go is logged and does not stop the rest."""
        if delete is None:
            return report
        self._require_grant()
        report = common_rows(report)
        for row in report.toLocalIterator():
            try:
                delete(row["name"])
            except (OSError, store.Conflict) as e:
                self._last_error = str(e)
                log.warning("%s could not be deleted: %s", row["name"], e)
        return report

    def gc_aliases(self, dry_run: bool = True) -> DataFrame:
        """cache_key and path of aliases whose folder is gone; without a dry run they leave the meta."""
        meta = self.store.read("project_meta")
        paths = [r[0] for r in meta.select(F.explode("alias_paths").alias("p")).distinct().toLocalIterator()]
        alive = self.spark.createDataFrame([(p,) for p in paths if self._exists(p) is not False], "path string")
        kept = maintenance.collect_aliases(meta, alive)
        both = meta.join(kept.withColumnRenamed("alias_paths", "kept"), "cache_key")
        gone = common_rows(both.select("cache_key", F.explode(F.array_except("alias_paths", "kept")).alias("path")))
        if not dry_run:
            self._require_grant()
            touched = gone.select("cache_key").distinct()
            rows = both.join(touched, "cache_key", "left_semi").withColumn("alias_paths", F.col("kept"))
            self.store.replace("project_meta", rows, touched, ("cache_key",))
        return gone

    def gc(self, delete: bool = False) -> DataFrame:
        """Orphans, dead aliases and stale indexes in one report: step, name, reason, bytes, project."""
        nothing = F.lit(0).cast("long").alias("bytes")
        parts = [
            self.prune_orphans(not delete).select(F.lit("orphans").alias("step"), "name", "reason", "bytes", F.col("project_path").alias("project")),
            self.gc_aliases(not delete).select(F.lit("aliases").alias("step"), F.col("cache_key").alias("name"), F.lit("alias_path_enoent").alias("reason"), nothing, F.col("path").alias("project")),
            self.prune_symbols(not delete).select(F.lit("indexes").alias("step"), "name", "reason", "bytes", F.col("repo_path").alias("project")),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def start_sweep(self, delay_s: float = SWEEP_DELAY_S) -> threading.Timer:
        """One look for orphans some time after the start; it deletes only with a grant."""
        if self._sweep is None:
            self._sweep = threading.Timer(delay_s, lambda: self.call("prune_orphans", dry_run=not self.settings.allow_destructive))
            self._sweep.daemon = True
            self._sweep.start()
        return self._sweep

    def invalidate_worktrees(self, paths: list[str]) -> DataFrame:
        """What became of each path: its alias is dropped, and the project's rows if nothing is left of it."""
        self._require_grant()
        asked = self.spark.createDataFrame([(p, os.path.islink(p)) for p in paths], "path string, is_symlink boolean")
        keys = asked.select(ids.cache_key(F.col("path")).alias("cache_key"))
        meta = self.store.read("project_meta").join(keys, "cache_key", "left_semi")
        sizes = self.store.semantic_inventory(self._exists).select(F.col("name").alias("cache_key"), "repo", "bytes", "has_meta").join(keys, "cache_key", "left_semi")
        named = [r[0] for r in meta.select("project_path").where("project_path IS NOT NULL").collect()]  # of the request's paths
        existing = self.spark.createDataFrame([(p,) for p in named if self._exists(p) is not False], "path string")
        report = common_rows(maintenance.invalidate_worktrees(asked, meta, sizes.drop("repo"), existing))
        repos = {r["cache_key"]: r["repo"] for r in sizes.select("cache_key", "repo").collect()}
        for row in report.where("error IS NULL").collect():  # a row per path of the request
            if row["cache_deleted"]:
                self._drop_semantic(row["cache_key"], repos.get(row["cache_key"]))
            elif row["alias_removed"]:
                mine = self.store.read("project_meta").where(F.col("cache_key") == row["cache_key"])
                less = mine.withColumn("alias_paths", F.array_remove("alias_paths", row["path"]))
                self.store.replace("project_meta", less, mine.select("cache_key"), ("cache_key",))
        return report

    def diagnostics(self) -> DataFrame:
        """The latest jobs with their ages."""
        rows = [(j.job_id, j.tool, j.status, j.created_at, j.started_at, j.finished_at, j.error) for j in self._jobs]
        return maintenance.job_snapshot(self.spark.createDataFrame(rows, schemas.JOBS), self.clock())

    def job_histogram(self) -> dict[str, int]:
        return {s: n for s in schemas.JOB_STATUSES if (n := sum(j.status == s for j in self._jobs))}

    def remove_project(self, path: str) -> bool:
        """Forget an alias; the watcher goes with the last one."""
        key = self.settings.repo_key(path)
        aliases = self._projects.get(key)
        if aliases is None:
            return False
        aliases.discard(path)
        if not aliases:
            self.watch_stop(path)
            del self._projects[key]
        return True

    def scaffold_ignore(self, root: str, force: bool = False) -> tuple[str, bool]:
        """Write the template of ignore rules unless there is one."""
        target = os.path.join(root, ".tesseraignore")
        if os.path.exists(target) and not force:
            return target, False
        with open(target, "w", encoding="utf-8") as f:
            f.write(ignore.TEMPLATE)
        return target, True

    # --- calls ----------------------------------------------------------------------------------------------

    def call(self, tool: str, **arguments) -> dict:
        """Run a tool as a job: rows or an error, with the envelope. A job over its time is cancelled by its tag."""
        job = Job(tool)
        with self._lock:
            self._jobs = [*self._jobs, job][-JOB_HISTORY:]
        job.status, job.started_at = "running", self.clock()
        tag = f"tessera-{job.job_id}"
        timer = threading.Timer(self.settings.query_timeout_s, lambda: self.spark.interruptTag(tag))
        self.spark.addTag(tag)
        timer.start()
        try:
            out = getattr(self, tool)(**arguments)
            rows = [r.asDict(recursive=True) for r in out.collect()] if isinstance(out, DataFrame) else out
            job.status = "finished" if job.status == "running" else "cancelled"
            saved = maintenance.savings(len(rows)) if isinstance(rows, list) else 0
            self.ledger.record(saved)
            if saved:
                self.ledger.flush()
            return {"results": rows, "_meta": self._envelope(job, saved)}
        except Exception as e:  # noqa: BLE001 - errors of input, of files and of Spark, time outs too, are values to a caller
            job.status, job.error = "cancelled" if job.status == "cancel_requested" else "failed", str(e) or type(e).__name__
            return {"error": job.error, "_meta": self._envelope(job, 0)}
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
            job.finished_at = self.clock()

    def _envelope(self, job: Job, saved: int) -> dict:
        return {"tool": job.tool, "timing_ms": round((self.clock() - (job.started_at or job.created_at)) * 1000, 1), "tokens_saved": saved, **self.ledger.meta()}
