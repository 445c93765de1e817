"""Symbol and occurrence extraction (H5-H9): one parse a file, as one distributed pass over files.

Rows leave a task in batches, and long sources of Python and Go are parsed in pieces, so that a task holds neither a
source's tree nor its tokens nor its rows. Of a source of Python it holds the text and the pieces compressed, and the ids
that come twice; of one of Go the source and its ids.

Python goes through the standard library's parser, all other languages of the registry through small lexers:
Go, JavaScript and TypeScript, the brace languages (one lexer with a table for each), and Ruby.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import languages
from tessera.operators import predicates
from tessera.operators.extract import brace_source, go_source, python_source, ruby_source, script_source
from tessera.operators.extract.rows import Extracted, Piece, identify

ROW = (
    "tag string, id string, repo string, name string, kind string, file_path string, start_byte int, end_byte int, "
    "docstring string, decorators array<string>, parent string, line_number int, line_text string, enclosing_symbol_id string"
)


BATCH_ROWS = 8192
KINDS = (pa.string(),) * 6 + (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.string())


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return languages.SYMBOL_LANGUAGES.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name[1:] else None


def extract_source(path: str, source: bytes | None, compat: bool = False) -> Extracted:
    """Symbols and occurrences of one source; nothing for an unsupported or unreadable one."""
    out = Extracted()
    for piece in extract_pieces(path, source, compat):
        out.symbols += piece.found.symbols
        out.occurrences += piece.found.occurrences
    return out


def extract_pieces(path: str, source: bytes | Iterable[bytes] | None, compat: bool = False, uses: bool = True, ids: bool = True) -> Iterator[Piece]:
    """The same by pieces of the source, in their order; without ``uses`` a source of Python gives its symbols alone.

    Without ``ids`` none is given, and occurrences are not linked.

    A source may come in parts; only one of Python is read by them.
    """
    language = language_of(path)
    if source is None or language is None:
        return
    if language != "python" and not isinstance(source, (bytes, bytearray)):
        source = b"".join(source)
    if language == "python":
        pieces = python_source.pieces(source, compat, uses=uses)
    elif language == "go":
        pieces = go_source.pieces(source)
    elif language in ("javascript", "typescript", "tsx"):
        pieces = iter([Piece(script_source.extract(source, typed=language != "javascript"), 0, [])])
    elif language == "ruby":
        pieces = iter([Piece(ruby_source.extract(source), 0, [])])
    else:
        pieces = iter([Piece(brace_source.extract(source, language), 0, [])])
    seen: set[str] = set()
    for piece in pieces:
        if ids:
            identify(piece.found, path, seen, piece.again)
        yield piece


def _rows(repo: str | None, path: str, source: bytes | Iterable[bytes] | None, compat: bool, tags: tuple[str, ...], ids: bool = True) -> Iterator[tuple]:
    for piece in extract_pieces(path, source, compat, "occurrence" in tags, ids):
        if "symbol" in tags:
            for s in piece.found.symbols:
                yield "symbol", s.id, repo, s.name, s.kind, path, s.start, s.end, s.docstring, s.decorators, s.parent, None, None, None
        if "occurrence" in tags:
            for o in piece.found.occurrences:
                k = o.line - 1 - piece.first
                line = piece.lines[k].rstrip("\r") if k < len(piece.lines) else ""
                yield "occurrence", f"{path}:occurrence:{o.name}:{o.start}", repo, o.name, o.kind, path, o.start, o.end, None, None, None, o.line, line, o.enclosing


NAMES = tuple(f.split()[0] for f in ROW.split(", "))


def _batches(found: Iterator[tuple], columns: tuple[str, ...] = NAMES) -> Iterator[pa.RecordBatch]:
    places = [NAMES.index(c) for c in columns]
    while rows := list(islice(found, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], KINDS[k]) for k in places], names=list(columns))


def extract_files(files: DataFrame, compat: bool = False, tags: tuple[str, ...] = ("symbol", "occurrence")) -> DataFrame:
    """``files`` (repo, file_path, content binary) to tagged rows of symbols and occurrences, or of one; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(
            row
            for batch in batches
            for repo, path, source in zip(*batch.columns, strict=True)  # one source at a time leaves the batch
            if path.as_py()
            for row in _rows(repo.as_py(), path.as_py(), source.as_py(), compat, tags)
        )

    chosen = files.where(languages.has_symbols(F.col("file_path")))
    return chosen.select("repo", "file_path", F.col("content").cast("binary")).mapInArrow(run, ROW)


def extract_parts(parts: DataFrame, order: tuple[str, ...], content: Column, compat: bool = False, tags: tuple[str, ...] = ("symbol", "occurrence"), columns: tuple[str, ...] = NAMES) -> DataFrame:
    """The same of files that are stored in parts: ``parts`` has repo, file_path and what ``order`` and ``content`` take.

    The parts of a file, in ``order``, pass its task in a sort that can spill, and ``content`` is made behind it. So a file
    is never a group nor a row of the JVM, whatever its length and however many files a task gets, and a file of Python is
    parsed as its parts come; parts without content are left out, and a file that has no other is none. No column but ``columns`` is made.

    Files are dealt by ranges over the session's number of shuffle partitions: tasks have about as many parts each, or one
    long file, and none has long files together because their parts are few bytes; ranges without a file are no tasks. The
    driver reads a sample for the ranges, of repo and path alone, which Spark keeps at some hundreds of parts a task.
    """
    ids = bool({"id", "enclosing_symbol_id"} & {*columns})
    row_type = ", ".join(f for f in ROW.split(", ") if f.split()[0] in columns)
    columns = tuple(c for c in NAMES if c in columns)

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (repo, path), own in groupby(rows, key=lambda row: row[:2]):
            if path:
                yield repo, path, (part for _, _, part in own if part is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for repo, path, source in sources(batches) for row in _rows(repo, path, source, compat, tags, ids)), columns)

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = parts.where(languages.has_symbols(F.col("file_path"))).repartitionByRange(tasks, "repo", "file_path").sortWithinPartitions("repo", "file_path", *order)
    return chosen.select("repo", "file_path", content.cast("binary")).mapInArrow(run, row_type)


def symbols_of(extracted: DataFrame) -> DataFrame:
    columns = ["id", "repo", "name", "kind", "file_path", "start_byte", "end_byte", "docstring", "decorators", "parent"]
    return extracted.where(F.col("tag") == "symbol").select(*columns)


def occurrences_of(extracted: DataFrame, compat: bool = True) -> DataFrame:
    columns = ["id", "repo", "name", "file_path", "start_byte", "end_byte", "line_number", "line_text", "kind", "enclosing_symbol_id"]
    rows = extracted.where(F.col("tag") == "occurrence").select(*columns)
    return rows.withColumn("is_test_file", predicates.is_test_file(F.col("file_path"), compat))


def register_udtfs(spark: SparkSession) -> None:
    """SQL table functions ``extract_symbols(path, content)`` and ``chunk_text(path, content, size)``."""
    from pyspark.sql.functions import udtf

    from tessera.operators import chunking

    @udtf(returnType="id string, name string, kind string, start_byte int, end_byte int, parent string")
    class ExtractSymbols:
        def eval(self, path: str, content: str):
            for s in extract_source(path, content.encode("utf-8") if content is not None else None).symbols:
                yield s.id, s.name, s.kind, s.start, s.end, s.parent

    @udtf(returnType="chunk_index int, start_line int, end_line int, content string, token_count int")
    class ChunkText:
        def eval(self, path: str, content: str, size: int):
            yield from chunking.chunk_text(content, path, size)

    spark.udtf.register("extract_symbols", ExtractSymbols)
    spark.udtf.register("chunk_text", ChunkText)


__all__ = ["extract_files", "extract_source", "occurrences_of", "register_udtfs", "symbols_of"]
