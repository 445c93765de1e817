"""Chunking: greedy line packing and spans of definitions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import extract
from tessera.operators.extract import python_source

CHUNK_SIZE = 500
MIN_TOKENS = 10
#: What stands right above a definition and belongs to it.
ABOVE = (b"//", b"/*", b"*", b"#", b"@", b"[")
BATCH_ROWS = 4096
BATCH_TEXTS = 128
BATCH_TOKENS = 100_000


def pack_lines(content: str, size: int = CHUNK_SIZE) -> list[tuple[int, int, int, str, int]]:
    """(chunk_index, start_line, end_line, text, tokens) by greedy packing: a line costs its words and one.

    A chunk closes when the next line would exceed ``size``; a line above it is a chunk of its own. Blank
    chunks are not returned, but their lines count.
    """
    out: list[tuple[int, int, int, str, int]] = []
    held: list[str] = []
    cost, first = 0, 1

    def close(last: int) -> None:
        body = "\n".join(held)
        if body.strip():
            out.append((len(out), first, last, body, cost))

    lines = content.split("\n")
    for number, line in enumerate(lines, 1):
        more = len(line.split()) + 1
        if held and cost + more > size:
            close(number - 1)
            held, cost, first = [], 0, number
        held.append(line)
        cost += more
    close(len(lines))
    return out


def _python_starts(content: str) -> list[int]:
    """Lines where top-level statements of Python begin, with their decorators; none if it does not parse."""
    out: list[int] = []
    line = 0
    try:
        for piece, tree, _ in python_source.parsed(content):
            out += [line + min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) for n in tree.body]
            line += piece.count("\n")
    except python_source.FAILURES:
        return []
    return out


def _symbol_starts(content: str, path: str) -> list[int]:
    """Lines where the outermost symbols of a source begin, with the comments and attributes right above them."""
    data = content.encode("utf-8", "replace")
    breaks = [k for k, byte in enumerate(data) if byte == 10]
    lines, out, covered = data.split(b"\n"), [], 0  # covered: the last line of the symbol before
    for s in extract.extract_source(path, data).symbols:
        first = bisect_left(breaks, s.start) + 1
        if first > covered:
            while first - 1 > covered and lines[first - 2].strip().startswith(ABOVE):
                first -= 1
            out.append(first)
            covered = bisect_left(breaks, s.end - 1) + 1
    return out


def _cut_at(lines: list[str], starts: list[int], size: int) -> list[tuple[int, int, int, str, int]]:
    """Chunks between the lines of ``starts``: neighbours joined up to ``size``, a part above it packed by lines."""
    ends = [s - 1 for s in starts[1:]] + [len(lines)]
    groups: list[list[int]] = []
    for a, b in zip(starts, ends, strict=True):
        cost = sum(len(x.split()) + 1 for x in lines[a - 1 : b])
        if groups and groups[-1][2] + cost <= size:
            groups[-1][1:] = [b, groups[-1][2] + cost]
        else:
            groups.append([a, b, cost])
    out = []
    for a, b, cost in groups:
        pieces = [(a, b, "\n".join(lines[a - 1 : b]), cost)]
        if cost > size:
            pieces = [(a - 1 + first, a - 1 + last, body, n) for _, first, last, body, n in pack_lines(pieces[0][2], size)]
        for first, last, body, n in pieces:
            if body.strip() and n >= MIN_TOKENS:
                out.append((len(out), first, last, body.strip("\n"), n))
    return out


def chunk_text(content: str | None, path: str | None, size: int = CHUNK_SIZE, by_syntax: bool = True) -> list[tuple]:
    """Chunks along the definitions of a source that can be parsed, by greedy packing of any other text."""
    if content is None or not content.strip():
        return []
    language = extract.language_of(path) if by_syntax and path else None
    starts = [] if language is None else _python_starts(content) if language == "python" else _symbol_starts(content, path)
    if not starts:
        return pack_lines(content, size)
    return _cut_at(content.splitlines() if language == "python" else content.split("\n"), [1, *starts[1:]], size)


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE, by_syntax: bool = True) -> DataFrame:
    """``files`` (repo, file_path, content string, file_hash) to chunk rows. One pass, no exchange."""
    schema = (
        "repo string, file_path string, file_hash string, chunk_index int, start_line int, end_line int, "
        "content string, token_count int"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        names = [f.split()[0] for f in schema.split(", ")]
        found = (
            (repo.as_py(), path.as_py(), digest.as_py(), *chunk)
            for batch in batches
            for repo, path, digest, content in zip(*batch.columns, strict=True)  # one source at a time leaves the batch
            for chunk in chunk_text(content.as_py(), path.as_py(), size, by_syntax)
        )
        while rows := list(islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = files.select("repo", "file_path", "file_hash", "content").mapInArrow(run, schema)
    return found.withColumn("id", ids.chunk_id(F.concat_ws("/", "repo", "file_path"), F.col("chunk_index")))


def line_of(content: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character at ``offset`` (from 0): the breaks before it, plus one."""
    return F.size(F.split(F.substring(content, F.lit(1), offset.cast("int")), "\n"))


def window_rollup(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """Files, chunks and tokens of each indexing window; ``windows`` has repo, file_path and window."""
    joined = windows.join(chunks.select("repo", "file_path", "token_count"), ["repo", "file_path"], "left")
    return joined.groupBy("repo", "window").agg(
        F.countDistinct("file_path").alias("files"), F.count("token_count").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")
    )


def embedding_batches(chunks: DataFrame, max_texts: int = BATCH_TEXTS, max_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``chunks`` with ``batch``, the request in which a file's chunk is embedded.

    A batch closes when it is full or the next text would exceed the token budget; one text above the budget
    is a batch of its own. Batches are kept inside a file, so files stay independent; the running sum with a
    reset is one walk over the file's own chunks, as numbers without their texts.
    """
    listed = chunks.groupBy("repo", "file_path").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", text.token_estimate(F.col("content")).cast("int").alias("tokens")))).alias("items")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in batches:
            numbers = []
            for items in group.column(2).to_pylist():
                n = total = batch = 0
                mine = []
                for x in items:
                    if n and (n >= max_texts or total + x["tokens"] > max_tokens):
                        batch, n, total = batch + 1, 0, 0
                    n, total = n + 1, total + x["tokens"]
                    mine.append(batch)
                numbers.append(mine)
            yield pa.RecordBatch.from_arrays([*group.columns, pa.array(numbers, pa.list_(pa.int32()))], names=["repo", "file_path", "items", "batches"])

    placed = listed.mapInArrow(run, "repo string, file_path string, items array<struct<chunk_index:int,tokens:int>>, batches array<int>")
    each = placed.select("repo", "file_path", F.explode(F.arrays_zip("items", "batches")).alias("x"))
    return each.select("repo", "file_path", "x.items.chunk_index", "x.items.tokens", F.col("x.batches").alias("batch"))
