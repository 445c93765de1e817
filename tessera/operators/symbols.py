"""Symbol search, references with quotas, batch lookups and outlines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import predicates as P

MAX_REFERENCES = 100
SOURCE_BLOCK = 1 << 17  # bytes of a file whose symbols are cut out together
RESERVE = 0.2


def search_symbols(symbols: DataFrame, query: str, k: int = 20, kind: str | None = None) -> DataFrame:
    """Names that hold the query, any case; at least one row is allowed, whatever the limit."""
    P.require_query(query)
    hits = symbols.where(P.name_contains(F.col("name"), query))
    hits = hits if kind is None else hits.where(F.col("kind") == kind)
    return hits.orderBy("repo", "file_path", "start_byte", "id").limit(max(k, 1))


def _matching(occurrences: DataFrame, query: str, kind: str | None) -> DataFrame:
    P.require_query(query)
    P.require_choice(kind, schemas.OCCURRENCE_KINDS, "kind")
    hits = occurrences.where(P.name_equals(F.col("name"), query))
    return hits if kind is None else hits.where(F.col("kind") == kind)


def search_references(occurrences: DataFrame, query: str, k: int = 20, usage: str = "production_first", kind: str | None = None) -> DataFrame:
    """Occurrences of a name under a usage filter, production rows before test rows.

    A row needs its place within its class and the two class totals. Places come from a ranking that Spark cuts
    at the limit per class and task (window group limit), so no class is ever held as a whole, and the
    occurrences are read once.
    """
    P.require_choice(usage, schemas.USAGE_FILTERS, "usage filter")
    k = P.clamp(k, 1, MAX_REFERENCES)
    hits = _matching(occurrences, query, kind)
    order = [F.col(c) for c in ("repo", "file_path", "line_number", "name", "start_byte")]
    # each class keeps k rows at most, so its size tells min(total, k), which is all that the quota asks
    placed = hits.withColumn("rn", F.row_number().over(Window.partitionBy("is_test_file").orderBy(*order))).where(F.col("rn") <= k)
    both = Window.partitionBy()
    counts = placed.withColumn("t", F.count_if(F.col("is_test_file")).over(both)).withColumn("p", F.count_if(~F.col("is_test_file")).over(both))
    limit, t, p = F.lit(k), F.col("t"), F.col("p")
    zero = F.lit(0).cast("long")
    if usage == "tests_only":
        keep = F.col("is_test_file")
    elif usage == "production_first":
        keep = ~F.col("is_test_file") | (F.col("rn") <= limit - p)
    else:
        reserve = F.when(t == 0, zero).otherwise(F.least(t, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(RESERVE) * limit))))
        first = F.least(p, F.greatest(limit - reserve, zero))
        of_tests = F.least(t, reserve + F.greatest(limit - first - reserve, zero))
        spare = F.greatest(limit - first - of_tests, zero)
        keep = F.when(F.col("is_test_file"), F.col("rn") <= of_tests).otherwise(F.col("rn") <= first + spare)
    return counts.where(keep).drop("rn", "t", "p").orderBy("is_test_file", *order)


def reference_counts(occurrences: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Production and test matches before any limit."""
    return _matching(occurrences, query, kind).agg(
        F.count_if(~F.col("is_test_file")).alias("production_matches"), F.count_if(F.col("is_test_file")).alias("test_matches")
    )


def occurrences_by_name(occurrences: DataFrame) -> DataFrame:
    """Size of each name's bucket. Counted by file first: one narrow exchange, and a hot name is spread over its files."""
    by_file = occurrences.groupBy("repo", "name", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy("repo", "name").agg(F.sum("n").alias("n"), F.count("file_path").alias("files"))


def with_source(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the text of their bytes; null where the file is gone, the path escapes, or nothing is left.

    Symbols of neighbouring places are cut out of a file together: a file's bytes are looked at once for each
    ``SOURCE_BLOCK`` of it that has symbols, not once a symbol.
    """
    columns = [c for c in symbols.columns if c != "source"]
    near = symbols.groupBy("repo", "file_path", F.floor(F.col("start_byte") / SOURCE_BLOCK).alias("_block"))
    joined = near.agg(F.collect_list(F.struct(*columns)).alias("_symbols")).join(files.select("repo", "file_path", "content"), ["repo", "file_path"], "left")
    safe = ~F.array_contains(F.split("file_path", "/"), "..")

    def cut(body: Column, s: Column) -> Column:
        piece = F.make_valid_utf8(F.substring(body, s["start_byte"] + 1, F.greatest(s["end_byte"] - s["start_byte"], F.lit(0))).cast("string"))
        return F.struct(*[s[c].alias(c) for c in columns], F.when(safe & (piece != ""), piece).alias("source"))

    # the bytes are bound as a lambda variable, so that they are made once a row
    bodies = F.transform(F.array(F.col("content").cast("binary")), lambda body: F.transform("_symbols", lambda s: cut(body, s)))
    return joined.select(F.explode(F.flatten(bodies)).alias("s")).select("s.*")


def may_hold(file_path: Column, wanted: list[str]) -> Column:
    """Whether a file can have a symbol of one of the ids: an extracted id begins with its file's path and a colon."""
    return file_path.isin(sorted({i[:k] for i in wanted for k, c in enumerate(i) if c == ":"}))


def get_symbols(symbols: DataFrame, wanted: list[str], files: DataFrame | None = None) -> DataFrame:
    """The symbols of the ids in the order asked for, with ``found`` false where there is none."""
    spark = symbols.sparkSession
    asked = spark.createDataFrame(list(enumerate(wanted)), "pos int, id string")  # the request's own ids
    hits = symbols.where(F.col("id").isin(wanted)) if wanted else symbols.where(F.lit(False))
    hits = with_source(hits, files) if files is not None else hits
    return F.broadcast(asked).join(hits, "id", "left").withColumn("found", F.col("name").isNotNull()).orderBy("pos")


def enclosing_symbols(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Occurrence id and the innermost symbol whose bytes hold it, for occurrences that lie in one.

    The spans and places of a file pass one walk in order of place; spans of symbols nest, so it holds the open ones alone.
    """
    spans = symbols.select("repo", "file_path", F.col("start_byte").alias("at"), F.lit(True).alias("span"), F.col("end_byte").alias("end"), "id")
    places = occurrences.select("repo", "file_path", F.col("start_byte").alias("at"), F.lit(False).alias("span"), F.lit(None).cast("int").alias("end"), "id")
    rows = spans.unionByName(places).where("at IS NOT NULL AND (end IS NOT NULL OR NOT span)")
    dealt = rows.repartition("repo", "file_path").sortWithinPartitions("repo", "file_path", "at", F.desc("span"), F.desc("end"), "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            found = []
            for repo, path, at, span, end, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (repo, path) != file:
                    file, open_ = (repo, path), []
                while open_ and open_[-1][0] <= at:
                    open_.pop()
                if span:
                    open_.append((end, name))
                elif open_:
                    found.append((repo, name, open_[-1][1]))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["repo", "id", "enclosing_symbol_id"])

    return dealt.mapInArrow(walk, "repo string, id string, enclosing_symbol_id string")


ENTRY = ("start_byte", "id", "name", "kind", "end_byte", "docstring", "decorators", "parent")


def file_outline(symbols: DataFrame) -> DataFrame:
    """Repo, file_path, symbol_count and the symbols in order of place, as one row a file."""
    return symbols.groupBy("repo", "file_path").agg(
        F.count(F.lit(1)).alias("symbol_count"), F.array_sort(F.collect_list(F.struct(*ENTRY))).alias("symbols")
    )


def outline_rows(symbols: DataFrame) -> DataFrame:
    """E6 as a row a symbol, with ``symbol_count`` and ``pos``, its place in its file's outline from 0; no file's symbols are held at once."""
    file = Window.partitionBy("repo", "file_path")
    placed = symbols.withColumn("pos", F.row_number().over(file.orderBy(*ENTRY)) - 1)
    return placed.withColumn("symbol_count", F.count(F.lit(1)).over(file))


def repo_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per repository the files processed, those with symbols, and all symbols."""
    per_file = symbols.groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("n"))
    joined = files.select("repo", "file_path").join(per_file, ["repo", "file_path"], "left")
    return joined.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("n") > 0).alias("files_with_symbols"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_symbols"),
    )
