"""Trigrams of files, for literal search without opening every file.

A file is posted under every three characters in a row of its lower-cased text. A file that holds a query holds all
of the query's trigrams, so their intersection leaves the few files to be opened, whose lines are then matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

N = 3
KEY = ["repo", "file_path"]


def trigrams(files: DataFrame, column: str = "content") -> DataFrame:
    """repo, file_path, gram: each trigram of a file once, line breaks left out. ``files``: repo, file_path and text.

    Cut by a pattern inside the JVM, line by line: no trigram of a match lies across lines.
    """
    lines = files.select(*KEY, F.explode(F.array_distinct(text.lines(F.lower(F.col(column))))).alias("line"))
    # three passes over a line, one for each offset
    cuts = F.flatten(F.array(*[F.regexp_extract_all(F.substring("line", i + 1, 2**31 - 1), F.lit("(?s)(.{3})"), F.lit(1)) for i in range(N)]))
    return lines.select(*KEY, F.explode(F.array_distinct(cuts)).alias("gram")).distinct()


def of_query(query: str) -> list[str]:
    """The query's trigrams of ASCII characters, which are lower-cased alike wherever they stand."""
    low = query.lower()
    grams = {low[i : i + N] for i in range(len(low) - N + 1)}
    return sorted(g for g in grams if g.isascii() and "\n" not in g and "\r" not in g)


def candidates(postings: DataFrame, query: str) -> DataFrame | None:
    """repo, file_path of the posted files that hold all of the query's trigrams; None where it has none to ask for."""
    grams = of_query(query)
    if not grams:
        return None
    met = postings.where(F.col("gram").isin(grams)).groupBy(*KEY).agg(F.countDistinct("gram").alias("n"))
    return met.where(F.col("n") == len(grams)).select(*KEY)
