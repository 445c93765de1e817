"""Extraction of symbols in every language but Python, over files rendered from ``part``: one file a brand.

A rendered file is a head, a definition for each part in order of its key, and a tail; expected places are a
running sum of lengths in the oracle.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import extract
from tessera.session import table


class Rendering(NamedTuple):
    suffix: str
    head: str
    definition: str  # {k}: the part's key, {z}: its size
    tail: str
    before: str  # what of the definition lies before the symbol; behind it there is a line break
    kind: str
    parent: str | None = None


RENDERINGS = {
    "rust": Rendering("rs", "use std::fmt;\nimpl Shelf {\n", "    pub fn part_{k}(x: i32) -> i32 {{ helper_{z}(x) }}\n", "}\n", "    ", "method"),
    "java": Rendering("java", "package p;\npublic class Shelf {\n", "    public int part_{k}(int x) {{ return helper_{z}(x); }}\n", "}\n", "    ", "method", "Shelf"),
    "c": Rendering("c", "#include <stdio.h>\n", "static int part_{k}(int x) {{ return helper_{z}(x); }}\n", "", "", "function"),
    "cpp": Rendering("cpp", "namespace shelf {\n", "int part_{k}(const int& x) {{ return helper_{z}(x); }}\n", "}\n", "", "function"),
    "c_sharp": Rendering("cs", "namespace P {\npublic class Shelf {\n", "    public int part_{k}(int x) => helper_{z}(x);\n", "}\n}\n", "    ", "method", "Shelf"),
    "ruby": Rendering("rb", "module Shelf\n", "  def part_{k}(x)\n    helper_{z}(x) if x\n  end\n", "end\n", "  ", "function"),
    "php": Rendering("php", "<?php\nclass Shelf {\n", "    public function part_{k}($x) {{ return helper_{z}($x); }}\n", "}\n", "    ", "method", "Shelf"),
    "swift": Rendering("swift", "import P\nstruct Shelf {\n", "    func part_{k}(x: Int) -> Int {{ return helper_{z}(x) }}\n", "}\n", "    ", "method", "Shelf"),
    "kotlin": Rendering("kt", "package p\nclass Shelf {\n", "    fun part_{k}(x: Int): Int = helper_{z}(x)\n", "}\n", "    ", "method", "Shelf"),
    "go": Rendering("go", "package p\n", "func part_{k}(x int) int {{ return helper_{z}(x) }}\n", "", "", "function"),
    "javascript": Rendering("js", "'use strict';\n", "function part_{k}(x) {{ return helper_{z}(x); }}\n", "", "", "function"),
    "typescript": Rendering("ts", "export class Shelf {\n", "  part_{k}(x: number): number {{ return helper_{z}(x); }}\n", "}\n", "  ", "method", "Shelf"),
}


def _pieces(r: Rendering) -> list[str]:
    """The definition as text before the key, between key and size, and behind the size."""
    first, rest = r.definition.replace("{{", "{").replace("}}", "}").split("{k}")
    return [first, *rest.split("{z}")]


def rendered(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    r = RENDERINGS[language]
    a, b, c = _pieces(r)
    body = F.concat(F.lit(a), F.col("p_partkey").cast("string"), F.lit(b), F.col("p_size").cast("string"), F.lit(c))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(f".{r.suffix}")).alias("file_path"), "p_partkey", body.alias("body"))
    grouped = parts.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "body"))).alias("p"))
    return grouped.select(F.lit("parts").alias("repo"), "file_path", F.concat(F.lit(r.head), F.array_join(F.col("p.body"), ""), F.lit(r.tail)).alias("content"))


def symbols_in(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """The rendered definitions; the class around them is checked by its name in the tests."""
    found = extract.symbols_of(extract.extract_files(rendered(spark, sf_dir, language), tags=("symbol",)))
    return found.where(F.col("name").startswith("part_")).select("id", "name", "kind", "file_path", "start_byte", "end_byte", "parent")


def _text(s: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n"))


def _oracle(language: str) -> str:
    r = RENDERINGS[language]
    a, b, c = map(_text, _pieces(r))
    owner = f"'{r.parent}.'" if r.parent else "''"
    return f"""WITH bodies AS (
  SELECT 'pkg/' || replace(p_brand, '#', '_') || '.{r.suffix}' AS file_path, p_partkey AS k, {a} || p_partkey::VARCHAR || {b} || p_size::VARCHAR || {c} AS body FROM part),
placed AS (SELECT *, {len(r.head)} + (coalesce(sum(length(body)) OVER (PARTITION BY file_path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM bodies)
SELECT file_path || ':{r.kind}:' || {owner} || 'part_' || k::VARCHAR AS id, 'part_' || k::VARCHAR AS name, '{r.kind}' AS kind, file_path,
  (off + {len(r.before)})::INTEGER AS start_byte, (off + length(body) - 1)::INTEGER AS end_byte, {f"'{r.parent}'" if r.parent else "NULL::VARCHAR"} AS parent FROM placed"""


QUERIES = {f"extract_{name}_symbols": partial(symbols_in, language=name) for name in RENDERINGS}
ORACLES = {f"extract_{name}_symbols": _oracle(name) for name in RENDERINGS}
