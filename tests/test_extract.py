import gc
import sys
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, extract
from tessera.operators.extract import go_source, python_source

PYTHON = '''import os as system
class Box:
    """Holds é."""
    @property
    def size(self):
        return system.path.getsize(self.name)
    def size(self, other):
        def inner():
            return other
        return inner()
async def run(box):
    global COUNT
    COUNT = box.size
'''
GO = """package box

import "fmt"
import enc "encoding/json"
import _ "embed"

type Shape interface{ Area(scale int) float }
type Pair[K any] struct{ Left, Right K }
type (
	Disk struct{ R float64; enc.Marshaler }
	Code = int
)

func (d *Disk) Area(scale int) float { return fmt.Sprint(d.R) }
func (p *Pair[K]) Swap() {}
func make() interface{} { return helper(enc.Valid) }
"""


def test_python_symbols_and_uses():
    source = PYTHON.encode()
    found = extract.extract_source("box.py", source)
    assert [s.id for s in found.symbols] == [
        "box.py:class:Box", "box.py:method:Box.size", f"box.py:method:Box.size@{found.symbols[2].start}", "box.py:function:inner", "box.py:function:run",
    ]
    assert found.symbols[0].docstring == "Holds é." and found.symbols[1].decorators == ["@property"]
    assert source[found.symbols[3].start : found.symbols[3].end].decode().startswith("def inner():")
    kinds = {(o.name, o.kind) for o in found.occurrences}
    assert {("os", "import"), ("path", "attribute"), ("inner", "call"), ("other", "reference"), ("COUNT", "reference")} <= kinds
    assert all(source[o.start : o.end].decode() == o.name for o in found.occurrences)
    assert next(o for o in found.occurrences if o.kind == "call").enclosing == found.symbols[2].id
    assert not any(o.name in ("Box", "run") for o in found.occurrences)
    assert extract.extract_source("box.py", source, compat=True).symbols[1].kind == "function"


def test_go_symbols_and_uses():
    source = GO.encode()
    found = extract.extract_source("box.go", source)
    kinds = {s.name: s.kind for s in found.symbols}
    assert kinds["Shape"] == "interface" and kinds["Pair"] == "class" and kinds["Disk"] == "class" and kinds["Code"] == "alias"
    assert "box.go:method:Disk.Area" in {s.id for s in found.symbols} and "box.go:method:Pair.Swap" in {s.id for s in found.symbols}
    names = {(o.name, o.kind) for o in found.occurrences}
    assert {("fmt", "import"), ("enc", "import"), ("Sprint", "attribute"), ("helper", "call"), ("Marshaler", "attribute"), ("float64", "reference")} <= names
    assert not {"_", "box", "Left", "Right", "embed", "Shape", "Disk"} & {o.name for o in found.occurrences if o.enclosing is None}
    assert next(o for o in found.occurrences if o.name == "Sprint").enclosing == "box.go:method:Disk.Area"


def test_scripts():
    source = b"interface A { x: number }\nexport async function load(u: A): Promise<A> { return u }\nclass B extends C { static make(n) { if (n) { } } get v() { return 1 } }\n"
    typed = [(s.kind, s.name, s.parent) for s in extract.extract_source("m.ts", source).symbols]
    assert typed == [("interface", "A", None), ("function", "load", None), ("class", "B", None), ("method", "make", "B"), ("method", "v", "B")]
    assert ("interface", "A", None) not in [(s.kind, s.name, s.parent) for s in extract.extract_source("m.js", source).symbols]


def test_broken_and_unknown_sources_yield_nothing():
    for path, source in (("a.py", b"def (:"), ("a.py", b"\xff\xfe"), ("a.zig", b"fn x() {}"), ("a", b"x"), ("a.go", b"func ("), ("a.ts", b"class {{{"), ("a.py", None), ("a.go", b"type (")):
        found = extract.extract_source(path, source)
        assert not found.symbols or path.endswith(".go")


def test_extraction_is_one_pass_over_files(spark):
    rows = [("r", "pkg/box.py", bytearray(PYTHON.encode())), ("r", "tests/test_box.go", bytearray(GO.encode())), ("r", "x.txt", bytearray(b"x")), ("r", "n.py", None)]
    files = spark.createDataFrame(rows, "repo string, file_path string, content binary")
    found = extract.extract_files(files).cache()
    assert extract.symbols_of(found).count() == 12
    uses = extract.occurrences_of(found)
    assert {r["is_test_file"] for r in uses.where(F.col("file_path").startswith("tests/")).collect()} == {True}
    assert uses.where("line_text = ''").count() == 0
    found.unpersist()


def test_table_functions(spark):
    extract.register_udtfs(spark)
    got = spark.sql("SELECT name FROM extract_symbols('a.py', 'def f(): pass')").collect()
    assert [r["name"] for r in got] == ["f"]
    assert spark.sql("SELECT * FROM chunk_text('a.md', 'one two\nthree', 3)").count() == 2


# --- the other languages of the registry: (name, kind, parent, first and last characters of the span)

OTHERS = {
    "a.rs": (
        'use std::fmt;\n/// doc\n#[derive(Debug)]\npub struct Point<T> { x: T }\nstruct Unit;\nenum Shape { A(i32), B { fn_: u8 } }\n'
        "impl<'a> Point<i32> {\n    pub(crate) fn norm(&self) -> f64 { let s = r#\"fn no() {}\"#; 1.0 }\n}\n"
        "impl fmt::Display for Unit {\n    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { let c = '{'; Ok(()) }\n}\n"
        "trait Draw { fn draw(&self); fn twice(&self) { self.draw() } }\nmod inner { pub async fn helper<T: Clone>(t: T) -> T where T: Copy { fn deep() {} t } }\n// fn no() {}\nfn main() { println!(\"fn x() {}\"); }\n",
        [("Point", "class", None), ("Unit", "class", None), ("Shape", "class", None), ("Point", "class", None), ("norm", "method", None), ("Display", "class", None), ("fmt", "method", None), ("Draw", "interface", None), ("twice", "method", None), ("helper", "function", None), ("deep", "function", None), ("main", "function", None)],
    ),
    "A.java": (
        'package a.b;\nimport java.util.List;\n@Deprecated\npublic class Box<T extends Comparable<T>> implements Runnable {\n    private int n = size(3);\n    static { setup(); }\n    public Box(int n) { this.n = n; }\n'
        '    @Override\n    public List<T> get(int i) throws IOException { if (i > 0) { call(i); } return null; }\n    public abstract void none();\n    class Inner { void in() {} }\n    String s = "class X { void y() {} }";\n}\n'
        "interface Shape { double area(); }\nenum Color { RED(1), BLUE(2); int code() { return 1; } }\nrecord Pair(int a, int b) { int sum() { return a + b; } }\n",
        [("Box", "class", None), ("Box", "function", None), ("get", "method", "Box"), ("none", "method", "Box"), ("Inner", "class", None), ("in", "method", "Inner"), ("Shape", "interface", None), ("area", "function", None), ("Color", "class", None), ("code", "function", None), ("Pair", "class", None), ("sum", "method", None)],
    ),
    "a.c": (
        "#include <stdio.h>\n#define MAX(a, b) \\\n  ((a) > (b))\nstruct point { int x; };\nunion u { int a; };\nenum e { A, B };\nstatic int add(int a, int b)\n{\n    if (a) { return b; }\n    return a + b;\n}\n"
        "int declared(int);\nstruct point *make(void) { return 0; }\nunsigned long *names[] = { 0 };\nint main(int argc, char **argv) { printf(\"int f() {\"); return add(1, 2); }\n",
        [("point", "class", None), ("u", "class", None), ("e", "class", None), ("add", "function", None), ("make", "function", None), ("main", "function", None)],
    ),
    "a.cpp": (
        "#include <vector>\nnamespace geo {\nclass Shape : public Base {\npublic:\n    Shape(int n) : n_(n), v_{1} { }\n    virtual ~Shape() {}\n    virtual double area() const = 0;\n    int twice() const override { return n_ * 2; }\nprivate:\n    int n_;\n};\n"
        "template <typename T>\nT largest(const std::vector<T>& v) { return v[0]; }\nstruct Point { int x; };\n}\nint geo::Shape::other(int a) { return a; }\nauto f(int x) -> int { auto g = [x](int y) { return x + y; }; return g(1); }\nconst char* s = R\"(int no() {})\";\n",
        [("Shape", "class", None), ("Shape", "function", None), ("Shape", "function", None), ("twice", "function", None), ("largest", "function", None), ("Point", "class", None), ("other", "function", None), ("f", "function", None)],
    ),
    "A.cs": (
        'using System;\nnamespace App.Core {\n    [Serializable]\n    public class Service : IService {\n        public int Count { get; set; }\n        public Service(int n) : base(n) { }\n        public async Task<int> Run(string a) { await Go(); return 1; }\n        public int Twice(int x) => x * 2;\n        string q = @"class ""X"" { }";\n    }\n'
        "    public interface IService { Task<int> Run(string a); }\n    public struct P { public int X() { return 1; } }\n    public record Pair(int A, int B);\n}\n",
        [("Service", "class", None), ("Service", "function", None), ("Run", "method", "Service"), ("Twice", "method", "Service"), ("IService", "interface", None), ("Run", "method", None), ("P", "class", None), ("X", "method", None), ("Pair", "class", None)],
    ),
    "a.rb": (
        "require 'x'\nmodule Geo\n  class Shape < Base\n    attr_reader :n\n    def initialize(n)\n      @n = n if n\n      [1, 2].each do |x|\n        puts \"def no #{x} end\"\n      end\n    end\n    def self.make(a) = new(a)\n    def big?\n      while true do\n        break unless @n\n      end\n      if @n > 3 then true else false end\n    end\n    private def hidden; 1; end\n    class << self\n      def meta; end\n    end\n  end\nend\n=begin\ndef comment\nend\n=end\ndef top(class: nil)\n  x = <<~EOS\n    def no\n  EOS\n  x.class\nend\n",
        [("Geo", "interface", None), ("Shape", "class", None), ("initialize", "function", None), ("make", "function", None), ("big?", "function", None), ("hidden", "function", None), ("meta", "function", None), ("top", "function", None)],
    ),
    "a.php": (
        "<html><?php\nnamespace App;\n// function no() {}\n# function no2() {}\ninterface Shape { public function area(): float; }\nabstract class Base implements Shape {\n    public static function make(int $a = 1): static { return new static(); }\n    abstract protected function todo();\n    public function run() { $f = function ($x) { return $x; }; return 'function z() {}'; }\n}\n"
        "trait T { function t() {} }\nfunction helper(array &$a) { return match(true) { default => 1 }; }\n?><b>function html() {}</b>\n<?php function last() {}\n",
        [("Shape", "interface", None), ("area", "method", None), ("Base", "class", None), ("make", "method", "Base"), ("todo", "method", "Base"), ("run", "method", "Base"), ("t", "method", None), ("helper", "function", None), ("last", "function", None)],
    ),
    "a.swift": (
        'import UIKit\nprotocol Shape {\n    func area() -> Double\n}\npublic final class Box<T>: Base, Shape where T: Equatable {\n    let n: Int\n    init(n: Int) { self.n = n }\n    override func area() -> Double { return 1.0 }\n    static func make<U>(_ u: U) -> Box where U: Shape {\n        func deep() {}\n        return Box(n: 1)\n    }\n}\n'
        'struct Point { var x: Int { get { return 1 } }\n    mutating func move() { print("func no() {}") } }\nextension Point { func far() -> Bool { true } }\nenum E { case a, b }\nfunc top(a: Int) throws -> Int { return a }\n',
        [("Shape", "interface", None), ("Box", "class", None), ("area", "method", "Box"), ("make", "method", "Box"), ("deep", "function", None), ("Point", "class", None), ("move", "method", "Point"), ("Point", "class", None), ("far", "method", "Point"), ("E", "class", None), ("top", "function", None)],
    ),
    "a.kt": (
        'package a.b\nimport x.y\n\ninterface Shape { fun area(): Double }\ndata class Point(val x: Int, val y: Int)\nopen class Box<T>(val n: Int) : Base(n), Shape {\n    override fun area(): Double = 1.0 *\n        2\n    suspend fun <R> run(f: (T) -> R): R {\n        fun deep() {}\n        return f(null)\n    }\n    companion object { fun make() = Box<Int>(1) }\n}\n'
        'object Single { fun one() {} }\nfun String.twice(): String {\n    return "fun no() {}" + """ fun x() {} """\n}\nfun main() = println("x")\nval z = 1\n',
        [("Shape", "class", None), ("area", "method", "Shape"), ("Point", "class", None), ("Box", "class", None), ("area", "method", "Box"), ("run", "method", "Box"), ("deep", "function", None), ("object", "class", None), ("make", "method", None), ("Single", "class", None), ("one", "method", None), ("twice", "function", None), ("main", "function", None)],
    ),
}


@pytest.mark.parametrize("path", sorted(OTHERS))
def test_symbols_of_other_languages(path):
    source, expected = OTHERS[path]
    found = extract.extract_source(path, source.encode()).symbols
    assert [(s.name, s.kind, s.parent) for s in found] == expected
    assert len({s.id for s in found}) == len(found) and not extract.extract_source(path, source.encode()).occurrences
    for s in found:
        span = source.encode()[s.start : s.end].decode()
        assert s.name in span and span == span.strip()
        assert span[-1] in "});" or span.endswith(("end", "2", "(a)", "(1)", '("x")', "Double"))


@pytest.mark.parametrize("path", sorted(OTHERS))
def test_broken_sources_of_other_languages_raise_nothing(path):
    source = OTHERS[path][0].encode()
    for k in range(0, len(source), 7):
        extract.extract_source(path, source[:k])
        extract.extract_source(path, source[k:])
    assert extract.extract_source(path, b"\xff\xfe{}(") is not None
    many = extract.extract_source(path, source * 300).symbols  # in linear time
    assert len(many) >= 290 * len(OTHERS[path][1])


# --- long sources are read in pieces

CLAUSES = "if A:\n    a = 1\n# or\nelse:\n    b = '''\ndef no(): pass\n'''\n@wrap(\n1,\n)\ndef f(x):\n    return g(x)\nc = 1 + \\\n2\n"


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _joined(pieces) -> tuple[list, list]:
    held = list(pieces)
    assert len(held) > 3
    return [s for p in held for s in p.found.symbols], sorted((o for p in held for o in p.found.occurrences), key=lambda o: o.start)


@pytest.mark.parametrize("source", [(PYTHON + CLAUSES) * 9, CLAUSES * 30])
def test_pieces_of_python_equal_the_whole(source):
    whole = python_source.extract(source.encode())
    for size in (1, 40, 300):
        assert _joined(python_source.pieces(source.encode(), size=size)) == (whole.symbols, whole.occurrences)
        lines = {o.line: p.lines[o.line - 1 - p.first] for p in python_source.pieces(source.encode(), size=size) for o in p.found.occurrences}
        assert all(source.split("\n")[k - 1] == line for k, line in lines.items())
    assert not list(python_source.pieces((source + "def (").encode(), size=40))  # what does not parse yields nothing


def test_pieces_of_go_equal_the_whole():
    source = GO.encode() * 9 + b'import late "x/y"\nfunc f() { late.Do() }\n'
    whole = go_source.extract(source)
    assert _joined(go_source.pieces(source, size=20)) == (whole.symbols, sorted(whole.occurrences, key=lambda o: o.start))
    assert [o.kind for o in whole.occurrences if o.name == "late"] == ["import", "import"]
    ids = [s.id for s in extract.extract_source("b.go", source).symbols]
    assert len(set(ids)) == len(ids)


def test_files_in_parts_equal_whole_files(spark):
    """Parts in any order, cut within lines, without content or path; a file of none; one whose last part does not parse."""
    sources = {"pkg/box.py": PYTHON * 3, "tests/test_box.go": GO, "x.txt": "x", "bad.py": PYTHON + "def ("}
    rows = [("r", p, k, s[k : k + 7].encode()) for p, text in sources.items() for s in [text.encode().decode("latin-1")] for k in range(0, len(s), 7)]
    rows = [(r, p, k, c.decode("utf-8").encode("latin-1")) for r, p, k, c in rows] + [("r", "pkg/box.py", 8, None), ("r", "n.py", 0, None), (None, "m.py", 0, b"def f(): pass\n"), ("r", None, 0, b"x = 1")]
    parts = spark.createDataFrame([(r, p, k, bytearray(c) if c is not None else None) for r, p, k, c in reversed(rows)], "repo string, file_path string, at int, content binary")
    whole = [("r", p, bytearray(s.encode())) for p, s in sources.items()] + [(None, "m.py", bytearray(b"def f(): pass\n")), ("r", "n.py", None)]
    expected = extract.extract_files(spark.createDataFrame(whole, "repo string, file_path string, content binary"))
    found = extract.extract_parts(parts, ("at",), F.col("content"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "collect_list" not in plan  # no file is a group
    assert expected.count() > 100 and sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    for tag in ("symbol", "occurrence"):
        alone = extract.extract_parts(parts, ("at",), F.col("content"), tags=(tag,))
        assert sorted(map(str, alone.collect())) == sorted(map(str, expected.where(F.col("tag") == tag).collect()))


def test_long_files_do_not_share_a_task(spark):
    """Their parts are few bytes, which Spark would put together into one task; that sorts and parses them all."""
    rows = [("r", f"m{f}.py", k) for f in range(4) for k in range(300)]
    parts = spark.createDataFrame(rows, "repo string, file_path string, at int")
    body = F.concat(F.lit("def part_"), F.col("at").cast("string"), F.lit("(): pass\n"))
    found = extract.extract_parts(parts, ("at",), body, tags=("symbol",), columns=("file_path", "name"))
    tasks = found.groupBy("file_path", F.spark_partition_id().alias("task")).count().collect()
    assert sorted((r["file_path"], r["count"]) for r in tasks) == [(f"m{f}.py", 300) for f in range(4)]  # each file is whole in a task
    assert len({r["task"] for r in tasks}) == 4


def test_queries_of_symbols_put_no_file_together(spark):
    from tessera.plans import symbol_queries

    for query in (symbol_queries.symbol_search, symbol_queries.symbol_search_kind, symbol_queries.symbol_search_zero, symbol_queries.symbol_dedup_ids, symbol_queries.repo_outline):
        assert "collect_list" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_files_that_cannot_hold_an_id_are_left_out(spark):
    from tessera.operators import symbols

    paths = spark.createDataFrame([("a.py",), ("a:b.py",), ("a",), ("a.pyx",), ("b.py",), (None,)], "file_path string")
    kept = lambda ids: sorted(r[0] for r in paths.where(symbols.may_hold(F.col("file_path"), ids)).collect())
    assert kept(["a:b.py:function:f", "b.py"]) == ["a", "a:b.py"] and kept(["a.py:method:C.f@12"]) == ["a.py"] and kept([]) == []


@pytest.mark.parametrize(("path", "definition"), [("m.py", "def part_{}(x):\n    return helper(x)\n"), ("m.go", "func part_{}(x int) int {{ return helper(x) }}\n")])
def test_a_long_source_is_not_held_as_a_tree_or_tokens(path, definition):
    def peak(n: int) -> int:
        source = "".join(definition.format(k) for k in range(n)).encode()
        return _peak(lambda: sum(len(p.found.symbols) for p in extract.extract_pieces(path, source)))

    assert peak(12000) < 2 * peak(3000)


def test_chunks_of_a_long_source_need_no_whole_tree():
    def source(n: int) -> str:
        return "".join(f"def part_{k}(x):\n    return helper(x)\n" for k in range(n))

    assert _peak(lambda: chunking._python_starts(source(12000))) < 2 * _peak(lambda: chunking._python_starts(source(3000)))
    assert chunking._python_starts(source(9000)) == list(range(1, 18000, 2)) and not chunking._python_starts(source(9000) + "def (")


@pytest.mark.parametrize("end", ["", "def (", "x = 1\ry = 2\n", "from __future__ import barry_as_FLUFL\n", "x = 1\r"])
def test_python_in_parts_equals_the_whole(monkeypatch, end):
    """Read a few bytes at a time, cut within characters and line breaks; ids that come again in later pieces get their place."""
    source = (PYTHON + CLAUSES).replace("\n", "\r\n").encode() * 9 + b"# \xff\xc3\n" + end.encode()
    rows = lambda s: sorted(map(str, extract._rows("r", "m.py", s, False, ("symbol", "occurrence"))))
    whole = rows(source)
    assert (len(whole) > 100) == (end != "def (")
    for read, size in ((1, 1), (7, 40), (1 << 16, 300)):
        monkeypatch.setattr(python_source, "READ", read)
        monkeypatch.setattr(python_source.pieces, "__defaults__", (False, size, True))
        assert rows(source[k : k + 3] for k in range(0, len(source), 3)) == rows(source) == whole


def test_neither_text_nor_ids_of_a_long_source_are_held():
    n = 12000
    source = "".join(f"def part_{k}(x):\n    return helper(x)\n" for k in range(n)).encode()
    tracemalloc.start()
    try:
        found = extract.extract_pieces("pkg/a_folder/a_long_path_of_a_file.py", source, uses=False)
        next(found)
        tracemalloc.reset_peak()  # behind the parse
        assert sum(len(p.found.symbols) for p in found) > 0.5 * n
        assert tracemalloc.get_traced_memory()[1] < 10 * len(source)
    finally:
        tracemalloc.stop()


def test_no_name_outlives_its_source():
    """The interpreter keeps the names that its parser has seen, so a worker would grow with all sources it gets."""

    def run(k: int) -> int:
        source = "".join(f"def part_{k}_{i}(a_{k}_{i}):\n    return a_{k}_{i}.b_{k}_{i}(c_{k}_{i}=1)\n" for i in range(500)).encode()
        return sum(len(p.found.symbols) for p in extract.extract_pieces("m.py", source)) + len(chunking._python_starts(source.decode()))

    run(0)
    gc.collect()
    before = sys.getallocatedblocks()
    assert all(run(k) == 1000 for k in range(1, 11))
    gc.collect()
    assert sys.getallocatedblocks() - before < 2000  # of 20,000 names


@pytest.mark.parametrize("columns", [("repo", "file_path"), ("repo", "name", "file_path", "start_byte"), ("id", "repo", "name", "file_path", "start_byte"), ("id", "enclosing_symbol_id")])
def test_only_columns_asked_for_are_made(spark, columns):
    parts = spark.createDataFrame([("r", "m.py", k, bytearray(PYTHON[k : k + 9].encode("utf-8"))) for k in range(0, len(PYTHON), 9)], "repo string, file_path string, at int, content binary")
    found = extract.extract_parts(parts, ("at",), F.col("content"), columns=columns)
    whole = extract.extract_parts(parts, ("at",), F.col("content")).select(*columns)
    assert found.columns == list(columns) and sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) != []


def test_queries_of_symbols_make_no_other_column(spark, monkeypatch):
    from tessera.plans import symbol_queries

    made, plain = [], extract.extract_parts
    monkeypatch.setattr(extract, "extract_parts", lambda *a, **b: made.append(plain(*a, **b)) or made[-1])
    for query, n in ((symbol_queries.symbol_search_kind, 6), (symbol_queries.symbol_search_zero, 5), (symbol_queries.symbol_dedup_ids, 4), (symbol_queries.repo_outline, 2)):
        query(spark, "/root/testdata/sf0.001")
        assert len(made.pop().columns) == n and not made
