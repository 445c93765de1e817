import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import paths, text, vectors
from tessera.operators import ann, chunking, diff, discovery, embedding, ignore, maintenance, merge, search, symbols
from tessera.operators import predicates as P
from tessera.sources import store as tables


def one(spark, column, **values):
    names = list(values)
    kinds = {int: "long", str: "string", float: "double", bool: "boolean", bytes: "binary", bytearray: "binary"}
    ddl = ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first()["x"]


def test_lines_break_where_unicode_says(spark):
    for s in ("a\nb", "a\r\nb\n", "a\x0bb\x0cc\x1cd\x85e f g", "", "\n", "a\n\n"):
        assert list(one(spark, text.lines(F.col("s")), s=s)) == s.splitlines(), repr(s)


def test_decode_replaces_bad_bytes(spark):
    assert one(spark, text.decode(F.col("b")), b=b"a\xffb") == "a�b"


def test_versions_compare_as_numbers(spark):
    assert one(spark, text.version_key(F.col("v")) > text.version_key(F.lit("2.3")), v="2.10")
    assert list(one(spark, text.version_key(F.col("v")), v="x.1")) == [0]


@pytest.mark.parametrize(("path", "suffix"), [("a/b.py", ".py"), ("a/.env", ""), ("a/b", ""), ("a.d/b.tar.gz", ".gz")])
def test_suffix(spark, path, suffix):
    assert one(spark, paths.suffix(F.col("p")), p=path) == suffix


@pytest.mark.parametrize(
    ("path", "inside"), [("a/b", True), ("../x", False), ("a/../b", True), ("a/../../x", False), ("/r/a", True), ("/ra", False), ("./a", True)]
)
def test_paths_stay_under_the_root(spark, path, inside):
    assert one(spark, paths.inside(F.col("p"), "/r"), p=path) is inside


@pytest.mark.parametrize(
    ("path", "secret"), [(".env", True), ("x/.env.example", True), ("k.pem", True), ("credentials.txt", True), ("Key.PEM", False), ("env.py", False)]
)
def test_secret_names(spark, path, secret):
    assert one(spark, P.is_secret(F.col("p")), p=path) is secret


def test_skipped_dirs_binary_size(spark):
    assert one(spark, P.in_skipped_dir(F.col("p")), p="a/node_modules/b.js")
    assert one(spark, P.in_skipped_dir(F.col("p")), p="x.egg-info/b.py")
    assert not one(spark, P.in_skipped_dir(F.col("p"), glob_egg_info=False), p="x.egg-info/b.py")
    assert not one(spark, P.in_skipped_dir(F.col("p")), p="a/dist")
    assert one(spark, P.is_binary(F.col("b")), b=b"a\0b") and not one(spark, P.is_binary(F.col("b")), b=b"ab")
    assert not one(spark, P.is_binary(F.col("b")), b=b"a" * 8192 + b"\0")
    assert one(spark, P.is_oversized(F.col("n")), n=1024 * 1024 + 1) and not one(spark, P.is_oversized(F.col("n")), n=1024 * 1024)


@pytest.mark.parametrize(
    ("rules", "path", "gone"),
    [("*.log", "a/b.log", True), ("/a.log", "b/a.log", False), ("docs/", "docs/x", True), ("docs/", "docs", False),
     ("a/**/z", "a/b/c/z", True), ("*.log\n!keep.log", "keep.log", False), ("# c\n\n", "c", False), ("x?.py", "xy.py", True),
     ("[ab].py", "b.py", True), ("build", "x/build/y", True), ("**/tmp", "q/tmp/z", True)],
)
def test_ignore_rules(spark, rules, path, gone):
    assert one(spark, ignore.ignored(F.col("p"), ignore.parse_rules(rules)), p=path) is gone


def test_discovery_leaves_content_for_last(spark):
    rows = [("r", "a.py", 3, b"abc"), ("r", "b.py", 3, b"a\0c"), ("r", ".env", 1, b"x"), ("r", "dist/c.py", 1, b"x")]
    files = spark.createDataFrame(rows, "repo string, file_path string, size long, content binary")
    assert [r["file_path"] for r in discovery.discover(files, "/r").collect()] == ["a.py"]


def naive_pack(content, size):
    out, held, cost, start = [], [], 0, 1
    rows = content.split("\n")
    for i, line in enumerate(rows):
        n = len(line.split()) + 1
        if held and cost + n > size:
            if "".join(held).strip():
                out.append((len(out), start, i, "\n".join(held), cost))
            held, cost, start = [], 0, i + 1
        held, cost = [*held, line], cost + n
    if "".join(held).strip():
        out.append((len(out), start, len(rows), "\n".join(held), cost))
    return out


def test_greedy_packing_and_edges():
    for body in ("a b c\n" * 50, "\n\n\n", "x " * 300, "a\n\n\nb", "one"):
        for size in (1, 5, 50):
            assert chunking.pack_lines(body, size) == naive_pack(body, size)
    assert chunking.chunk_text("  \n", "a.md") == [] and chunking.chunk_text(None, "a.md") == []


def test_python_chunks_follow_statements_and_fall_back():
    body = "import os\n" + "\n".join(f"def f{i}(a, b):\n    return a + b * {i}\n" for i in range(20))
    chunks = chunking.chunk_text(body, "m.py", 40)
    assert len(chunks) > 1 and [c[0] for c in chunks] == list(range(len(chunks)))
    assert all(c[3].startswith(("def", "import")) for c in chunks)
    assert chunking.chunk_text("def broken(:\n" * 3, "m.py", 4) == chunking.pack_lines("def broken(:\n" * 3, 4)


def test_chunks_follow_definitions_of_every_language():
    body = "package p\n\n" + "".join(f"// doc of f{i}\nfunc f{i}(a int) int {{\n\treturn a + {i}\n}}\n\n" for i in range(12))
    chunks = chunking.chunk_text(body, "m.go", 40)
    assert len(chunks) > 2 and all(c[3].startswith(("package", "// doc of")) and c[3].endswith("}") for c in chunks)
    assert "\n".join(body.split("\n")[chunks[1][1] - 1 : chunks[1][2]]).strip("\n") == chunks[1][3]
    ruby = "class A\n" + "".join(f"  def m{i}(x)\n    x + {i} + 1 + 2 + 3\n  end\n" for i in range(30)) + "end\n"
    assert max(c[4] for c in chunking.chunk_text(ruby, "a.rb", 60)) <= 60  # a class above the size is cut
    for path in ("a.rs", "a.java", "a.kt", "a.unknown"):
        assert chunking.chunk_text("plain words only\n" * 30, path, 20) == chunking.pack_lines("plain words only\n" * 30, 20)


def test_vectors_agree_and_tolerate(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    for metric in vectors.METRICS:
        fast = [(r["id"], r["score"]) for r in search.vector_topk(df, [1.0, 0.0], 3, metric).collect()]
        slow = [(r["id"], r["score"]) for r in search.vector_topk(df, [1.0, 0.0], 3, metric, builtin=True).collect()]
        assert fast[:2] == slow[:2] and fast[0][0] == 1
    with pytest.raises(ValueError):
        vectors.distance(F.col("vector"), [1.0], "dot")


def test_text_search_ranks_and_unindexed_hybrid_says_vector(spark):
    rows = [(1, "red fox", [1.0, 0.0]), (2, "red red dog", [0.0, 1.0]), (3, "blue", [0.7, 0.7])]
    df = spark.createDataFrame(rows, "id long, content string, vector array<float>")
    assert [r["id"] for r in search.fts_topk(df, "RED", 5).collect()] == [2, 1]
    assert search.fts_topk(df, "???", 5).count() == 0
    same = {r["id"]: r["score"] for r in search.fts_index(search.postings(df), search.document_lengths(df), "red").collect()}
    assert same == {r["id"]: r["score"] for r in search.fts_scan(df, "red").collect()}
    assert {r["match_type"] for r in search.hybrid_topk(df, [1.0, 0.0], "red", 3, fts_ready=False).collect()} == {"vector"}
    assert search.hybrid_topk(df, [1.0, 0.0], "red", 3).first()["id"] == 1


def test_line_search_is_literal(spark):
    df = spark.createDataFrame([("r", "a", "50% off  \nx_y\nXaY"), ("r", "b", None)], "repo string, file_path string, content string")
    assert [r["line"] for r in search.line_search(df, "% OFF").collect()] == ["50% off"]
    assert search.line_search(df, "x_y", case_sensitive=True).count() == 1 and search.line_search(df, "x", 0).count() == 0


def quota(k, p, t):
    """The reserve as a plain procedure."""
    reserve = min(t, max(1, int(0.2 * k))) if t else 0
    production = min(p, max(k - reserve, 0))
    tests = min(t, reserve + max(k - production - reserve, 0))
    return production + min(p - production, max(k - production - tests, 0)), tests


@pytest.mark.parametrize(("k", "p", "t"), [(20, 30, 30), (20, 5, 4), (20, 2, 30), (1, 5, 5), (10, 30, 0), (10, 0, 30), (100, 125, 5)])
def test_reference_quota(spark, k, p, t):
    rows = [(f"i{i}", "r", "Name" if i % 2 else "name", f"f{i:03}", i, i, "call", i >= p) for i in range(p + t)]
    ddl = "id string, repo string, name string, file_path string, line_number int, start_byte int, kind string, is_test_file boolean"
    df = spark.createDataFrame(rows, ddl)
    got = symbols.search_references(df, " name ", k, "include_tests").collect()
    assert (sum(not r["is_test_file"] for r in got), sum(r["is_test_file"] for r in got)) == quota(k, p, t)
    first = symbols.search_references(df, "NAME", k, "production_first").collect()
    assert len(first) == min(k, p + t) and sum(not r["is_test_file"] for r in first) == min(k, p)
    assert len(symbols.search_references(df, "name", k, "tests_only").collect()) == min(k, t)


def test_bad_input_is_refused(spark):
    df = spark.createDataFrame([], schemas.OCCURRENCES)
    for arguments in ({"query": " "}, {"query": "x", "usage": "all"}, {"query": "x", "kind": "definition"}):
        with pytest.raises(ValueError):
            symbols.search_references(df, **arguments)


def test_changes_and_merges(spark):
    ddl = "repo string, file_path string, file_hash string"
    now = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "n", "9")], ddl)
    then = spark.createDataFrame([("r", "a", "1"), ("r", "b", "x"), ("r", "g", "3")], ddl)
    got = {r["file_path"]: r["status"] for r in diff.detect_changes(now, then).collect()}
    assert got == {"a": "same", "b": "changed", "n": "new", "g": "deleted"}
    zero = spark.createDataFrame([("r", "n", "9")], ddl)
    assert [r["file_path"] for r in diff.pending_files(now, then, zero).collect()] == ["b"]
    edited = spark.createDataFrame([("r", "n", "old")], ddl)
    assert {r["file_path"] for r in diff.pending_files(now, then, edited).collect()} == {"b", "n"}
    three = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, file_path string")
    assert merge.upsert(three, spark.createDataFrame([("3", "z"), ("4", "z")], "id string, file_path string")).count() == 4
    assert merge.delete_files(three, ["a", "it's"]).count() == 1 and merge.delete_files(three, []).count() == 3


def test_store_versions_and_conflicts(spark, tmp_path):
    held = tables.Store(spark, str(tmp_path))
    assert not held.exists("files") and held.read("files").count() == 0
    row = spark.createDataFrame([("r", "a", "1", "2.3")], schemas.FILES)
    assert held.append("files", row.limit(0)) == 0 and held.append("files", row) == 1
    held.append("files", spark.createDataFrame([("r", "b", "1", "2.3"), ("q", "c", "1", "2.3")], schemas.FILES))
    assert held.read("files").count() == 3 and held.delete_files("files", "r", ["a", "c", "none"]) == 1  # c is another project's
    with pytest.raises(tables.Conflict):
        held.write("files", row, expected=1)
    for repo in ("r", "q"):
        held.write_index_meta(5.0, repo)
    assert {(r["repo"], r["files"]) for r in held.read("index_meta").collect()} == {("r", 1), ("q", 1)}
    assert held.delete_repo("r") == "deleted" and held.delete_repo("r") == "not_found"
    held.append("files", spark.createDataFrame([("q", f"f{i}", "1", "2.3") for i in range(50)], schemas.FILES))
    before = set(held.read("files").inputFiles())
    held.upsert("files", spark.createDataFrame([("q", "f7", "2", "2.3")], schemas.FILES), "file_path")
    after = {f for f in held.read("files").inputFiles()}
    assert before <= after and held.read("files").count() == 51  # what was there is not written anew
    assert held.read("files").where("file_path = 'f7'").first()["file_hash"] == "2"
    held.clear("files")
    assert held.read("files").count() == 0
    assert tables.latest_indexed_at(held.read("chunks")).first()[0] == 0.0


def test_a_project_is_read_from_its_own_folders_and_gets_more_as_it_grows(spark, tmp_path):
    held = tables.Store(spark, str(tmp_path))
    for repo in ("p", "q"):
        held.append("files", spark.createDataFrame([(repo, f"f{i}", "1", "2.3") for i in range(30)], schemas.FILES))
    own = {f.rsplit("/", 2)[1] for f in held.read("files", repo="p").inputFiles()}
    other = {f.rsplit("/", 2)[1] for f in held.read("files", repo="q").inputFiles()}
    assert own and other and not own & other and {r["repo"] for r in held.read("files", repo="p").collect()} == {"p"}
    tables.Store(spark, str(tmp_path), bucket_bytes=500).replace("files", spark.createDataFrame([("p", "f3", "2", "2.3")], schemas.FILES), spark.createDataFrame([("p", "f3")], "repo string, file_path string"))
    wider = {f.rsplit("/", 2)[1] for f in held.read("files", repo="p").inputFiles()}
    assert len(wider) > 4 >= len(own) and held.read("files", repo="p").count() == 30 and held.read("files").count() == 60
    assert {f.rsplit("/", 2)[1] for f in held.read("files", repo="q").inputFiles()} == other
    held.delete_rows("files", ["p"])
    assert held.read("files", repo="p").count() == 0 and held.read("files").count() == 30


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    row = spark.createDataFrame([("r", "a", "1", "2.3")], schemas.FILES)
    held = tables.Store(spark, str(tmp_path))
    held.append("files", row)
    manifest = held.manifest("files")
    held._add("files", manifest, held._stage("files", row, manifest))  # and dies before it publishes
    assert held.append("files", row) == 2 and held.read("files").count() == 2
    assert held.vacuum("files", 3_600.0) == 0 and held.vacuum("files", 0.0) == 1 and held.read("files").count() == 2
    assert held.append("files", row) == 3 and held.read_json("none") is None
    held.write_json("note", {"a": 1})
    assert held.read_json("note") == {"a": 1}


def test_two_writers_of_one_version(spark, tmp_path):
    """Both have staged; one publishes, the other is told, and no row of the first is lost."""
    held = tables.Store(spark, str(tmp_path))
    rows = [spark.createDataFrame([("r", p, "1", "2.3")], schemas.FILES) for p in "abc"]
    held.append("files", rows[0])
    racing = [held.manifest("files"), held.manifest("files")]
    for manifest, row in zip(racing, rows[1:], strict=True):
        held._add("files", manifest, held._stage("files", row, manifest))
    found = []

    def publish(manifest):
        try:
            found.append(held._commit("files", manifest))
        except tables.Conflict:
            found.append(None)

    threads = [threading.Thread(target=publish, args=(m,)) for m in racing]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found, key=str) == [2, None]
    assert held.read("files").count() == 2 and held.version("files") == 2


def written(tmp_path):
    return sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))


def test_bytes_written_follow_the_rows_of_each_write(spark, tmp_path):
    """Twenty windows of new files: without merging, each adds about what the first did; with it, a few times as much in all."""
    held = tables.Store(spark, str(tmp_path / "apart"), fanout=1_000)
    key = lambda rows: rows.select("repo", "file_path")
    sizes = []
    for w in range(20):
        rows = spark.createDataFrame([("r", f"w{w:02d}/f{i}", "h" * 40, "2.3") for i in range(40)], schemas.FILES)
        held.replace("files", rows, key(rows), known=key(rows).limit(0))
        sizes.append(written(tmp_path / "apart"))
    grown = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
    assert max(grown) < 1.5 * sizes[0] and held.read("files").count() == 800
    assert held.projects("files") == {"r": [800, 800, held.projects("files")["r"][2], 0.0, False]}


def test_merged_on_read_equals_replaced(spark, tmp_path):
    """Random writes against plain sets: reads, counts of the manifest and bounded numbers of folders, over merges."""
    rng, held, plain = random.Random(5), tables.Store(spark, str(tmp_path), width=2, fanout=2), {}
    for step in range(14):
        touched = {(rng.choice("pq"), f"f{rng.randrange(12)}") for _ in range(rng.randrange(1, 7))}
        rows = [(r, f, f"{step}.{k}", "2.3") for r, f in touched if rng.random() < 0.7 for k in range(rng.randrange(1, 3))]
        keys = spark.createDataFrame(sorted(touched), "repo string, file_path string")
        if step == 9:
            held.delete_rows("files", ["q"])
            plain = {k: v for k, v in plain.items() if k[0] != "q"}
        held.replace("files", spark.createDataFrame(rows, schemas.FILES), keys)
        for r, f in touched:
            plain[r, f] = sorted(h for a, b, h, _ in rows if (a, b) == (r, f))
        got = {}
        for r in held.read("files").collect():
            got.setdefault((r["repo"], r["file_path"]), []).append(r["file_hash"])
        expected = {k: v for k, v in plain.items() if v}
        assert {k: sorted(v) for k, v in got.items()} == expected
        counts = {p: [sum(len(v) for (r, _), v in expected.items() if r == p), sum(r == p for r, _ in expected)] for p in "pq"}
        assert {p: x[:2] for p, x in held.projects("files").items()} == {p: c for p, c in counts.items() if c[0]}
        mine = held.read("files", repo="p").collect()
        assert len(mine) == counts["p"][0] and {r["repo"] for r in mine} <= {"p"}
    manifest = held.manifest("files")
    for slot in manifest.slots():
        assert all(len(parts) <= 4 for parts in manifest.slot(slot)["parts"].values())
    held.vacuum("files", 0.0)
    assert held.read("files").count() == sum(len(v) for v in plain.values())


def test_counts_of_projects_read_no_data(spark, tmp_path):
    held = tables.Store(spark, str(tmp_path))
    held.append("chunks", spark.createDataFrame([("i", "p", "f", 0, 1, 2, "text", 1, None, "h", 5.0)], schemas.CHUNKS))
    for f in tmp_path.rglob("*.parquet"):
        f.unlink()
    assert held.projects("chunks")["p"][:2] == [1, 1]
    row = held.semantic_inventory(lambda p: None).collect()[0]
    assert (row["repo"], row["mtime"], row["has_chunks"], row["bytes"] > 0) == ("p", 5.0, True, True)


class Flaky:
    dimension = 1

    def __init__(self):
        self.calls = []

    def embed(self, texts):
        self.calls.append(len(texts))
        if len(self.calls) == 1:
            raise ConnectionError
        if len(texts) > 2:
            raise embedding.TooManyTokens
        return [[float(len(t))] for t in texts]


def test_embedding_splits_and_retries(spark):
    model, waits = Flaky(), []
    assert embedding.call(model, ["a", "bb", "ccc"], sleep=waits.append) == [[1.0], [2.0], [3.0]]
    assert len(waits) == 1 and model.calls == [3, 3, 1, 2]
    assert [len(x) for x in embedding.requests(["x" * 40] * 5, 2, 1000)] == [2, 2, 1]
    assert [len(x) for x in embedding.requests(["x" * 40] * 4, 9, 20)] == [2, 2]
    rows = spark.createDataFrame([("1", "alpha"), ("2", None)], "id string, content string")
    got = embedding.embed_chunks(rows, embedding.HashEmbedder(8)).collect()
    assert all(len(r["vector"]) == 8 for r in got)


def test_ledger_and_grants():
    saved = []
    ledger = maintenance.Ledger(lambda: 10, saved.append)
    ledger.record(maintenance.savings(2))
    ledger.flush()
    assert ledger.meta() == {"session_tokens": 300, "total_tokens": 310, "cost_avoided_usd": 0.00093} and saved == [310]
    assert P.granted("Yes") and not P.granted(None) and P.grace_seconds("x") == 3600 and P.grace_seconds("-4") == 0


def test_probed_buckets_reach_most_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    centres = ann.fit(rows, ann.n_buckets(500))
    indexed = ann.build(rows, centres).cache()
    assert indexed.where("bucket IS NULL").count() == 0 and ann.wanted(1_001) and not ann.wanted(1_000)
    hits = total = 0
    for r in rows.where("id % 50 = 0").collect():
        query = [float(x) for x in r["vector"]]
        exact = {x["id"] for x in search.vector_topk(rows, query, 10).collect()}
        found = {x["id"] for x in ann.topk(indexed, centres, query, 10, len(centres) * 3 // 4).collect()}
        hits, total = hits + len(exact & found), total + len(exact)
    assert hits / total >= 0.9
    odd = spark.createDataFrame([(1, None), (2, [1.0])], "id long, vector array<float>")
    assert ann.build(odd, centres).where("bucket IS NOT NULL").count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_calibration_reaches_its_target_with_few_rows_measured(spark, metric):
    """Vectors in clusters: held-out and other queries find their neighbours in a small share of buckets and rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    at = rng.normal(size=(40, 16)) * 5
    points = [(str(i), [float(x) for x in at[i % 40] + rng.normal(size=16)]) for i in range(3_000)] + [("none", None), ("short", [1.0]), ("odd", [None] * 16)]
    rows = spark.createDataFrame(points, "id string, vector array<float>")
    index = ann.train(rows, 50)
    built = ann.build(rows, index).cache()
    assert built.where("codes IS NULL").count() == 3 == built.where("bucket IS NULL").count()
    index = ann.calibrate(built, index, metric=metric)
    assert index.recall >= ann.TARGET - 0.01 and index.probes <= 25 and index.measured < 600
    asked = points[100:160]
    got = {(r["query"], r["id"]) for r in ann.search_many(built, index, asked, 10, metric).collect()}
    exact = {(r["query"], r["id"]) for r in ann.search_many(built, index, asked, 10, metric, exact=True).collect()}
    assert len(got & exact) >= 0.9 * len(exact) == 0.9 * 600
    name, query = points[7]
    plain = [r["id"] for r in search.vector_topk(rows.where("id <> '7'"), query, 10, metric).collect()]
    truth = [r["id"] for r in ann.search_many(built, index, [(name, query)], 10, metric, exact=True).orderBy("rank").collect()]
    assert truth == plain
    few = ann.estimated(built, index, query, metric)
    assert few.count() <= index.measured and search.vector_topk(few, query, 1, metric).first()["id"] == "7"


def test_hybrid_search_of_two_tables_leaves_no_id_out(spark):
    near = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, vector array<float>")
    texts = spark.createDataFrame([(2, "apple pie"), (3, "apple apple"), (4, "pear")], "id long, content string")
    found = search.hybrid_topk(near, [0.0, 0.0], "apple", texts=texts).collect()
    assert {r["id"] for r in found} == {1, 2, 3}
    assert [r["id"] for r in search.hybrid_topk(near, [0.0, 0.0], "apple", fts_ready=False, texts=texts).collect()] == [1, 2]


def test_sources_of_symbols(spark, monkeypatch):
    monkeypatch.setattr(symbols, "SOURCE_BLOCK", 4)  # symbols reach over blocks
    files = spark.createDataFrame([("r", "a.py", "abcdéfghij"), ("r", "../b.py", "abc"), ("r", "n.py", None)], "repo string, file_path string, content string")
    rows = [("r", "a.py", "1", 0, 11), ("r", "a.py", "2", 3, 6), ("r", "a.py", "3", 8, 99), ("r", "a.py", "4", 5, 7), ("r", "a.py", "5", 7, 7), ("r", "a.py", "6", None, 7), ("r", "../b.py", "7", 0, 2), ("r", "n.py", "8", 0, 2), ("r", "gone.py", "9", 0, 2), (None, "a.py", "0", 0, 2)]
    held = spark.createDataFrame(rows, "repo string, file_path string, id string, start_byte int, end_byte int")
    found = symbols.with_source(held, files)
    assert found.columns == [*held.columns, "source"]
    assert {r["id"]: r["source"] for r in found.collect()} == {"1": "abcdéfghij", "2": "dé", "3": "hij", "4": "\ufffdf", **dict.fromkeys("567890")}


def test_a_files_bytes_are_not_looked_at_once_a_symbol(spark):
    source, n = "x" * 4_000_000, 4000
    files = spark.createDataFrame([("r", "a.py", source)], "repo string, file_path string, content string")
    held = spark.range(n).selectExpr("'r' AS repo", "'a.py' AS file_path", "id", "cast(id * 1000 AS int) AS start_byte", "cast(id * 1000 + 9 AS int) AS end_byte")
    plan = symbols.with_source(held, files)
    joined = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in joined and plan.where("source = 'xxxxxxxxx'").count() == n


def test_innermost_symbols_in_one_walk(spark):
    spans = [("r", "a", "out", 0, 100), ("r", "a", "in", 10, 20), ("r", "a", "next", 20, 30), ("r", "b", "other", 0, 5), (None, "a", "nowhere", 0, 9), ("r", "a", "none", None, 3)]
    places = [("r", "a", f"o{k}", k) for k in (0, 9, 10, 19, 20, 30, 99, 100)] + [("r", "b", "b4", 4), ("r", "b", "b5", 5), (None, "a", "n", 1), ("r", "a", "x", None)]
    held = spark.createDataFrame(spans, "repo string, file_path string, id string, start_byte int, end_byte int")
    uses = spark.createDataFrame(places, "repo string, file_path string, id string, start_byte int")
    found = symbols.enclosing_symbols(uses, held)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # no file's rows are one group
    assert {r["id"]: r["enclosing_symbol_id"] for r in found.collect()} == {"o0": "out", "o9": "out", "o10": "in", "o19": "in", "o20": "next", "o30": "out", "o99": "out", "b4": "other", "n": "nowhere"}


def test_outline_rows_are_the_outline(spark):
    rows = [("r", "a", "2", "g", "function", 5, 9, None, None, None), ("r", "a", "1", "f", "function", 0, 4, "d", ["@x"], "P"), ("r", "b", "3", "h", "class", 0, 4, None, None, None)]
    held = spark.createDataFrame(rows, "repo string, file_path string, id string, name string, kind string, start_byte int, end_byte int, docstring string, decorators array<string>, parent string")
    nested = symbols.file_outline(held).select("repo", "file_path", "symbol_count", F.posexplode("symbols").alias("pos", "s")).select("repo", "file_path", "symbol_count", "pos", "s.*")
    flat = symbols.outline_rows(held)
    assert "collect_list" not in flat._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, flat.select(nested.columns).collect())) == sorted(map(str, nested.collect()))


def test_postings_are_counted_in_their_rows(spark):
    rows = spark.createDataFrame([(1, "b a B, c a_1 b"), (2, ""), (3, None), (4, "É é x"), (5, "-- !")], "id long, content string")
    found = search.sharded_postings(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no posting is shuffled
    assert sorted((r["id"], r["term"], r["tf"], r["dl"]) for r in found.collect()) == [(1, "a", 1, 6), (1, "a_1", 1, 6), (1, "b", 3, 6), (1, "c", 1, 6), (4, "x", 1, 3), (4, "é", 2, 3)]
    plain = search.postings(rows).collect()
    assert sorted((r["id"], r["term"], r["tf"]) for r in plain) == sorted((r["id"], r["term"], r["tf"]) for r in found.collect())
    assert dict(found.dtypes) == {"term": "string", "shard": "int", "id": "bigint", "tf": "bigint", "dl": "bigint"}


def test_bounds_of_dealt_texts_pass_no_exchange(spark):
    texts = spark.range(300).selectExpr("id", "concat(repeat('a b ', int(id % 7)), 'c d', id % 5, ' e') AS content")
    dealt = search.sharded_postings(search.dealt_by_block(texts.unionByName(spark.createDataFrame([(999, None)], "id long, content string")), 3))
    assert dealt.withColumn("task", F.spark_partition_id()).groupBy("shard").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0
    held = search.sharded_postings(texts).withColumn("repo", F.lit("r"))
    found = search.local_blocks(held, "repo")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    summed = found.groupBy("repo", "term", "shard").agg(F.sum("entries"), F.max("max_tf"), F.min("min_dl"))
    expected = search.posting_blocks(held, "repo")
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, expected.collect()))
    assert found.columns == expected.columns and dict(found.dtypes) == dict(expected.dtypes)


def test_an_id_that_other_columns_say_is_not_stored(spark, tmp_path):
    held = tables.Store(spark, str(tmp_path))
    made = spark.range(2000).selectExpr("'r' AS repo", "concat('n', id % 7) AS name", "concat('some/long/folder/f', id % 5, '.py') AS file_path", "cast(id AS int) AS start_byte", "0 AS end_byte", "1 AS line_number", "'' AS line_text", "'call' AS kind", "cast(null AS string) AS enclosing_symbol_id", "false AS is_test_file")
    full = made.selectExpr("concat(file_path, ':occurrence:', name, ':', start_byte) AS id", "*")
    own = full.limit(1).selectExpr("'own' AS id", "repo", "name", "'other.py' AS file_path", *full.columns[4:])
    held.append("occurrences", full.unionByName(own))
    expected = sorted(map(tuple, full.unionByName(own).select(*schemas.OCCURRENCES.fieldNames()).collect()), key=str)
    assert sorted(map(tuple, held.read("occurrences").collect()), key=str) == expected
    stored = spark.read.schema(schemas.OCCURRENCES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "occurrences"))
    assert [r["id"] for r in stored.where("id IS NOT NULL").collect()] == ["own"]
    held.replace("occurrences", None, full.where("start_byte = 3").select("id", "repo", "file_path"), ("id",))
    assert held.read("occurrences").count() == 2000 and held.read("occurrences").where("start_byte = 3").count() == 0
    other = tables.Store(spark, str(tmp_path / "other"))
    other.append("occurrences", made)  # the ids are left to the store
    assert {r["id"] for r in other.read("occurrences").select("id").collect()} == {r["id"] for r in full.select("id").collect()}


def test_a_project_begins_with_buckets_for_what_is_expected(spark, tmp_path):
    sources = spark.range(400).selectExpr("if(id % 4 = 0, 'q', 'p') AS repo", "concat('f', id) AS file_path", "id")
    held = tables.Store(spark, str(tmp_path), bucket_bytes=20_000)
    made = held.dealt("files", sources, F.lit(1000)).selectExpr("repo", "file_path", "sha2(file_path, 256) AS file_hash", "'2' AS version")
    began = held.version("files")
    held.append("files", made, dealt=True)
    assert held.version("files") == began + 1 and len(list((tmp_path / "files").glob("v=*"))) == 1  # nothing is dealt anew
    wide = {repo: held.manifest("files").widths[str(held.slot(repo))] for repo in ("p", "q")}
    assert wide == {"p": 16, "q": 8}
    assert {p: x[0] for p, x in held.projects("files").items()} == {"p": 300, "q": 100}
    assert held.read("files", repo="q").count() == 100 and held.read("files").distinct().count() == 400
    held.expect("files", sources, F.lit(10**6))  # a project that holds rows keeps its buckets
    assert {repo: held.manifest("files").widths[str(held.slot(repo))] for repo in wide} == wide
    assert held.expect("files", sources.selectExpr("'new' AS repo"), F.lit(None).cast("long")) == held.version("files")


def test_index_meta_writes_each_occurrence_once_and_without_its_id(spark, tmp_path, monkeypatch):
    from tessera.plans import surface_queries, views

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(surface_queries, "_store", lambda spark: tables.Store(spark, str(tmp_path), bucket_bytes=100_000))
    row = surface_queries.store_index_meta(spark, d).first()
    held = tables.Store(spark, str(tmp_path))
    uses = views.occurrences(spark, d)
    assert row["occurrences"] == uses.where("repo = 'src3'").count() and held.read("occurrences").count() == uses.count()
    assert held.read("occurrences").select("repo", "id").exceptAll(uses.select("repo", "id")).count() == 0
    assert len(list((tmp_path / "occurrences").glob("v=*"))) == 1
    stored = spark.read.schema(schemas.OCCURRENCES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "occurrences"))
    assert stored.where("id IS NOT NULL").count() == 0


def test_dealt_rows_pass_no_exchange_and_shuffles_go_with_their_write(spark, tmp_path):
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    held = tables.Store(spark, str(tmp_path / "t"))
    sources = spark.range(40).selectExpr("concat('r', id % 3) AS repo", "concat('f', id) AS file_path", "id")
    made = held.dealt("files", sources).selectExpr("repo", "file_path", "'h' AS file_hash", "'2' AS version")
    assert "file_path" in made.columns and held.append("files", made, dealt=True) == 1
    assert spark.conf.get(cleanup) == before
    assert {p: x[0] for p, x in held.projects("files").items()} == {"r0": 14, "r1": 13, "r2": 13}
    assert held.read("files", repo="r1").count() == 13 and held.read("files").distinct().count() == 40
    assert held.append("files", sources.limit(0).selectExpr("repo", "file_path", "'h' AS file_hash", "'2' AS version"), dealt=True) == 1
    files = [f.name for f in (tmp_path / "t").rglob("*.parquet") if f.is_file()]
    assert files and all(".zstd." in f for f in files)
