import http.server
import json
import os
import shutil
import threading

import pytest

from tessera import cli
from tessera.api import MAX_PROJECTS, Engine, Settings
from tessera.sources import remote


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    for path, body in {
        "src/__init__.py": "",
        "src/auth.py": "import os\n\nclass Auth:\n    def login(self, user):\n        return os.getenv(user)\n\ndef helper():\n    return Auth().login('x')\n",
        "src/use.py": "from auth import helper\n\nhelper()\nhelper()\n",
        "tests/test_auth.py": "from auth import helper\n\ndef test_helper():\n    assert helper()\n",
        "node_modules/x.js": "function helper() {}", ".env": "SECRET=1", "run.log": "helper", ".gitignore": "*.log\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    return str(root)


def test_symbols_end_to_end(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    tree = [r["file_path"] for r in engine.call("file_tree", path=project)["results"]]
    assert tree == [".gitignore", "src/__init__.py", "src/auth.py", "src/use.py", "tests/test_auth.py"]
    (meta,) = engine.call("index_symbols", path=project)["results"]
    assert (meta["files"], meta["symbols"], meta["version"]) == (4, 4, "2.3")
    refs = engine.call("search_references", query="HELPER", path=project, usage_filter="include_tests")["results"]
    assert [r["file_path"] for r in refs] == ["src/use.py"] * 3 + ["tests/test_auth.py"] * 2 and not any(r["is_stale"] for r in refs)
    (found,) = engine.call("get_symbol", symbol_id="src/auth.py:method:Auth.login", path=project)["results"]
    assert found["source"].startswith("def login(self")
    with open(f"{project}/src/use.py", "a") as f:
        f.write("# edited\n")
    stale = {r["file_path"]: r["is_stale"] for r in engine.call("search_references", query="helper", path=project, usage_filter="include_tests")["results"]}
    assert stale == {"src/use.py": True, "tests/test_auth.py": False}
    engine.call("index_symbols", path=project)
    assert not any(r["is_stale"] for r in engine.call("search_references", query="helper", path=project)["results"])
    assert engine.call("invalidate_cache", path=project)["error"]


def test_semantic_end_to_end(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    (status,) = engine.call("index_semantic", path=project)["results"]
    assert status["files"] >= 2
    rows = engine.call("search_semantic", query="login user", path=project, m=2)["results"]
    assert rows[0]["file_path"] == "src/auth.py" and rows[0]["match_type"] == "hybrid"
    assert {r["match_type"] for r in engine.call("search_semantic", query="login", path=project, hybrid=False)["results"]} == {"vector"}
    assert engine.call("staleness", path=project)["results"] == []


def test_errors_are_values_and_jobs_are_kept(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    assert engine.call("search_symbols", query=" ", path=project)["error"] == "query must not be empty"
    assert "error" in engine.call("no_such_tool")
    assert engine.job_histogram() == {"failed": 2}
    assert [r["status"] for r in engine.call("diagnostics")["results"]] == ["failed", "failed", "running"]
    for i in range(MAX_PROJECTS):
        engine._register(f"/p{i}")
    with pytest.raises(ValueError):
        engine._register("/one-more")
    assert engine.remove_project("/p0") and not engine.remove_project("/p0")
    target, fresh = engine.scaffold_ignore(project)
    assert fresh and engine.scaffold_ignore(project) == (target, False)


def test_remote_tree_has_symbols_only(spark, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    blobs = {"a.py": b"def f(): g()\n", "b.txt": b"x", "c.py": None}
    (meta,) = engine.index_symbols_repo("github:o/n@HEAD", list(blobs), blobs.get).collect()
    assert (meta["files"], meta["symbols"], meta["occurrences"], meta["version"]) == (1, 1, 0, "2.0")


def test_refresh_warm_and_gc(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store"), staleness_deadline_s=60, allow_destructive=True))
    assert engine.ensure_fresh(project, background=False) == "refreshing"
    assert engine.ensure_fresh(project) == "fresh"
    other = Engine(spark, Settings(str(tmp_path / "store"), allow_destructive=True))
    assert other.warm([f" {project} ", project, "/nowhere"]) == [project] and other.gc().count() == 0
    assert not other.cancel("no such job")
    other.remove_project(project)


    shutil.rmtree(project)
    assert [(r["step"], r["reason"], r["project"]) for r in other.gc().collect()] == [("orphans", "project_path_enoent", project)]
    assert other.gc(delete=True).count() == 1 and other.gc().count() == 0 and other.store.read("chunks").count() == 0


def test_watched_changes_reach_the_text_index(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    engine.call("index_semantic", path=project)
    with open(f"{project}/src/fresh.md", "w") as f:
        f.write("a wholly zebraic sentence for the index to find again\n")
    query = engine.watch_start(project, str(tmp_path / "state"), {"availableNow": True})
    query.awaitTermination(120)
    assert query.exception() is None
    top = engine.call("search_semantic", query="zebraic", path=project)["results"][0]
    assert top["file_path"] == "src/fresh.md" and engine.watch_stop(project) == 1
    assert engine.store.read("postings").where("term = 'zebraic'").count() == 1


def opened(root, since=0):
    """Paths that were read since their access time was set back."""
    return {os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names if os.stat(os.path.join(d, n)).st_atime > since}


def set_back(root):
    for d, _, names in os.walk(root):
        for n in names:
            path = os.path.join(d, n)
            os.utime(path, (0, os.stat(path).st_mtime))


def test_only_wanted_files_are_opened(spark, project, tmp_path):
    set_back(project)
    open(f"{project}/run.log").read()
    if opened(project) != {"run.log"}:
        pytest.skip("this file system keeps no access times")
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    set_back(project)
    assert engine.listing(project).count() == 5
    assert opened(project) <= {".gitignore"}  # the rules
    assert len(engine.file_outline(project, "src/auth.py").collect()) == 1
    assert opened(project) <= {".gitignore", "src/auth.py"} and "src/auth.py" in opened(project)
    engine.call("index_symbols", path=project)
    set_back(project)
    assert engine.call("get_symbol", symbol_id="src/auth.py:function:helper", path=project)["results"][0]["source"].startswith("def helper")
    assert opened(project) == {"src/auth.py"}
    set_back(project)
    assert engine.call("search_references", query="helper", path=project)["results"]
    assert opened(project) == {"src/use.py", "tests/test_auth.py"}


def test_a_search_opens_the_files_of_its_trigrams(spark, project, tmp_path):
    set_back(project)
    open(f"{project}/run.log").read()
    if opened(project) != {"run.log"}:
        pytest.skip("this file system keeps no access times")
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    asked = [("HELPER", False), ("helper", True), ("Helper", True), ("os.getenv(user)", False), ("no such text", False), ("er", False), ("x'", True)]
    plain = [[tuple(r) for r in engine.search_text(q, project, 50, cs).collect()] for q, cs in asked]
    engine.index_semantic(project)
    assert [[tuple(r) for r in engine.search_text(q, project, 50, cs).collect()] for q, cs in asked] == plain
    set_back(project)
    assert [r["file_path"] for r in engine.search_text("os.getenv", project).collect()] == ["src/auth.py"]
    assert opened(project) <= {".gitignore", "src/auth.py"}
    set_back(project)
    assert engine.search_text("no such text", project).collect() == [] and opened(project) <= {".gitignore"}
    with open(f"{project}/src/new.md", "w") as f:
        f.write("calls os.getenv, too\n")
    assert [r["file_path"] for r in engine.search_text("os.getenv", project).collect()] == ["src/auth.py", "src/new.md"]


def test_an_untouched_tree_opens_no_file(spark, project, tmp_path):
    set_back(project)
    open(f"{project}/run.log").read()
    if opened(project) != {"run.log"}:
        pytest.skip("this file system keeps no access times")
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    engine.index_semantic(project)
    set_back(project)
    assert engine.staleness(project).collect() == [] and engine.pending(project).count() == 0
    engine.index_semantic(project)
    assert opened(project) <= {".gitignore"}  # the rules
    with open(f"{project}/src/use.py", "a") as f:
        f.write("# one edit\n")
    set_back(project)
    assert [(r["reason"], r["count"]) for r in engine.staleness(project).collect()] == [("modified", 1)]
    assert opened(project) <= {".gitignore", "src/use.py"} and "src/use.py" in opened(project)
    assert [r["file_path"] for r in engine.pending(project).collect()] == ["src/use.py"]
    os.unlink(f"{project}/src/use.py")
    assert [(r["reason"], r["count"]) for r in engine.staleness(project).collect()] == [("deleted", 1)]


def test_asked_paths_choose_the_folders_that_are_walked(spark, project, tmp_path):
    from tessera.sources import corpus
    from tessera.sources.tree import TreeReader

    os.symlink(f"{project}/src", f"{project}/linked")
    os.makedirs(f"{project}/src/deep/er")
    with open(f"{project}/src/deep/er/a.py", "w") as f:
        f.write("x = 1\n")

    def walked(paths=None, beginning=""):
        reader = TreeReader({"path": project, "beginning": beginning} | ({} if paths is None else {"paths": json.dumps(paths)}))
        parts = reader.partitions()
        return [p.value[0] for p in parts], sorted(row[1] for p in parts for row in reader.read(p))

    assert walked(["src/auth.py"]) == (["src"], ["src/auth.py"])
    assert walked(["src/auth.py", "tests/none.py", ".gitignore"]) == (["", "src", "tests"], [".gitignore", "src/auth.py"])
    for path in ("node_modules/x.js", "linked/auth.py", "../proj/src/auth.py", "/etc/passwd", ""):
        assert walked([path])[1] == []
    folders, found = walked(beginning="src/deep/e")
    assert folders[0] == "src/deep" and found == ["src/deep/er/a.py"]
    assert walked(beginning="node_modules/")[1] == [] == walked(["src/use.py"], "tests/")[1]
    whole = sorted(r["file_path"] for r in corpus.listing(spark, project).collect())
    for beginning in ("", "s", "src/", "src/d", "src/auth.py", "none/"):
        assert sorted(r["file_path"] for r in corpus.listing(spark, project, beginning=beginning).collect()) == [p for p in whole if p.startswith(beginning)]
    assert corpus.listing(spark, project, only=["src/auth.py"]).rdd.getNumPartitions() == 1


def test_windows_end_at_the_wall_and_go_on(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store"), max_files_per_window=2, max_wall_s=-1.0))
    assert [r["file_path"] for r in engine.pending(project).collect()] == [".gitignore", "src/__init__.py", "src/auth.py", "src/use.py", "tests/test_auth.py"]
    (one,) = engine.index_semantic(project).collect()
    assert one["remaining"] == 3 and engine.store.read("chunks").select("file_path").distinct().count() == 1
    with open(f"{project}/new.py", "w") as f:
        f.write("x = 1\n" * 9)
    (two,) = engine.index_semantic(project).collect()  # goes on where it stopped, without a look at the tree
    assert two["remaining"] == 1
    (three,) = engine.index_semantic(project).collect()
    assert three["remaining"] == 0 and engine.store.read("chunks").where("file_path = 'new.py'").count() == 0
    assert [r["file_path"] for r in engine.zero_chunk_files(project).collect()] == ["src/__init__.py"]
    assert engine.ensure_fresh(project, background=False) in ("refreshing", "fresh")
    engine.index_semantic(project)
    assert engine.store.read("chunks").where("file_path = 'new.py'").count() == 1 and engine.pending(project).count() == 0
    os.remove(f"{project}/new.py")
    engine.index_semantic(project)
    assert engine.store.read("chunks").where("file_path = 'new.py'").count() == 0


def test_project_meta_aliases_and_worktrees(spark, project, tmp_path):
    tree = str(tmp_path / "tree")
    os.makedirs(tree)
    engine = Engine(spark, Settings(str(tmp_path / "store"), allow_destructive=True, repo_key=lambda p: project if p == tree else os.path.abspath(p)))
    engine._register(tree)
    engine.index_semantic(project)
    (meta,) = engine.project_meta(project).collect()
    assert (meta["project_path"], meta["alias_paths"]) == (project, [tree]) and engine.project_meta("/none").count() == 0
    assert engine.gc_aliases().count() == 0
    os.rmdir(tree)
    assert [r["path"] for r in engine.gc_aliases().collect()] == [tree]
    assert [(r["step"], r["project"]) for r in engine.gc(delete=True).collect()] == [("aliases", tree)]
    assert engine.project_meta(project).first()["alias_paths"] == []
    (row,) = engine.invalidate_worktrees([project]).collect()
    assert not row["cache_deleted"] and row["error"] is None
    shutil.rmtree(project)
    rows = {r["path"]: r for r in engine.invalidate_worktrees([project, "/nowhere"]).collect()}
    assert rows["/nowhere"]["error"] == "no cache dir found for path" and rows[project]["bytes_reclaimed"] > 0


def test_pruning_takes_its_inventory_from_the_tables(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store"), grace_s=0))
    engine.index_symbols(project)
    engine.index_semantic(project)
    engine.remove_project(project)
    assert engine.prune_orphans().count() == 0 and engine.prune_symbols().count() == 0
    shutil.rmtree(project)
    assert [r["reason"] for r in engine.prune_orphans().collect()] == ["project_path_enoent"]
    assert {r["reason"] for r in engine.prune_symbols().collect()} == {"repo_path_enoent"}
    with pytest.raises(ValueError):
        engine.prune_orphans(dry_run=False)
    engine.settings.allow_destructive = True
    engine._register(project)
    assert engine.prune_orphans(dry_run=False).count() == 0  # loaded projects stay
    engine.remove_project(project)
    assert engine.prune_orphans(dry_run=False).count() == 1 and engine.prune_symbols(dry_run=False).count() == 2
    assert all(engine.store.read(t).count() == 0 for t in ("chunks", "postings", "project_meta", "files", "symbols", "index_meta"))
    sweep = engine.start_sweep(0.0)
    sweep.join(60)
    assert engine.start_sweep() is sweep and engine.job_histogram() == {"finished": 1}


def test_search_reads_the_project_s_postings(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store"), vector_index_rows=1))
    engine.index_semantic(project)
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.md").write_text("login login login of another project, with words enough to be a chunk of its own\n")
    engine.index_semantic(str(other))
    exact = engine.search_semantic("login user", project).collect()
    assert {r["file_path"] for r in exact} <= {"src/auth.py", "src/use.py", "tests/test_auth.py", ".gitignore"} and exact[0]["match_type"] == "hybrid"
    near = engine.search_semantic("login user", project, approximate=True).collect()
    assert [r["id"] for r in near][:1] == [r["id"] for r in exact][:1]
    held = engine.store.read("postings", repo=engine._register(project))
    lookup = held.where("term IN ('login', 'user')")
    plan = spark._jvm.PythonSQLUtils.explainString(lookup._jdf.queryExecution(), "formatted")
    assert "In(term, [login,user])" in plan and len(lookup.inputFiles()) <= 4
    assert engine.store.read("vector_buckets", repo=project).count() == engine.store.read("chunks", repo=project).count()
    # what comes later is assigned to the stored centroids; what goes leaves the index
    centres = engine.store.version("vector_centres")
    with open(f"{project}/src/later.md", "w") as f:
        f.write("a later file about login and logout, with words enough to make a chunk\n")
    os.unlink(f"{project}/src/use.py")
    engine.index_semantic(project)
    held = {r["id"] for r in engine.store.read("chunks", repo=project).collect()}
    assert {r["id"] for r in engine.store.read("vector_buckets", repo=project).collect()} == held
    assert engine.store.version("vector_centres") == centres


def test_outline_totals_and_ledger(spark, project, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "store")))
    rows = engine.call("repo_outline", path=project)["results"]
    assert [r["file_path"] for r in rows] == ["src/auth.py", "tests/test_auth.py"] and {(r["total_files"], r["total_symbols"]) for r in rows} == {(4, 4)}
    assert Engine(spark, Settings(str(tmp_path / "store"))).ledger.total == engine.ledger.total > 0


def test_remote_tree_over_its_web_interface(spark, tmp_path):
    source = b"def f():\n    return 1\n"

    class Host(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/repos/o/n/git/trees/main?recursive=1": json.dumps({"tree": [{"path": "a.py", "type": "blob"}, {"path": "d", "type": "tree"}, {"path": "gone.py", "type": "blob"}]}).encode(), "/o/n/main/a.py": source}.get(self.path)
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        tree = remote.RemoteTree("o/n", "main", "token", url, url)
        assert tree.listing() == ["a.py", "gone.py"] and tree.fetch("gone.py") is None
        assert remote.RemoteTree.of_key(tree.key).repo == "o/n" and remote.RemoteTree.of_key("/local") is None
        engine = Engine(spark, Settings(str(tmp_path / "store")))
        (meta,) = engine.index_symbols_repo(tree.key, tree.listing(), tree.fetch).collect()
        assert meta["files"] == 1
        (found,) = engine.get_symbols(["a.py:function:f"], tree.key).collect()
        assert found["source"] == source.decode().strip()
    finally:
        server.shutdown()


def test_commands_report_unless_told_and_granted(spark, project, tmp_path, capsys, monkeypatch):
    warehouse = ["--warehouse", str(tmp_path / "store")]
    assert cli.main([*warehouse, "index-symbols", project]) == 0 and json.loads(capsys.readouterr().out)["results"][0]["files"] == 4
    assert cli.main([*warehouse, "get-symbol", "src/auth.py:function:helper", project]) == 0 and "def helper" in capsys.readouterr().out
    shutil.rmtree(project)
    assert cli.main([*warehouse, "prune-symbols"]) == 0 and len(json.loads(capsys.readouterr().out)["results"]) == 2
    assert cli.main([*warehouse, "prune-symbols", "--execute"]) == 1 and "not allowed" in capsys.readouterr().out
    monkeypatch.setenv(cli.GRANT, "yes")
    assert cli.main([*warehouse, "prune-symbols", "--execute"]) == 0 and cli.main([*warehouse, "prune-symbols"]) == 0
    assert json.loads(capsys.readouterr().out.split("}\n{")[-1].join(["{", ""]))["results"] == []
