"""One-shot commands: ``python -m tessera.cli search-semantic QUERY PATH`` and so on."""

from __future__ import annotations

import argparse
import json
import os

from tessera.api import Engine, Settings
from tessera.operators.predicates import granted
from tessera.session import local_session

GRANT = "TESSERA_ALLOW_DESTRUCTIVE"
COMMANDS = {
    "search-semantic": ("search_semantic", ("query", "path")),
    "index-semantic": ("index_semantic", ("path",)),
    "staleness": ("staleness", ("path",)),
    "search-symbols": ("search_symbols", ("query", "path")),
    "index-symbols": ("index_symbols", ("path",)),
    "index-symbols-repo": ("index_symbols_repo", ("repo",)),
    "search-text": ("search_text", ("query", "path")),
    "search-references": ("search_references", ("query", "path")),
    "get-symbol": ("get_symbol", ("symbol_id", "path")),
    "file-tree": ("file_tree", ("path",)),
    "file-outline": ("file_outline", ("path", "file_path")),
    "repo-outline": ("repo_outline", ("path",)),
    "init-ignore": ("scaffold_ignore", ("root",)),
    "status": ("status", ("path",)),
    "remove": ("remove_project", ("path",)),
    "gc": ("gc", ()),
    "prune-orphans": ("prune_orphans", ()),
    "prune-symbols": ("prune_symbols", ()),
    "invalidate-worktree": ("invalidate_worktrees", ("paths",)),
    "list-repos": ("list_repos", ()),
}
#: Commands that only report unless told to execute, and how the tool is told.
REPORTS = {"gc": lambda execute: {"delete": execute}, "prune_orphans": lambda execute: {"dry_run": not execute}, "prune_symbols": lambda execute: {"dry_run": not execute}}
LIMITED = ("search_semantic", "search_symbols", "search_references")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--warehouse", default=os.path.expanduser("~/.tessera"), help="where the tables lie; on a cluster, a folder that all share")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (tool, arguments) in COMMANDS.items():
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a, **({"nargs": "+"} if a == "paths" else {}))
        if tool in LIMITED:
            sub.add_argument("--limit", type=int)
        if tool in REPORTS:
            sub.add_argument("--execute", action="store_true", help=f"delete what the report names; needs {GRANT}")
    given = parser.parse_args(argv)
    tool, arguments = COMMANDS[given.command]
    extra = {"limit": given.limit} if getattr(given, "limit", None) else {}
    if tool in REPORTS:
        extra |= REPORTS[tool](given.execute)
    engine = Engine(local_session(), Settings(given.warehouse, allow_destructive=granted(os.environ.get(GRANT))))
    out = engine.call(tool, **{a: getattr(given, a) for a in arguments}, **extra)
    print(json.dumps(out, default=str, indent=2))
    return int("error" in out)


if __name__ == "__main__":
    raise SystemExit(main())
